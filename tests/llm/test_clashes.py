"""Every operator and stage takes extra columns of any name: its results' names, its own inner ones, and odd ones."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm import bpe, decontaminate, licenses, line_dedup, pages, periodic, personal, quality, queries, repeats, sharding, simhash

SF = "/root/testdata/sf0.001"
INPUT = ["doc_id", "text", "lang", "source", "url", "html"]
#: All names in double quotes in the code of the operators, and some odd ones.
NAMES = sorted({n for f in Path(pages.__file__).parent.glob("*.py") for n in re.findall(r"[\"']([A-Za-z_][A-Za-z0-9_]{0,20})[\"']", f.read_text())} - set(INPUT))
ODD = ["a.b", "c d", "e`f", "own0", "own1", "_row", "_text", "_key", "_n_words", "_lang", "_lines", "_places", "_site", "_html", "_url", "_hits", "KEPT", "Text_", "pemail", "wphone"]


def wide(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, url string, html string")
    taken, names = {n.lower() for n in INPUT}, []
    for n in NAMES + ODD:
        if n.lower() not in taken:
            taken.add(n.lower())
            names.append(n)
    return df.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)]), names


ROWS = [(1, "some words of a text", "en", "s", "http://h/", "<p>x</p>"), (1, "some words of a text", "en", "s", "http://h/", "<p>x</p>"), (None, None, None, None, None, None), (3, "", "", "", "", "")]


def items(spark):
    return spark.createDataFrame([(1, "some words of a text")], "item_id long, text string")


OPERATORS = {
    "decontaminate": (lambda s, d: decontaminate.decontaminate(d, items(s)), ["n_words", "n_hit", "hits", "items", "contaminated"]),
    "lines": (lambda s, d: line_dedup.dedup_lines(d, d["source"]), ["n_lines", "n_dropped"]),
    "quality": (lambda s, d: quality.score_quality(d), ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "char_distance", "word_distance", "base_failed", "kept"]),
    "bpe": (lambda s, d: bpe.encode_documents(d, queries.vocabulary(), decoded_col="decoded"), ["ids", "decoded"]),
    "licences": (lambda s, d: licenses.scan_licenses(d), ["n_words", "places", "spans", "base_labels", "labels", "score"]),
    "pages": (lambda s, d: pages.extract_main(d, text_col="main"), ["main"]),
    "repeats": (lambda s, d: repeats.remove_repeats(d), ["n_bytes", "removed", "kept"]),
    "personal": (lambda s, d: personal.find_personal(d), ["base", "spans"]),
    "runs": (lambda s, d: periodic.collapse_runs(d), ["n_words", "runs", "collapsed"]),
    "sharding": (lambda s, d: sharding.assign_shards(d, "doc_id", ["a", "b"], 7), ["slot", "shard"]),
    "keep_one": (lambda s, d: simhash.keep_one(d), []),
    "keep_good": (lambda s, d: quality.keep_good(d), []),
    "drop_contaminated": (lambda s, d: decontaminate.drop_contaminated(d, items(s)), []),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_extra_columns_pass_through(spark, name):
    df, extra = wide(spark, ROWS)
    run, results = OPERATORS[name]
    out = run(spark, df)
    gone = {r.lower() for r in results} | ({"text"} if name == "repeats" else set())
    assert [c for c in out.columns if c not in results] == [c for c in df.columns if c.lower() not in gone]
    assert set(results) <= set(out.columns)
    rows = [r.asDict() for r in out.collect()]
    assert len(rows) == len(ROWS) or name.startswith(("keep", "drop"))
    for i, n in enumerate(extra):
        if n.lower() not in gone:
            assert all(r[n] == i for r in rows), n


def test_stages_keep_extra_columns(spark):
    df, _ = wide(spark, ROWS + [(7, "the word of the river and " * 30 + "x", "en", "s", None, None)])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, df, SF).columns == df.columns, name
