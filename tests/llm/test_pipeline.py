import brute
from tokenizers import Tokenizer

import corpus_pipeline
from ledgerloom.llm import line_dedup, quality, queries

SF = "/root/testdata/sf0.001"


def test_pipeline_matches_a_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id for r in quality.score_quality(docs).where("kept").collect()}
    rows = {r.doc_id: r for r in docs.collect() if r.doc_id in kept}
    pages, held = {}, {}
    strip = lambda x: x.strip(" \t\n\r\x0b\x0c")
    for r in rows.values():
        pages[r.source] = pages.get(r.source, 0) + 1
        for line in {strip(x) for x in r.text.split("\n")} - {""}:
            held[r.source, line] = held.get((r.source, line), 0) + 1
    bad = {k for k, n in held.items() if pages[k[0]] >= 20 and n > 0.08 * pages[k[0]]}
    texts = {i: "\n".join(x for x in r.text.split("\n") if (r.source, strip(x)) not in bad) for i, r in rows.items()}
    group = brute.components([(i, brute.fingerprint(t)) for i, t in texts.items()])
    texts = {i: t for i, t in texts.items() if group[i] == i}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    dirty = {d[0] for d in brute.decontaminate(list(texts.items()), items) if d[-1]}
    t = Tokenizer.from_file(queries.vocabulary())
    expected = {i: (x, t.encode(x, add_special_tokens=False).ids, len(x)) for i, x in texts.items() if i not in dirty}
    got = {r.doc_id: (r.text, r.ids, r.n_chars) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == expected and 0 < len(got) < docs.count()


def test_each_stage_takes_nulls_and_no_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (None, "word " * 80, "xx", None, 400), (3, "word " * 80, "xx", None, 400)], schema)
    for docs in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            assert out.count() <= docs.count(), name
            if (name, stage) != corpus_pipeline.STAGES[-1]:
                assert out.columns == docs.columns, name


def test_line_dedup_defaults_leave_small_sources_alone(spark):
    docs = spark.createDataFrame([(i, "same line", "s") for i in range(5)], "doc_id long, text string, source string")
    assert line_dedup.dedup_lines(docs, docs["source"]).where("n_dropped > 0").isEmpty()
