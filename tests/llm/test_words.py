import hashlib
import os

import brute
import numpy as np
import pytest
from data import documents
from pyspark.sql import functions as F

from ledgerloom.llm import bpe, decontaminate, licenses, line_dedup, quality, sharding, simhash


def test_decontamination_matches_brute_force(spark):
    docs, rows = documents(spark)
    whole = [r[1] for r in rows if r[1]]
    items = [(1, whole[12]), (2, " ".join(whole[20].split()[3:9])), (3, None), (4, "..."), (5, whole[30][:200]), (5, whole[30][:200]), (6, "two words")]
    found = decontaminate.decontaminate(docs.withColumn("items", F.lit(1)), spark.createDataFrame(items, "item_id long, text string"))
    got = {r.doc_id: (r.n_words, r.n_hit, len(r["items"]), brute.sha(",".join(sorted(r["items"]))), r.contaminated) for r in found.collect()}
    assert got == {d[0]: d[1:] for d in brute.decontaminate([(r[0], r[1]) for r in rows], items)}
    assert sum(x[1] > 0 for x in got.values()) > 4
    decontaminate.SLICE_WINDOWS, before = 40, decontaminate.SLICE_WINDOWS
    try:
        again = decontaminate.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string"))
        assert {r.doc_id: (r.n_words, r.n_hit, len(r["items"]), brute.sha(",".join(sorted(r["items"]))), r.contaminated) for r in again.collect()} == got
    finally:
        decontaminate.SLICE_WINDOWS = before
    stay = decontaminate.drop_contaminated(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert stay.columns == docs.columns and stay.count() == sum(not x[-1] for x in got.values())


def test_decontamination_of_empty_tables(spark):
    docs, _ = documents(spark, 10)
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(docs, none).where("contaminated or n_hit > 0").count() == 0
    assert decontaminate.decontaminate(docs.limit(0), none).count() == 0


def test_quality_base_matches_brute_force(spark):
    docs, rows = documents(spark)
    found = quality.score_quality(docs.withColumn("kept", F.lit("clash")))
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in found.collect()}
    assert got == {r[0]: brute.quality_base(r[1]) for r in rows}
    assert found.where("base_failed and kept").isEmpty()
    assert quality.score_quality(docs.limit(0)).count() == 0


def test_windows_of_equal_hash_bits_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(quality, "_PLACE", (1 << 63) - 1 - ((1 << 63) - (1 << 62)))  # two bits of the hash are left
    r = np.random.default_rng(5)
    rows = [(i, " ".join("abcdefgh"[j] for j in r.integers(0, 8, 150)), "en") for i in range(40)] + [(99, "x y z " * 3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x.doc_id: x.n_repeat_words for x in quality.score_quality(docs).collect()}
    assert got == {i: brute.quality_base(t)[4] for i, t, _ in rows}


def test_characters_are_code_points_and_languages_keep_apart(spark):
    rows = [(i, "語" * 126 + " " + "w " * 60, None if i % 2 else "") for i in range(8)] + [(9, "語" * 130, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.lang: round(r.chars[5], 6) for r in quality.references(docs).collect()} == {None: round(126 / 247, 6), "": round(126 / 247, 6)}
    got = {r.doc_id: r.char_distance for r in quality.score_quality(docs, least_chars=140).collect()}
    assert got[9] is None and got[0] is not None and quality.score_quality(docs, carry=["doc_id"]).columns[:2] == ["doc_id", "n_words"]


def test_divergent_documents_are_rejected(spark):
    plain = "the river and the field of corn in the light of that morning was on the way to it "
    rows = [(i, plain * 2 + f"number {i} " + " ".join(f"w{i}x{j}" for j in range(60)), "en") for i in range(30)]
    rows += [(100, " ".join(f"###{j}***$$$" for j in range(80)), "en"), (101, " ".join(f"SHOUT{j}!!" for j in range(80)), "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.doc_id for r in quality.keep_good(docs).collect()} == set(range(30))


def test_long_texts_with_few_common_words_are_judged(spark):
    name = lambda i: "".join("bcdfghjklm"[int(d)] + "aeiouaeiou"[int(d)] for d in str(i))
    own = lambda n, i: " ".join(name(1000 * i + j) for j in range(n))
    plain = "the river and the field of corn in the light of that morning was on the way to it "
    rows = [(i, plain * 2 + own(60, i), "en") for i in range(1, 31)]
    rows += [(100, own(300, 100), "en"), (101, own(300, 101) + " as as as", "en"), (102, own(149, 102), "en"), (103, own(150, 103), "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.doc_id for r in quality.keep_good(docs).collect()} == {*range(1, 31), 102}
    assert {r.doc_id for r in quality.keep_good(docs, long_words=None).collect()} == {*range(1, 31), 100, 101, 102, 103}


def test_jensen_shannon_is_a_distance(spark):
    d = spark.range(1).select(
        quality.jensen_shannon(F.array(F.lit(1.0), F.lit(3.0)), F.array(F.lit(2.0), F.lit(6.0))).alias("same"),
        quality.jensen_shannon(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(5.0))).alias("apart"),
        quality.jensen_shannon(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("none"),
    ).first()
    assert d.same == pytest.approx(0) and d.apart == pytest.approx(1) and d.none is None


@pytest.mark.parametrize("bound", [100_000, 0])
def test_line_dedup_matches_brute_force(spark, bound):
    rows = [(i, "host" if i % 2 else None, "\n".join([f"own {i}", " Menu | Home ", "Menu | Home", "", "twice"] if i % 3 else [f"own {i}", f"pair {i // 2}"])) for i in range(40)] + [(99, "host", None), (98, "small", "Menu | Home"), (97, "host", "one\ntwo"), (97, "host", "one\ntwo")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    line_dedup.BROADCAST_LINES, before = bound, line_dedup.BROADCAST_LINES
    try:
        got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(docs, docs["source"], ratio=0.3, least_pages=10).collect()}
    finally:
        line_dedup.BROADCAST_LINES = before
    strip = lambda x: x.strip(" \t\n\r\x0b\x0c")
    for i, site, text in rows:
        if text is None:
            assert got[i] == (None, 0, 0)
            continue
        pages = [r[2] for r in rows if r[1] == site]
        often = {x for x in map(strip, text.split("\n")) if x and len(pages) >= 10 and sum(x in map(strip, (p or "").split("\n")) for p in pages) > 0.3 * len(pages)}
        kept = [x for x in text.split("\n") if strip(x) not in often]
        assert got[i] == ("\n".join(kept), len(text.split("\n")), len(text.split("\n")) - len(kept))


def test_fingerprints_and_components_match_brute_force(spark):
    docs, rows = documents(spark, 200)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    values = [(r[0], brute.fingerprint(r[1])) for r in rows]
    group = brute.components(values)
    assert got == {i: (f"{v:016x}", group[i]) for i, v in values}
    stay = simhash.keep_one(docs)
    assert sorted(r.doc_id for r in stay.collect()) == sorted(set(group.values())) and stay.columns == docs.columns


def test_links_in_split_cells(spark):
    import random

    r = random.Random(3)
    values = set()
    for _ in range(20):
        v = r.getrandbits(64)
        for _ in range(25):
            values.add(v)
            v ^= 1 << r.randrange(64)
    values = list(enumerate(sorted(values)))
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    values = [(signed(v), v) for _, v in values]
    nodes = spark.createDataFrame([(i,) for i, _ in values], "fp long")
    expected = brute.components(values)
    for cell in (2048, 3, 1):
        simhash.CELL, before = cell, simhash.CELL
        try:
            got = {x.node: x.component for x in simhash.components(simhash.links(nodes)).collect()}
        finally:
            simhash.CELL = before
        assert {i: got.get(i, i) for i, _ in values} == expected


def test_near_duplicates_of_nulls_and_repeated_ids(spark):
    docs = spark.createDataFrame([(1, None), (1, None), (2, ""), (None, "a b c"), (5, "a b c")], "doc_id long, text string")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == [(-1, 5), (1, 1), (1, 1), (2, 1), (5, 5)]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    assert sorted(str(r.doc_id) for r in simhash.keep_one(docs).collect()) == ["1", "5", "None"]


def test_components_hold_together_over_rows_without_an_id(spark, monkeypatch):
    rows = [(1, "0"), (None, "111"), (3, "111111"), (4, "1" * 40), (None, "1" * 64), (6, "0"), (6, "1" * 40), (6, "1" * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")

    def local(df, text_col="text", shingle=3):  # fingerprints in plain sight: the text's bits
        return df.selectExpr("*", f"CASE WHEN length({text_col}) = 64 THEN -1 ELSE CAST(conv({text_col}, 2, 10) AS long) END AS fp").drop(text_col)

    monkeypatch.setattr(simhash, "fingerprints", local)
    got = sorted((r.doc_id or 0, r.component_id or 0) for r in simhash.near_duplicates(docs).collect())
    assert got == [(0, 0), (0, 1), (1, 1), (3, 1), (4, 4), (6, 1), (6, 4), (6, 4)]
    stay = sorted((r.doc_id or 0, r.text) for r in simhash.keep_one(docs.selectExpr("*", "1 AS fp", "2 AS id", "3 AS key", "4 AS nth")).collect())
    assert stay == [(0, "111"), (0, "1" * 64), (1, "0"), (4, "1" * 40)]


VOCABULARY = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers") + "/byte_bpe_50k.json"


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary file")
def test_bpe_matches_the_tokenizers_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    docs, rows = documents(spark)
    more = ["a<|endoftext|>b <|endoftext|>", "日本語のテキスト 🎉🎉", "ab" * 4000 + " " * 900 + "\n\n  x", "!?" * 2000, "  it's  we'll", "é" * 500]
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(1000 + i, x) for i, x in enumerate(more)], docs.select("doc_id", "text").schema))
    for r in bpe.encode_documents(docs.withColumn("ids", F.lit(1)), VOCABULARY, decoded_col="back").collect():
        assert r.ids == t.encode(r.text or "", add_special_tokens=False).ids
        assert r.back == (r.text or "")
    assert bpe.encode_documents(docs.limit(0), VOCABULARY).count() == 0


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary file")
def test_long_pieces_take_time_by_their_length():
    import time

    with open(VOCABULARY, encoding="utf-8") as f:
        codec = bpe.Codec(f.read())
    for letters in ("ab", "é", "-", "abc"):
        took = []
        for n in (100_000, 200_000):
            text = "".join(letters[i * i * 7 % 11 % len(letters)] for i in range(n))
            began = time.process_time()
            assert codec.decode(codec.encode(text)).decode() == text
            took.append(time.process_time() - began)
        assert took[1] < 3 * took[0] + 1, (letters, took)
    assert not any(len(p) > bpe.SHORT for p in codec.memo)


def test_licences(spark):
    docs, rows = documents(spark)
    got = {r.doc_id: (r.n_words, len(r.places), min([p.start for p in r.places], default=None), max([p.start for p in r.places], default=None), ",".join(r.base_labels)) for r in licenses.scan_licenses(docs.withColumn("score", F.lit("x"))).collect()}
    assert got == {r[0]: brute.licence_base(r[1]) for r in rows}
    words = licenses.TEMPLATES["mit"].split()
    cut = [(1, "head " + " ".join(words[5:40]) + " tail"), (2, " ".join(words[:20] + ["inserted", "words"] + words[20:60])), (3, " ".join(reversed(words))), (4, licenses.TEMPLATES["bsd"].upper())]
    found = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(cut, "doc_id long, text string")).collect()}
    assert found[1].labels == ["mit"] and found[2].labels == ["mit"] and found[3].labels == [] and found[4].labels == ["bsd"]
    assert (found[1].spans[0].start, found[1].spans[0].template_start) == (1, 5)
    assert found[2].spans[0].matched >= 58 and 0 < found[1].score < 1


def test_prose_with_words_of_licences_has_no_label(spark):
    prose = [
        "forecasts are provided as is, without warranty of any kind, express or implied, by the weather office",
        "the clerk will hand out, free of charge, to any person obtaining a copy of the minutes, a list of names",
        "she wrote it in the hope that it will be useful but nobody read it",
        "the above copyright notice and this permission notice hung on the wall",
        "you may obtain a copy of the license at the town hall and on an as is basis",
        "to use copy modify and or distribute this " * 50,
    ]
    whole = [(100 + n, f"words before it. {t} words after it", label) for n, (label, t) in enumerate(licenses.TEMPLATES.items())]
    found = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame([*enumerate(prose), *[x[:2] for x in whole]], "doc_id long, text string")).collect()}
    assert [found[i].labels for i in range(len(prose))] == [[]] * len(prose)
    for i, _, label in whole:
        assert found[i].labels == [label] and found[i].score > 0.8, (label, found[i].labels)
    gpl = licenses._Scanner(licenses.PHRASES, licenses.TEMPLATES, 5, 8, 16)
    again = gpl.scan(["the GNU General Public License as published " * 20_000]).to_pylist()[0]
    assert again["labels"] == ["gpl"] and len(again["places"]) == 20_000


def test_matching_statistics_against_brute_force():
    import random

    r = random.Random(5)
    for _ in range(60):
        seqs = [[r.randrange(4) for _ in range(r.randrange(1, 25))] for _ in range(3)]
        words = [r.randrange(5) for _ in range(40)]
        a = licenses.Automaton(seqs)
        runs = {tuple(s[i:j]) for s in seqs for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
        longest = [max([n for n in range(1, i + 2) if tuple(words[i + 1 - n : i + 1]) in runs], default=0) for i in range(len(words))]
        expected = [(i + 1 - n, i + 1) for i, n in enumerate(longest) if n >= 2 and (i + 1 == len(words) or longest[i + 1] != n + 1)]
        found = a.matches(words, 2)
        assert [x[:2] for x in found] == expected
        for lo, hi, s in found:
            for n, ends in a.ends[s].items():
                assert ends == [i for i in range(hi - lo, len(seqs[n]) + 1) if seqs[n][i - (hi - lo) : i] == words[lo:hi]]
            assert set(a.ends[s]) == {n for n, q in enumerate(seqs) if any(q[i : i + hi - lo] == words[lo:hi] for i in range(len(q)))}


def test_shards_are_even_and_stable(spark):
    names = [f"s{i}" for i in range(7)]
    owner = sharding.slot_owners(names, 211)
    counts = [owner.count(i) for i in range(7)]
    assert max(counts) - min(counts) <= 1 and min(owner) == 0
    fewer = sharding.slot_owners(names[:-1], 211)
    moved = sum(a != b for a, b in zip(owner, fewer) if a != 6)
    assert moved < 211 // 4
    docs = spark.createDataFrame([(None, 1), ("a", 2), ("a", 3), ("", 4)], "k string, slot int")
    got = {r.k: (r.slot, r.shard) for r in sharding.assign_shards(docs, "k", names, 211).collect()}
    for k, (slot, shard) in got.items():
        assert (slot, shard) == (None, None) if k is None else slot == int(hashlib.md5(k.encode()).hexdigest()[:15], 16) % 211 and shard == names[owner[slot]]
    for bad in ((names, 210), (["a"], 1), (["a", "a"], 211), ([], 211)):
        with pytest.raises(ValueError):
            sharding.slot_owners(*bad)
    assert sharding.slot_owners(["a"], 2) == [0, 0]
