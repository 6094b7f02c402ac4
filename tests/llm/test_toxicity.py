import random
import zlib

import duckdb
import numpy as np
import pytest
from data import documents
from pyspark.sql import functions as F

from ledgerloom.llm import queries, toxicity

SF = "/root/testdata/sf0.01"
BAD, GOOD = ["vile", "ßcum", "trash"], [f"word{i}" for i in range(60)]


def corpus(n=300, seed=2):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        w = [r.choice(GOOD) for _ in range(r.randrange(5, 60))]
        toxic = int(r.random() < 0.3)
        for _ in range(r.randrange(1, 4) * toxic):
            w.insert(r.randrange(len(w)), r.choice(BAD))
        rows.append((i, " ".join(w), toxic))
    return rows


def fitted(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(3)
    return df, toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"), **options)


@pytest.mark.parametrize("block", [1, 7, 64])
def test_neighbours_are_those_of_all_cosines(monkeypatch, block):
    monkeypatch.setattr(toxicity, "BLOCK", block)
    r = np.random.default_rng(4)
    terms = [b"t%d" % i for i in range(30)]
    vectors = [(np.sort(r.choice(30, r.integers(0, 8), replace=False)), None) for _ in range(150)]
    vectors = [(t, r.integers(1, 4, len(t))) for t, _ in vectors] + [(np.array([3, 5]), np.array([1, 1]))] * 40
    index = toxicity.Index(terms, r.random(30) + 0.5, [str(i) for i in range(190)], r.random(190), vectors, 0.2)
    full = np.zeros((190, 30))
    for i, (t, n) in enumerate(vectors):
        full[i, t] = index._unit(t, n)
    for k in (1, 5, 25, 500):
        for t, n in vectors[::7]:
            q = np.zeros(30)
            q[t] = index._unit(t, n)
            cosine = np.round(full @ q, 12)
            want = sorted((i for i in range(190) if cosine[i] > 0), key=lambda i: (-cosine[i], i))[:k]
            example, got = index.nearest(t, n, k)
            assert example.tolist() == want and np.allclose(got, cosine[want])
            assert 7 not in index.nearest(t, n, k, but=7)[0]


def test_words_and_evidence(spark):
    df, index = fitted(spark, corpus())
    assert set(index.known) == {w.encode() for w in BAD}
    rows = [(1, "such VILE trash"), (2, "word1 word2"), (3, None), (4, ""), (5, "such VILE trash"), (None, "Vile")]
    out = toxicity.score_toxicity(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "7 as score", "8 as own0"), index)
    assert out.columns == ["doc_id", "text", "own0", "score", "predicted", "evidence"]
    got = {r.doc_id: r for r in out.collect()}
    assert [got[i].predicted for i in (1, 2, 3, 4, 5, None)] == [1, 0, 0, 0, 1, 1] and got[1][3:] == got[5][3:]
    assert got[2].score == got[3].score == got[4].score and not got[3].evidence
    assert [e.toxic for e in got[1].evidence] == [1.0] * 5 and got[1].evidence[0].similarity == pytest.approx(1)
    texts = {str(i): t for i, t, _ in corpus()}
    assert all("vile" in texts[e.doc_id] or "trash" in texts[e.doc_id] for e in got[1].evidence)


def test_bounds_copies_and_mixed_labels(spark):
    rows = corpus() + [(1000 + i, "copied text of trash", i % 3 != 0) for i in range(90)]
    _, index = fitted(spark, [(i, t, int(x)) for i, t, x in rows], most=20, terms=2)
    assert len(index.ids) <= 40 and len(index.known) <= 2
    _, index = fitted(spark, [(i, t, int(x)) for i, t, x in rows])
    assert sum("copied" in dict((str(i), t) for i, t, _ in rows)[d] for d in index.ids) == 1
    assert 2 / 3 in np.round(index.label, 12).tolist() or pytest.approx(2 / 3) in index.label.tolist()


def test_no_labels_one_class_empty_tables(spark):
    docs, _ = documents(spark)
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    for known in (labels, docs.selectExpr("doc_id", "0 as toxic"), docs.selectExpr("doc_id", "cast(null as int) as toxic")):
        index = toxicity.fit(docs, known)
        assert {r.predicted for r in toxicity.score_toxicity(docs, index).collect()} == {0}
    index = toxicity.fit(docs.limit(0), labels)
    assert toxicity.score_toxicity(docs.limit(0), index).count() == 0
    assert {r.predicted for r in toxicity.score_toxicity(docs, toxicity.fit(docs, docs.selectExpr("doc_id", "1 as toxic"))).collect()} == {1}


def test_held_out_documents(spark):
    rows = [r.asDict() for r in queries.op11(spark, SF).collect()]
    toxic = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{SF}/labels.parquet'").fetchall())
    ids = {d for (d,) in duckdb.sql(f"SELECT doc_id FROM '{SF}/documents.parquet'").fetchall()}
    assert {r["doc_id"] for r in rows} == ids and len(rows) == len(ids)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
        assert not any(zlib.crc32(str(e).encode()) % 5 == 0 for e in r["evidence"])
    own = [r for r in rows if r["held_out"] and r["doc_id"] in toxic]
    caught = [r["predicted"] for r in own if toxic[r["doc_id"]]]
    assert sum(caught) >= 0.4 * len(caught) and sum(r["predicted"] for r in own if not toxic[r["doc_id"]]) <= 0.03 * len(own)


def test_labels_of_held_out_rows_change_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    out = ~toxicity.held_out(F.col("doc_id"))
    scores = [toxicity.score_toxicity(docs, toxicity.fit(docs, x.where(out))).select("doc_id", "score").orderBy("doc_id").collect() for x in (labels, labels.withColumn("toxic", F.when(out, F.col("toxic")).otherwise(1 - F.col("toxic"))))]
    assert scores[0] == scores[1]
