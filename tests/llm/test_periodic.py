import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from data import documents

from ledgerloom.llm import periodic, queries

SF = "/root/testdata/sf0.001"


def brute(w, least=6, times=4):
    """Runs of w by looking at each period."""
    best = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i + q - s >= max(least, times * q):
                best.setdefault((s, i + q), q)
            i += 1
    return sorted(((s, e - s, q) for (s, e), q in best.items()), key=lambda x: (x[0], x[2]))


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def planted(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def sequences():
    r = random.Random(5)
    for _ in range(400):
        n, k = r.randrange(0, 100), r.choice([1, 2, 2, 3, 6])
        w = [r.randrange(k) for _ in range(n)]
        if n > 8 and r.random() < 0.7:
            a = r.randrange(n)
            p = 1 + r.randrange((n - a) // 4 + 1)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        yield w
    fib = ["a", "ab"]
    while len(fib[-1]) < 400:
        fib.append(fib[-1] + fib[-2])
    yield [ord(c) for c in fib[-1]]
    yield [bin(i).count("1") % 2 for i in range(512)]  # Thue-Morse, which has no run and misleads power sums
    yield [bin(i % 128).count("1") % 2 for i in range(1024)]
    yield [0] * 700


def test_gram_size_is_the_smallest_overlap():
    assert periodic.gram_size() == 5 == min(max(6, 4 * q) - q for q in range(1, 1000))
    assert periodic.gram_size(20, 4) == min(max(20, 4 * q) - q for q in range(1, 1000))


@pytest.mark.parametrize("misled", [False, True])
def test_runs_are_those_of_every_period(monkeypatch, misled):
    if misled:  # hashes that find everything equal: what they find is compared, and found again by words
        monkeypatch.setattr(periodic._Prefixes, "equal", lambda self, i, q, n: np.ones(len(i), bool))
    for w in sequences():
        got = periodic.find_in(np.array(w, np.int64), np.zeros(len(w), np.int64))
        assert [(s, e - s, q) for s, e, q in got.tolist()] == brute(w), w


def test_texts_of_a_batch_are_apart():
    words = list(sequences())
    code, text = np.concatenate([np.array(w, np.int64) for w in words]), np.repeat(np.arange(len(words)), [len(w) for w in words])
    first = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    want = [(s + first[i], s + first[i] + n, q) for i, w in enumerate(words) for s, n, q in brute(w)]
    assert [tuple(x) for x in periodic.find_in(code, text).tolist()] == want


def test_query_over_its_table(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    got = {r.doc_id: r for r in queries.op13(spark, SF).collect()}
    some = 0
    for i, text in rows:
        w = planted(i, text)
        runs = brute(w)
        some += bool(runs)
        best = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=(None, None, None))
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert tuple(got[i]) == (i, len(runs), *best, best[1] and 1000 * best[1] // best[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(collapsed(w, runs)))
    assert some > 5 and len(got) == len(rows)


def test_odd_rows_and_columns(spark):
    docs, rows = documents(spark)
    rows = [*[(r[0], r[1]) for r in rows], (500, "a b " * 4000), (501, "a b " * 4000), (502, "é " * 6), (None, "x x x x x x y"), (503, "\x85 " * 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as runs", "2 as `a.b`", "3 as own0").repartition(3)
    out = periodic.collapse_runs(df)
    assert out.columns == ["doc_id", "text", "a.b", "own0", "n_words", "runs", "collapsed"]
    got = sorted(((r.doc_id, r.text, r.n_words, [tuple(x) for x in r.runs], r.collapsed, r["a.b"]) for r in out.collect()), key=str)
    want = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        runs = brute(w)
        want.append((i, t, len(w), runs, collapsed(w, runs), 2))
    assert got == sorted(want, key=str)
    assert periodic.collapse_runs(df.limit(0)).count() == 0
