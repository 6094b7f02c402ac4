import random

import brute
import numpy as np
import pytest
from data import texts

from ledgerloom.llm import repeats


def result(df):
    return sorted((r.doc_id, r.n_bytes, sum(s.hi - s.lo for s in r.removed), len(r.removed), brute.sha(bytes(r.kept))) for r in df.collect())


@pytest.mark.parametrize("hot,shard,frequent", [(20_000, 4 << 20, 100), (1, 4 << 20, 100), (20_000, 300, 100), (20_000, 4 << 20, 3)])
def test_matches_brute_force(spark, hot, shard, frequent):
    r = random.Random(11)
    rows = list(enumerate(texts(60, 3)))
    passage = " ".join(f"w{r.randrange(99)}" for _ in range(60))
    for n in range(30):
        rows.append((len(rows), " ".join(f"v{r.randrange(999)}" for _ in range(r.randrange(40))) + passage[r.randrange(60) : 200 + r.randrange(30)] + f" {n}"))
    rows += [(len(rows), "ab" * 400), (len(rows) + 1, "é" * 200 + "\0" * 300), (len(rows) + 2, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    before = repeats.HOT, repeats.SHARD_BYTES, repeats.FREQUENT
    repeats.HOT, repeats.SHARD_BYTES, repeats.FREQUENT = hot, shard, frequent
    texts_only = df.selectExpr("CAST(coalesce(text, '') AS binary) AS bytes")
    assert len(repeats.frequent_grams(texts_only)) > 0 or frequent > 3
    try:
        got = result(repeats.remove_repeats(df))
    finally:
        repeats.HOT, repeats.SHARD_BYTES, repeats.FREQUENT = before
    assert got == brute.repeats([(i, (t or "").encode()) for i, t in rows])


def test_shared_and_null_ids(spark):
    t = "".join(chr(97 + i * i * 7 % 26) + str(i) for i in range(90))
    df = spark.createDataFrame([(1, t), (1, t), (None, t), (0, "short"), (2, None)], "doc_id long, text string")
    got = {(r.doc_id, r.n_bytes): [(s.lo, s.hi) for s in r.removed] for r in repeats.remove_repeats(df).collect()}
    assert got == {(1, len(t)): [], (None, len(t)): [(0, len(t))], (0, 5): [], (2, 0): []}
    assert repeats.remove_repeats(df.limit(0)).count() == 0


def test_order_and_prefixes_against_sorting():
    r = random.Random(2)
    for _ in range(50):
        parts = [bytes(r.choice(b"ab\0") for _ in range(r.randrange(20, 60))) for _ in range(4)]
        data = np.frombuffer(b"".join(parts), np.uint8)
        size = np.array([len(p) for p in parts])
        starts = np.cumsum(size) - size
        left = np.repeat(starts + size, size) - np.arange(len(data))
        rank = repeats.suffix_order(data, left, 20)
        at = np.flatnonzero(left >= 20)
        order = at[np.argsort(rank[at], kind="stable")]
        b = data.tobytes()
        assert order.tolist() == sorted(at.tolist(), key=lambda i: (b[i : i + 20], i))
        prefix = repeats.common_prefixes(data, order, starts, size - 19, 20)
        for x, y in zip(order.tolist(), order[1:].tolist()):
            assert prefix[y] == next((n for n in range(20) if b[x + n] != b[y + n]), 20)
