"""Benchmark decontamination by a prefix-filtered set join over item-sized windows.

Every run of `window` words of a benchmark item (the whole item if it has fewer) is a set of word shingles that a
document must contain whole. The shingles are ordered by rarity in the corpus. At containment 1 the prefix that must be
shared is |W| - |W| + 1 = 1 shingle, the rarest, so only that one is joined with the documents' shingles. A candidate's
place fixes where its window would start (positional bound) and that it must end inside the document (length bound);
what is left is compared word for word.

Nulls and texts without words have no words and no windows. Repeated document rows are judged row by row; repeated
items count once by item id. Empty tables give no rows (no documents) or no hits (no items); columns of docs named as the
results are replaced.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Carried, HashSet, Words, materialize, slices

#: Windows (with the ids of their items) that are broadcast at once, about 200 bytes each; more are taken in several slices.
SLICE_WINDOWS = 200_000


def item_windows(items: DataFrame, item_col: str, text_col: str, window: int, shingle: int) -> DataFrame:
    """Distinct windows of the items: words (space-joined), k (their number), items, shingles (array of hashes)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            w = Words(b.column(1).to_pylist())
            out: list[tuple] = []
            for i, item in enumerate(b.column(0).to_pylist()):
                lo, hi = int(w.first[i]), int(w.first[i + 1])
                k = min(window, hi - lo)
                out += [(item, w.run(a, k).decode("utf-8", "replace"), k) for a in range(lo, hi - k + 1) if k]
            yield pa.RecordBatch.from_pylist([{"item": a, "words": t, "k": k} for a, t, k in out], schema=pa.schema([("item", pa.string()), ("words", pa.string()), ("k", pa.int32())]))

    rows = items.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(cut, "item string, words string, k int").groupBy("words", "k").agg(F.collect_set("item").alias("items"))


class _Windows:
    """One slice of the windows, as numpy arrays."""

    def __init__(self, rows: list, shingle: int):
        self.words = [r["words"].encode() for r in rows]
        self.k = np.array([r["k"] for r in rows], np.int64)
        self.items = [list(r["items"]) for r in rows]
        self.shingle = shingle
        #: For each window: the hashes of its shingles; a window below the shingle size has one, itself.
        self.of: list[np.ndarray] = []
        for r in rows:
            self.of.append(Words([r["words"]]).hashes(min(shingle, r["k"])))

    def sizes(self) -> list[int]:
        return sorted({int(min(self.shingle, k)) for k in self.k})

    def shingles(self, s: int) -> np.ndarray:
        own = [h for h, k in zip(self.of, self.k) if min(self.shingle, k) == s]
        return np.unique(np.concatenate(own)) if own else np.zeros(0, np.uint64)

    def prefixes(self, count: dict[tuple[int, int], int]) -> dict[int, tuple[HashSet, list[list[tuple[int, int]]]]]:
        """By shingle size: the rarest shingle of each window, and for each such shingle (window, offset in it)."""
        by: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for n, h in enumerate(self.of):
            s = int(min(self.shingle, self.k[n]))
            rarest = min(range(len(h)), key=lambda j: (count.get((s, int(h[j])), 0), int(h[j])))
            if count.get((s, int(h[rarest])), 0):  # a shingle that no document has rules its window out
                by.setdefault(s, {}).setdefault(int(h[rarest]), []).append((n, rarest))
        return {s: (HashSet(np.array(list(m), np.uint64)), [m[k] for k in sorted(m)]) for s, m in by.items()}


def _within(w: Words, at: np.ndarray, s: int, doc: np.ndarray) -> np.ndarray:
    return doc[at] == doc[at + s - 1]


def _document_frequency(docs: DataFrame, windows: _Windows) -> dict[tuple[int, int], int]:
    """How many places of all documents hold each benchmark shingle."""
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps({s: windows.shingles(s) for s in windows.sizes()}))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = {s: HashSet(v) for s, v in pickle.loads(shared.value).items()}
        total = {s: np.zeros(len(v.values), np.int64) for s, v in sets.items()}
        for b in slices(batches, 0):
            w = Words(b.column(0).to_pylist())
            doc = w.text_of()
            for s, known in sets.items():
                at, i = known.find(w.hashes(s))
                total[s] += np.bincount(i[_within(w, at, s, doc)], minlength=len(known.values))
        for s, n in total.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), s, np.int32)), pa.array(sets[s].values[some].view(np.int64)), pa.array(n[some])], names=["s", "h", "n"])

    found = docs.select("text").mapInArrow(count, "s int, h long, n long").groupBy("s", "h").agg(F.sum("n").alias("n"))
    return {(r.s, r.h & (1 << 64) - 1): r.n for r in found.collect()}  # at most the shingles of one slice


def _mark(docs: DataFrame, windows: _Windows, count: dict[tuple[int, int], int]) -> DataFrame:
    """docs with the words hit and the items found so far grown by this slice of the windows."""
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps((windows.prefixes(count), windows.words, windows.k, windows.items)))
    n, h, f = (docs.columns.index(c) for c in ("n_words", "hits", "found"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefixes, words, size, items = pickle.loads(shared.value)
        for b in slices(batches, 0):
            w = Words(b.column(0).to_pylist())
            doc = w.text_of()
            hit: dict[int, list[tuple[int, int]]] = {}
            seen: dict[int, set[str]] = {}
            for s, (known, places) in prefixes.items():
                at, i = known.find(w.hashes(s))
                for p, j in zip(at.tolist(), i.tolist()):
                    d = int(doc[p])
                    for window, offset in places[j]:
                        a, k = p - offset, int(size[window])
                        if a >= w.first[d] and a + k <= w.first[d + 1] and w.run(a, k) == words[window]:
                            hit.setdefault(d, []).append((a - int(w.first[d]), a - int(w.first[d]) + k))
                            seen.setdefault(d, set()).update(items[window])
            hits, found = b.column(h).to_pylist(), b.column(f).to_pylist()
            for d, spans in hit.items():
                merged: list[list[int]] = []
                for lo, hi in sorted([(x["lo"], x["hi"]) for x in hits[d]] + spans):
                    if merged and lo <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], hi)
                    else:
                        merged.append([lo, hi])
                hits[d] = [{"lo": lo, "hi": hi} for lo, hi in merged]
                found[d] = sorted({*found[d], *seen[d]})
            out = b.columns
            out[n] = pa.array(np.diff(w.first).astype(np.int64))
            out[h] = pa.array(hits, b.schema.field(h).type)
            out[f] = pa.array(found, b.schema.field(f).type)
            yield pa.RecordBatch.from_arrays(out, schema=b.schema)

    return docs.mapInArrow(mark, docs.schema)


def decontaminate(docs: DataFrame, items: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13, shingle: int = 5, least_share: float = 0.05) -> DataFrame:
    """docs with n_words, n_hit, hits (word spans, end exclusive), items (ids, sorted) and contaminated added.

    n_hit counts the words inside any occurrence of a window; a document is contaminated when that is at least one word
    and `least_share` of its words. Columns of these names in docs are replaced. The windows are broadcast by slices of
    SLICE_WINDOWS; a larger benchmark takes one pass over the documents for each slice. An item without an id hits texts
    like any other, but has no place in items.
    """
    windows = materialize(item_windows(items, item_col, item_text_col, window, shingle), "windows")
    parts = -(-windows.count() // SLICE_WINDOWS)
    results = ("n_words", "n_hit", "hits", "items", "contaminated")
    own = Carried(docs, results)
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.lit(0).cast("long").alias("n_words"), F.array().cast("array<struct<lo:int,hi:int>>").alias("hits"), F.array().cast("array<string>").alias("found"), *own.into)
    for part in range(max(1, parts)):
        some = windows.where(F.pmod(F.xxhash64("words"), F.lit(max(1, parts))) == part).collect()
        known = _Windows(some, shingle)
        rows = _mark(rows, known, _document_frequency(rows, known) if some else {})
        if parts > 1:
            rows = materialize(rows, "marked")
    share = Fraction(str(least_share))
    hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, x: n + x["hi"] - x["lo"])
    found = rows.select(*own.names, "n_words", hit.alias("n_hit"), "hits", F.col("found").alias("items"))
    found = found.withColumn("contaminated", (F.col("n_hit") > 0) & (F.lit(share.denominator) * F.col("n_hit") >= F.lit(share.numerator) * F.col("n_words")))
    return found.select(*own.back, *results)


def drop_contaminated(docs: DataFrame, items: DataFrame, *, text_col: str = "text", **options) -> DataFrame:
    """The documents that are not contaminated, with their own columns, whatever these are called."""
    own = Carried(docs)
    return decontaminate(docs.select(*own.into), items, text_col=own.of[text_col], **options).where("not contaminated").select(*own.back)
