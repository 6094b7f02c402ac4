"""Periodic runs: stretches of words that repeat one period several times.

A run is a maximal stretch of words with smallest period q and a length of at least max(least, times * q). A run of
length n overlaps its own copy one period later in n - q words, so each of its words lies in a k-gram that its document
has twice, where k is the smallest such overlap that any period allows. Words outside repeated k-grams are masked, and
only what survives is searched by the divide and conquer of Main and Lorentz: a stretch crosses exactly one dyadic
centre that is the smallest block around it, and there its extent for a period is the longest common extension to the
left and to the right. All centres of a level, over all documents of a batch, are numpy steps of their own. Extensions
are compared by prefix hashes; what they find is compared word by word, and where a hash was wrong, extended again so.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .common import Carried, Coded, _ODD, _ODD_INVERSE, _power, binaries, byte_classes, mix, slices, spread

LEAST, TIMES = 6, 4
_TABLE = byte_classes(b"\x20\x09\x0a\x0b\x0c\x0d", lower=False)
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_RUNS = ArrayType(StructType([StructField(c, LongType()) for c in ("start", "length", "period")]), False)


def gram_size(least: int = LEAST, times: int = TIMES) -> int:
    """The fewest words in which a run overlaps its copy one period later."""
    return min(max(least, times * q) - q for q in range(1, least + 1))


class _Prefixes:
    """Hashes of the prefixes of a sequence of codes."""

    def __init__(self, code: np.ndarray):
        n = len(code)
        self.code = code
        self.power = _power("up", _ODD, n + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(code.astype(np.uint64) + np.uint64(1)) * self.power[:n], dtype=np.uint64)])

    def grams(self, k: int) -> np.ndarray:
        """A hash of each k consecutive codes."""
        return mix((self.sums[k:] - self.sums[:-k]) * _power("down", _ODD_INVERSE, len(self.code) + 1)[: len(self.code) - k + 1])

    def equal(self, i: np.ndarray, q: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the n codes from i on are those from i + q on."""
        return (self.sums[i + n] - self.sums[i]) * self.power[q] == self.sums[i + q + n] - self.sums[i + q]

    def ahead(self, i: np.ndarray, q: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many codes (at most `most`) from i on are those from i + q on."""
        return _largest(most, lambda n: self.equal(i, q, n))

    def back(self, i: np.ndarray, q: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many codes (at most `most`) that end before i are those that end before i + q."""
        return _largest(most, lambda n: self.equal(i - n, q, n))


class _Plain:
    """The same by comparing codes one after another."""

    def __init__(self, code: np.ndarray):
        self.code = code

    def ahead(self, i: np.ndarray, q: np.ndarray, most: np.ndarray) -> np.ndarray:
        c = self.code
        return np.array([np.argmin(np.append(c[a : a + n] == c[a + d : a + d + n], False)) for a, d, n in zip(i, q, most)], np.int64)

    def back(self, i: np.ndarray, q: np.ndarray, most: np.ndarray) -> np.ndarray:
        c = self.code
        return np.array([np.argmin(np.append((c[a - n : a] == c[a + d - n : a + d])[::-1], False)) for a, d, n in zip(i, q, most)], np.int64)


def _largest(most: np.ndarray, ok: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    lo, hi = np.zeros_like(most), most.copy()
    for _ in range(int(most.max(initial=0)).bit_length()):
        mid = (lo + hi + 1) >> 1
        good = ok(mid)
        lo, hi = np.where(good, mid, lo), np.where(good, hi, mid - 1)
    return lo


def _segments(hashes: _Prefixes, text: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Where words stand side by side that lie in k-grams their text has twice or more, if `least` words or longer."""
    n = len(text)
    none = np.zeros(0, np.int64)
    if n < k:
        return none, none
    at = np.flatnonzero(text[: n - k + 1] == text[k - 1 :])
    gram = mix(hashes.grams(k)[at] + text[at].astype(np.uint64) * _ODD)
    order = np.argsort(gram, kind="stable")
    same = gram[order][1:] == gram[order][:-1]
    again = np.zeros(len(at), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, at[again], 1)
    np.add.at(step, at[again] + k, -1)
    kept = np.cumsum(step)[:n] > 0
    starts = np.flatnonzero(kept & np.concatenate([[True], ~kept[:-1] | (text[1:] != text[:-1])]))
    stops = np.flatnonzero(kept & np.concatenate([~kept[1:] | (text[1:] != text[:-1]), [True]])) + 1
    long = stops - starts >= least
    return starts[long], stops[long]


def _crossing(reach, code: np.ndarray, lo: np.ndarray, hi: np.ndarray, least: int, times: int) -> np.ndarray:
    """(start, stop, period) of the runs within segments lo:hi, each row once."""
    inside = np.full(len(code) + 1, -1, np.int64)
    for_each, nth = spread(hi - lo)
    inside[lo[for_each] + nth] = for_each
    found, half = [], 1
    while half * 2 < least:
        half *= 2
    half = max(1, half // 2)
    while half < len(code):
        m = np.arange(half, len(code), 2 * half)
        m = m[(inside[m] >= 0) & (inside[m] == inside[m - 1])]
        a, b = lo[inside[m]], hi[inside[m]]
        most = (np.minimum(b, m + half) - np.maximum(a, m - half)) // times
        row, q = spread(np.maximum(most, 0))
        m, a, b, q = m[row], a[row], b[row], q + 1
        # a run of four periods has two of them on one side of the centre
        right = np.flatnonzero(m + 2 * q <= b)
        right = right[(code[m[right]] == code[m[right] + q[right]]) & (code[m[right] + q[right] - 1] == code[m[right] + 2 * q[right] - 1])]
        left = np.flatnonzero(m - 2 * q >= a)
        left = left[(code[m[left] - 1] == code[m[left] - 1 - q[left]]) & (code[m[left] - q[left]] == code[m[left] - 2 * q[left]])]
        if len(right):
            i, d = m[right], q[right]
            more = reach.ahead(i, d, b[right] - i - d)
            ok = more >= d
            i, d, more, floor = i[ok], d[ok], more[ok], a[right][ok]
            found.append(np.stack([i - reach.back(i, d, i - floor), i + d + more, d], 1))
        if len(left):
            i, d = m[left], q[left]
            less = reach.back(i - d, d, i - d - a[left])
            ok = less >= d
            i, d, less, roof = i[ok], d[ok], less[ok], b[left][ok]
            found.append(np.stack([i - d - less, i + reach.ahead(i - d, d, roof - i), d], 1))
        half *= 2
    runs = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    runs = runs[runs[:, 1] - runs[:, 0] >= np.maximum(least, times * runs[:, 2])]
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    runs = runs[np.concatenate([[True], (runs[1:, :2] != runs[:-1, :2]).any(1)])] if len(runs) else runs
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def find_in(code: np.ndarray, text: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """(start, stop, period) of all runs in the words `code` of texts `text`, by start, then period."""
    if times < 4:
        raise ValueError("runs of fewer than four periods need not have two of them on one side of a centre")
    hashes = _Prefixes(code)
    lo, hi = _segments(hashes, text, gram_size(least, times), least)
    runs = _crossing(hashes, code, lo, hi, least, times)
    row, nth = spread(runs[:, 1] - runs[:, 0] - runs[:, 2])
    at = runs[row, 0] + nth
    if not np.array_equal(code[at], code[at + runs[row, 2]]):  # a hash was wrong
        runs = _crossing(_Plain(code), code, lo, hi, least, times)
    return runs


def _columns(texts: pa.Array, least: int, times: int) -> list[pa.Array]:
    words = Coded(texts, _TABLE)
    text = words.text_of()
    runs = find_in(words.code, text, least, times)
    step = np.zeros(words.n + 1, np.int64)
    np.add.at(step, runs[:, 0] + runs[:, 2], 1)
    np.add.at(step, runs[:, 1], -1)
    kept = np.cumsum(step)[: words.n] == 0
    of = text[runs[:, 0]] if len(runs) else np.zeros(0, np.int64)
    values = pa.StructArray.from_arrays([pa.array(runs[:, 0] - words.first[of]), pa.array(runs[:, 1] - runs[:, 0]), pa.array(runs[:, 2])], fields=list(_RUN))
    listed = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(len(texts) + 1)).astype(np.int32)), values)
    size = np.diff(words.at)
    stays = np.repeat(kept, size)
    ends = np.flatnonzero(kept)
    last = ends[np.flatnonzero(np.diff(text[ends], append=-1))]
    stays[words.at[last + 1] - 1] = False  # no space after a text's last word
    total = np.concatenate([[0], np.cumsum(stays)])
    return [pa.array(np.diff(words.first)), listed, binaries(words.data[stays], total[words.at[words.first]], pa.string())]


def collapse_runs(docs: DataFrame, text_col: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """docs with n_words, runs (start, length, period by start, then period; words from 0) and collapsed.

    Words are what stands between spaces, tabs and the line ends \\x0A to \\x0D. collapsed is the text's words, joined by
    one space, without those that a run has after its first period. Columns of these names are replaced, others pass.
    A null or empty text has no words: no runs, and collapsed is empty. Each text is judged by itself and as it is
    (repeated rows too), so rows come out one by one in any order. Memory follows the longest text, some 100 bytes a word.
    """
    own = Carried(docs, ["n_words", "runs", "collapsed"])
    at = own.of[text_col]
    schema = StructType([*own.schema.fields, StructField("n_words", LongType()), StructField("runs", _RUNS), StructField("collapsed", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, at):
            made = _columns(b.column(at), least, times)
            yield pa.RecordBatch.from_arrays([*b.columns, *made], names=schema.fieldNames())

    rows = docs.select(*own.into).mapInArrow(run, schema)
    return rows.select(*own.back, "n_words", "runs", "collapsed")
