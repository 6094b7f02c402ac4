"""Helpers shared by the operators: batch slicing and a numpy view of words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ledgerloom.session import materialize  # noqa: F401  (the operators write their tables with it)

#: Text bytes that one numpy step works on; bounds the temporaries of a Python worker.
STEP_BYTES = 1 << 20


def slices(batches: Iterator[pa.RecordBatch], column: int | str, most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts in `column` have about `most` bytes, and one row at least."""
    for b in batches:
        if not b.num_rows:
            continue
        size = np.asarray(pc.fill_null(pc.binary_length(b.column(column)), 0)).astype(np.int64)
        part = (np.cumsum(size) - size) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            yield b.slice(lo, hi - lo)


def lower_ascii(b: bytes) -> bytes:
    return b.translate(_LOWER)


_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Bytes of the words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of lower-cased text; every byte from 0x80 is part of a word.
_IN_WORD = np.array([c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 for c in range(256)])
_ODD = np.uint64(0x9E3779B97F4A7C15 | 1)
_ODD_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        have = _powers[name] = np.multiply.accumulate(steps)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads their bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """The words of some texts (lower-cased A-Z; runs of digits, a-z and non-ASCII characters), found in one numpy pass.

    `first[i]:first[i + 1]` are the words of text i; `norm` holds all words, each followed by one space, and word w
    starts at `at[w]` there. A null text has no words.
    """

    def __init__(self, texts: list[str | None]):
        encoded = [(t or "").encode("utf-8", "replace") for t in texts]
        raw = lower_ascii(b"\n".join(encoded) + b"\n")
        data = np.frombuffer(raw, np.uint8)
        inside = _IN_WORD[data]
        edge = np.diff(inside.view(np.int8), prepend=np.int8(0))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        size = np.array([len(t) for t in encoded], np.int64) + 1
        self.first = np.searchsorted(starts, np.concatenate([[0], np.cumsum(size)]))
        inside = inside.copy()
        inside[ends] = True
        self.norm = np.where(_IN_WORD[data], data, 32).astype(np.uint8)[inside]
        self.at = np.concatenate([[0], np.cumsum(ends - starts + 1)])
        self.n = len(starts)
        self._sums: np.ndarray | None = None

    def hashes(self, k: int) -> np.ndarray:
        """A 64-bit hash of each run of k consecutive words (runs across texts included; see `run_ok`)."""
        if self.n < k:
            return np.zeros(0, np.uint64)
        if self._sums is None:
            b = (self.norm.astype(np.uint64) + np.uint64(1)) * _power("up", _ODD, len(self.norm))
            self._sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(b, dtype=np.uint64)])[self.at]
        span = self._sums[k:] - self._sums[:-k]
        return mix(span * _power("down", _ODD_INVERSE, len(self.norm) + 1)[self.at[: self.n - k + 1]])

    def text_of(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def run(self, w: int, k: int) -> bytes:
        """The words w to w + k - 1, space-joined."""
        return self.norm[self.at[w] : self.at[w + k] - 1].tobytes()


class HashSet:
    """Sorted 64-bit values with a bitmap in front, for testing long arrays."""

    def __init__(self, values: np.ndarray):
        self.values = np.unique(values)
        self._bits = max(16, int(np.ceil(np.log2(max(1, len(self.values))))) + 4)
        self._map = np.zeros(1 << self._bits, bool)
        self._map[(self.values >> np.uint64(64 - self._bits)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where h has a member, and that member's number."""
        at = np.flatnonzero(self._map[(h >> np.uint64(64 - self._bits)).astype(np.int64)])
        if not len(self.values) or not len(at):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        i = np.minimum(np.searchsorted(self.values, h[at]), len(self.values) - 1)
        ok = self.values[i] == h[at]
        return at[ok], i[ok]


def held(df: DataFrame, **columns) -> DataFrame:
    """df with columns that are computed once for each row, however often later expressions (lambdas too) name them."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


class Carried:
    """The columns of docs that pass through an operator: under numbers inside it, so that no name can clash.

    Columns of docs named as the operator's results (in any case) are replaced by these.
    """

    def __init__(self, docs: DataFrame, results: tuple[str, ...] | list[str] = ()):
        named = {r.lower() for r in results}
        fields = [f for f in docs.schema.fields if f.name.lower() not in named]
        self.names = [f"own{i}" for i in range(len(fields))]
        #: To select from docs, and to select again from what the operator made.
        self.into: list[Column] = [F.col("`" + f.name.replace("`", "``") + "`").alias(n) for f, n in zip(fields, self.names)]
        self.back: list[Column] = [F.col(n).alias(f.name) for f, n in zip(fields, self.names)]
        self.of = dict(zip((f.name for f in fields), self.names))
        self.schema = StructType([StructField(n, f.dataType) for f, n in zip(fields, self.names)])


def byte_classes(gaps: bytes, breaks: bytes = b"", lower: bool = True) -> bytes:
    """A table for `Coded`: which bytes stand between words (as spaces) and which end a piece (as line feeds)."""
    keep = _LOWER if lower else bytes(range(256))
    return bytes(10 if c in breaks else 32 if c in gaps else keep[c] for c in range(256))


class Coded:
    """The words of some texts as numbers: word w is `code[w]`, and `names[c]` is code c's word, followed by one space.

    `first[i]:first[i + 1]` are the words of text i and `piece[w]` tells the piece that word w stands in. A null text has
    no words. Codes are exact (Arrow's dictionary) and hold for these texts only.
    """

    def __init__(self, texts: pa.Array | pa.ChunkedArray, table: bytes):
        column = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
        encoded = [t or b"" for t in column.cast(pa.binary()).to_pylist()]
        data = np.frombuffer((b"\n".join(encoded) + b"\n").translate(table), np.uint8).copy()
        inside = (data != 32) & (data != 10)
        size = np.array([len(t) for t in encoded], np.int64) + 1
        stop = np.cumsum(size)
        inside[stop - 1] = False  # where one text ends and the next one starts
        edge = np.diff(inside.view(np.int8), prepend=np.int8(0))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.first = np.searchsorted(starts, np.concatenate([[0], stop]))
        broken = data == 10
        broken[stop - 1] = True
        self.piece = np.cumsum(broken, dtype=np.int32)[starts]
        inside[ends] = True
        data[ends] = 32
        self.data = data[inside]
        self.at = np.concatenate([[0], np.cumsum(ends - starts + 1)])
        coded = binaries(self.data, self.at).dictionary_encode()
        self.code, self.names = np.asarray(coded.indices).astype(np.int64), coded.dictionary
        self.n = len(starts)

    def text_of(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def words(self) -> pa.Array:
        """The word of each code."""
        return pc.binary_slice(self.names, 0, -1)


def binaries(data: np.ndarray, at: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """An Arrow array whose value i is data[at[i]:at[i + 1]], without a copy of the bytes."""
    return pa.Array.from_buffers(kind or pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)])


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows that stand for counts[i] rows each: the row of each, and its number within that row."""
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
