"""Byte-level BPE encoding by backtracking, and decoding by an offset table.

A text is cut at the vocabulary's special tokens and then into pieces by the byte-level pattern. In a piece an
Aho-Corasick automaton finds the longest token at each place that a token starts at, looking no further than the longest
token reaches. The encoder takes the longest token that is compatible with the
one before it, where two tokens are compatible when merging their joined bytes gives these two back; where no token fits
it takes its last token back and never again ends one there. Sequences of compatible neighbours are exactly what the
merges give, and each place is left at most once, so the time is linear. Compatibility is a table filled as pairs come
up. Decoding copies each token's bytes out of one array by its offsets.

A null text is an empty one and has no tokens. Repeated rows are encoded alike; empty tables give no rows; columns of
docs named as the results are replaced.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from .common import Carried, slices

#: Fixed value: the pattern that byte-level vocabularies of this kind were made with.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Below this code point pieces are found by an equal pattern with plain character classes, which is faster.
NEAR = 0x250


def near_pieces() -> re.Pattern:
    """PIECES for texts without a character from NEAR on, its classes written out from the Unicode categories."""

    def ranges(category: str) -> str:
        of = regex.compile(category)
        return "".join(f"\\u{c:04x}" for c in range(NEAR) if of.match(chr(c)))

    letter, number, space = ranges(r"\p{L}"), ranges(r"\p{N}"), ranges(r"\s")
    return re.compile(f" ?[{letter}]+|'(?:[stmd]|re|ve|ll)| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")


#: Entries at which a worker's memo of pieces grows old (one old memo is kept), and at which that of pairs is emptied;
#: nothing depends on it but speed.
MEMO = 400_000
#: Characters up to which a piece is remembered.
SHORT = 64


def byte_names() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1 itself, others from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class _Pieces(dict):
    """Packed ids of each piece; what is in use moves on from the old memo when a new one is begun."""

    def __init__(self, encode):
        self.encode, self.old = encode, {}

    def __missing__(self, piece: str) -> bytes:
        if len(piece) > SHORT:
            return np.array(self.encode(piece), "<i4").tobytes()
        if len(self) > MEMO:
            self.old = dict(self)
            self.clear()
        out = self.old.get(piece)
        if out is None:
            out = np.array(self.encode(piece), "<i4").tobytes()
        self[piece] = out
        return out


class Codec:
    """Encoder and decoder of one vocabulary (the content of a tokenizers JSON file)."""

    def __init__(self, content: str):
        d = json.loads(content)
        model, pre = d["model"], d["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or d["normalizer"]:
            raise ValueError("only plain byte-level BPE vocabularies are supported")
        self.vocab: dict[str, int] = model["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {p: n for n, p in enumerate(pairs)}
        self.name = byte_names()
        self.pieces, self.near, self.far = regex.compile(PIECES), near_pieces(), re.compile(f"[^\\x00-\\u{NEAR - 1:04x}]")
        self.special = {t["content"]: t["id"] for t in d["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.words = [""] * (1 + max(*self.vocab.values(), *self.special.values()))
        self.find = ahocorasick.Automaton()
        for t, i in self.vocab.items():
            self.words[i] = t
            self.find.add_word(t, i)
        self.find.make_automaton()
        byte = {c: b for b, c in enumerate(self.name)}
        raw = [bytes(byte[c] for c in t) for t in self.words]
        for t, i in self.special.items():
            raw[i] = t.encode()
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.offset = np.concatenate([[0], np.cumsum([len(t) for t in raw])])
        self.size = [len(t) for t in self.words]
        self.reach = max(self.size)
        #: The longest token that is a proper prefix of each token, or -1.
        self.shorter = [next((self.vocab[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.vocab), -1) for t in self.words]
        self.compatible: dict[tuple[int, int], bool] = {}
        self.memo = _Pieces(self.encode_piece)

    def _merged(self, parts: list[str]) -> list[str]:
        """The merges applied to a short list of symbols, lowest rank first."""
        while len(parts) > 1:
            best = min(zip(parts, parts[1:]), key=lambda p: self.rank.get(p, 1 << 60))
            if best not in self.rank:
                break
            out: list[str] = []
            for p in parts:
                if out and (out[-1], p) == best:
                    out[-1] += p
                else:
                    out.append(p)
            parts = out
        return parts

    def fits(self, a: int, b: int) -> bool:
        key = (a, b)
        known = self.compatible.get(key)
        if known is None:
            if len(self.compatible) > MEMO:
                self.compatible.clear()
            x, y = self.words[a], self.words[b]
            known = self.compatible[key] = self._merged(list(x + y)) == [x, y]
        return known

    def encode_piece(self, piece: str) -> list[int]:
        text = "".join(map(self.name.__getitem__, piece.encode()))
        if text in self.vocab and self._merged(list(text)) == [text]:
            return [self.vocab[text]]
        dead = bytearray(len(text) + 1)  # places where no token may end
        size, shorter, fits, longest, reach = self.size, self.shorter, self.compatible, self.find.iter_long, self.reach
        pos, ids, last = 0, [], -1
        i = next(longest(text[:reach]))[1]
        while True:
            if i < 0:  # nothing fits after the last token: take it back
                dead[pos] = 1
                i = ids.pop()
                pos -= size[i]
                i, last = shorter[i], ids[-1] if ids else -1
                continue
            end = pos + size[i]
            if dead[end] or last >= 0 and not ((ok := fits.get((last, i))) or ok is None and self.fits(last, i)):
                i = shorter[i]
                continue
            ids.append(i)
            if end == len(text):
                return ids
            pos, last = end, i
            i = next(longest(text[pos : pos + reach]))[1]

    def split(self, text: str) -> list[str]:
        return (self.pieces if self.far.search(text) else self.near).findall(text)

    def encode(self, text: str) -> np.ndarray:
        if self.cut is None or not any(t in text for t in self.special):
            return np.frombuffer(b"".join(map(self.memo.__getitem__, self.split(text))), "<i4")
        out = []
        for part in self.cut.split(text):
            if part in self.special:
                out.append(np.array([self.special[part]], "<i4").tobytes())
            else:
                out += map(self.memo.__getitem__, self.split(part))
        return np.frombuffer(b"".join(out), "<i4")

    def decode(self, ids: np.ndarray) -> bytes:
        lo, n = self.offset[ids], self.offset[ids + 1] - self.offset[ids]
        end = np.cumsum(n)
        return self.bytes[np.repeat(lo - end + n, n) + np.arange(end[-1] if len(end) else 0)].tobytes()


_codecs: dict[int, Codec] = {}


def encode_documents(docs: DataFrame, vocabulary: str, *, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None) -> DataFrame:
    """docs with the token ids of text_col, and with the text decoded from them if decoded_col is named.

    vocabulary is the path of a tokenizers JSON file that the driver can read; its content is broadcast (a vocabulary is
    a few MB whatever the corpus).
    """
    content = Path(vocabulary).read_text(encoding="utf-8")
    if len(content) > 64 << 20:
        raise ValueError("the vocabulary is too large to broadcast")
    shared, mark = docs.sparkSession.sparkContext.broadcast(content), hash(content)
    results = [ids_col, *([decoded_col] if decoded_col else [])]
    own = Carried(docs, results)
    decoding = bool(decoded_col)
    names = [*own.names, "ids", *(["decoded"] if decoded_col else [])]
    rows = docs.select(F.col(text_col).cast("string").alias("text"), *own.into)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if mark not in _codecs:
            _codecs[mark] = Codec(shared.value)
        codec = _codecs[mark]
        for b in slices(batches, 0):
            ids = [codec.encode(t or "") for t in b.column(0).to_pylist()]
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            out = [*b.columns[1:], pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))]
            if decoding:
                out.append(pa.array([codec.decode(x).decode("utf-8", "replace") for x in ids], pa.string()))
            yield pa.RecordBatch.from_arrays(out, names=names)

    schema = own.schema.add("ids", ArrayType(IntegerType()))
    found = rows.mapInArrow(encode, schema.add("decoded", "string") if decoded_col else schema)
    return found.select(*own.back, F.col("ids").alias(ids_col), *([F.col("decoded").alias(decoded_col)] if decoded_col else []))
