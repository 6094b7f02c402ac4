"""Phrase collocations: frequent runs of two or three words, mined by pivots.

Each phrase is owned by its rarest word, its pivot (the first one, if that word comes again). A text's pieces are
rewritten for each word w: what is left are w's places with up to two words on either side, cut where a piece ends, where
a word is too rare for any frequent phrase and where a word is rarer than w. These fragments meet by pivot, and a task
counts, pivot by pivot, the phrases that cover the pivot's place: no phrase is counted at two pivots, and none needs a
second exchange. Rarity is judged by a count-min table of the words' counts, which has a fixed size however many words
there are. It never counts a word too low, so what is cut is rare indeed, and as it is one order for all tasks, results
don't depend on how well it fits. A pivot with more than `hot` places would make a large group: it consists of commoner
words only, so its phrases repeat and are summed in each task and dealt phrase by phrase.

Scores are integers: a * a * 1000000 is compared with l * r in decimals of 38 digits, exact for counts below 10^15.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Coded, binaries, byte_classes, materialize, slices, spread

#: Cells of each of the two rows of the count-min table; places from which on a pivot is dealt phrase by phrase.
CELLS, HOT = 1 << 21, 100_000
#: Parts in which each language is ranked before the ranking of all of it.
PARTS = 64
#: Bytes of text that are coded at once.
CHUNK = 1 << 22
_TABLE = byte_classes(b" \t", b".,;:!?\n\x0b\x0c\r")
#: Fragments stand line by line, with a form feed in the pivot's place: texts have neither within words.
_FRAGMENTS = byte_classes(b" ", b"\n", lower=False)
_PIVOT = b"\x0c "


def _by_lang(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Array]]:
    """(lang, texts) with all texts of a slice that have one language."""
    for b in slices(batches, 1, CHUNK):
        langs = b.column(0).dictionary_encode()
        for i, lang in enumerate(langs.dictionary.to_pylist()):
            yield lang, b.column(1).filter(pa.array(np.asarray(langs.indices) == i))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for lang, texts in _by_lang(batches):
        words = Coded(texts, _TABLE)
        n = len(words.names)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), words.words(), pa.array(np.bincount(words.code, minlength=n))], names=["lang", "word", "n"])


def _table(frequent: DataFrame, cells: int) -> np.ndarray:
    """The count-min table: two rows of sums, by two halves of each word's hash."""
    h = F.xxhash64("lang", "word")
    halves = F.array(h.bitwiseAND(F.lit(cells - 1)), F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(cells - 1)) + cells)
    sums = frequent.select(F.explode(halves.cast("array<int>")).alias("cell"), "n").groupBy("cell").agg(F.least(F.sum("n"), F.lit(2**31 - 1)).cast("int").alias("n")).toArrow()
    table = np.zeros(2 * cells, np.int32)
    table[np.asarray(sums["cell"])] = np.asarray(sums["n"])
    return table


def _ranks(lang: str, words: pa.Array, table: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The rank of each word, rarest first (-1: in no frequent phrase), and its count by the table."""
    seed = xxhash.xxh64_intdigest(lang, 42)
    h = np.array([xxhash.xxh64_intdigest(w, seed) for w in words.to_pylist()], np.uint64)
    cells = len(table) // 2
    low, high = (h & np.uint64(cells - 1)).astype(np.int64), ((h >> np.uint64(32)) & np.uint64(cells - 1)).astype(np.int64) + cells
    count = np.minimum(table[low], table[high])
    rank = np.empty(len(words), np.int64)
    rank[np.lexsort((h, count))] = np.arange(len(words))
    return np.where(count >= least, rank, -1), count


def _grouped(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first row of each group of equal rows (sorted by the columns, first one first), and the groups' sizes."""
    order = np.lexsort(columns[::-1])
    new = np.ones(len(order), bool)
    if len(order) > 1:
        new[1:] = np.any([c[order][1:] != c[order][:-1] for c in columns], axis=0)
    first = np.flatnonzero(new)
    return order[first], np.diff(np.append(first, len(order)))


def _lines(names: pa.Array, seq: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Texts of counts[i] names each, one after another from seq, each name followed by one space."""
    taken = names.take(pa.array(seq))
    at = np.frombuffer(taken.buffers()[1], np.int32, len(seq) + 1, 0).astype(np.int64) if len(seq) else np.zeros(1, np.int64)
    return binaries(np.frombuffer(taken.buffers()[2] or b"", np.uint8), at[np.concatenate([[0], np.cumsum(counts)])])


def _phrases(of: np.ndarray, code: np.ndarray, at: np.ndarray, l1: np.ndarray, l2: np.ndarray, r1: np.ndarray, r2: np.ndarray) -> tuple[np.ndarray, ...]:
    """(of, a, b, c) of all phrases that cover the places `at`: groups and the codes of two or three (c >= 0) words."""
    parts = []
    for ok, lo, size in ((l1, -1, 2), (r1, 0, 2), (l2, -2, 3), (l1 & r1, -1, 3), (r2, 0, 3)):
        p = at[ok] + lo
        parts.append((of[ok], code[p], code[p + 1], code[p + 2] if size == 3 else np.full(len(p), -1)))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _spoken(names: pa.Array, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> pa.Array:
    size = np.where(c >= 0, 3, 2)
    seq = np.stack([a, b, c], 1).ravel()
    return pc.binary_slice(_lines(names, seq[seq >= 0], size), 0, -1)


_ROUTED = "lang string, route binary, fragments binary, n long"


def _route(batches: Iterator[pa.RecordBatch], table: np.ndarray, least: int, hot: int) -> Iterator[pa.RecordBatch]:
    """For each pivot its fragments, for a hot one its phrases with their counts."""
    for lang, texts in _by_lang(batches):
        words = Coded(texts, _TABLE)
        if not words.n:
            continue
        rank, count = _ranks(lang, words.words(), table, least)
        code, piece = words.code, words.piece
        r = rank[code]
        pad = np.full(2, -2)
        around, where = np.concatenate([pad, r, pad]), np.concatenate([pad, piece, pad])
        beside = lambda d: where[2 + d : 2 + d + words.n] == piece
        l1 = beside(-1) & (around[1 : 1 + words.n] > r)
        l2 = l1 & beside(-2) & (around[: words.n] > r)
        r1 = beside(1) & (around[3 : 3 + words.n] >= r)
        r2 = r1 & beside(2) & (around[4:] >= r)
        at = np.flatnonzero((r >= 0) & (l1 | r1))
        is_hot = count[code[at]] > hot
        if is_hot.any():
            p = at[is_hot]
            _, a, b, c = _phrases(code[p], code, p, l1[p], l2[p], r1[p], r2[p])
            first, times = _grouped(a, b, c)
            yield _routed(lang, _spoken(words.names, a[first], b[first], c[first]), pa.nulls(len(first), pa.binary()), times)
        p = at[~is_hot]
        if len(p):
            p = p[np.argsort(code[p], kind="stable")]
            left, right = l1[p].astype(np.int64) + l2[p], r1[p].astype(np.int64) + r2[p]
            row, nth = spread(left + right + 2)
            pivot, end = len(words.names), len(words.names) + 1
            seq = code[np.minimum(p[row] - left[row] + nth, words.n - 1)]
            seq[nth == left[row]] = pivot
            seq[nth == (left + right + 1)[row]] = end
            names = pa.concat_arrays([words.names, pa.array([_PIVOT, b"\n"], pa.binary())])
            new = np.flatnonzero(np.diff(code[p], prepend=-1))
            sizes = np.add.reduceat(left + right + 2, new)
            yield _routed(lang, pc.binary_slice(words.names.take(pa.array(code[p[new]])), 0, -1), _lines(names, seq, sizes), np.zeros(len(new), np.int64))


def _routed(lang: str, routes: pa.Array, fragments: pa.Array, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(routes), pa.string()), routes, fragments, pa.array(n)], names=["lang", "route", "fragments", "n"])


def _mine(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """The frequent phrases of rows sorted by lang and route: of each pivot's fragments, or summed for a hot one."""
    held: list[tuple[str, bytes, list[bytes], int]] = []
    size = 0
    for b in batches:
        if not b.num_rows:
            continue
        langs, routes = (np.asarray(c.dictionary_encode().indices) for c in b.columns[:2])
        new = np.flatnonzero(np.concatenate([[True], (langs[1:] != langs[:-1]) | (routes[1:] != routes[:-1])]))
        sums = np.add.reduceat(np.asarray(b.column(3)), new).tolist()
        for lo, hi, n in zip(new.tolist(), [*new[1:].tolist(), b.num_rows], sums):
            key = b.column(0)[lo].as_py(), b.column(1)[lo].as_py()
            text = b"".join(pc.drop_null(b.column(2).slice(lo, hi - lo)).to_pylist())
            if not held or held[-1][:2] != key:
                if size > CHUNK:
                    yield from _counted(held, least)
                    held, size = [], 0
                held.append((*key, [], 0))
            if text:
                held[-1][2].append(text)
            else:
                held[-1] = (*held[-1][:3], held[-1][3] + n)
            size += len(text) + 8
    yield from _counted(held, least)


def _counted(held: list[tuple[str, bytes, list[bytes], int]], least: int) -> Iterator[pa.RecordBatch]:
    langs, found, counts = [], [], []
    for lang, route, texts, n in held:
        if not texts and n >= least:
            langs.append(lang), found.append(route), counts.append(n)
    cold = [(lang, route, texts) for lang, route, texts, _ in held if texts]
    if cold:
        words = Coded(pa.array([b"".join(texts) for *_, texts in cold], pa.binary()), _FRAGMENTS)
        at = np.flatnonzero(words.code == pc.index(words.names, _PIVOT).as_py())
        pad = np.full(2, -2)
        where = np.concatenate([pad, words.piece, pad])
        beside = [where[2 + d + at] == words.piece[at] for d in (-2, -1, 1, 2)]
        of, a, b, c = _phrases(words.text_of()[at], words.code, at, beside[1], beside[0], beside[2], beside[3])
        first, times = _grouped(of, a, b, c)
        first, times = first[times >= least], times[times >= least]
        for i, text, n in zip(of[first].tolist(), _spoken(words.names, a[first], b[first], c[first]).to_pylist(), times.tolist()):
            lang, route, _ = cold[i]
            langs.append(lang), found.append(b" ".join(route if w == _PIVOT[:-1] else w for w in text.split(b" "))), counts.append(n)
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(found, pa.binary()), pa.array(counts, pa.int64())], names=["lang", "phrase", "a"])


def word_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, word, n): how often each language has each word; a null language is `und`."""
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text")).where("text is not null")
    return rows.mapInArrow(_count_words, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def frequent_phrases(docs: DataFrame, frequent: DataFrame, least: int = 10, cells: int = CELLS, hot: int = HOT, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, phrase, a): phrases of two or three words that a language has `least` times or more, by pivots.

    frequent: (lang, word, n) with all words that occur so often.
    """
    if cells & (cells - 1) or least < 1:
        raise ValueError("cells must be a power of two and least at least one")
    table = docs.sparkSession.sparkContext.broadcast(_table(frequent, cells))
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text")).where("text is not null")
    routed = rows.mapInArrow(lambda x: _route(x, table.value, least, hot), _ROUTED)
    met = routed.repartition("lang", "route").sortWithinPartitions("lang", "route")
    return met.mapInArrow(lambda x: _mine(x, least), "lang string, phrase binary, a long")


def _part(phrase: Column, lo: int, size: Column | int) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), lo, size), " ")


def mine_phrases(docs: DataFrame, top: int = 2000, least: int = 10, cells: int = CELLS, hot: int = HOT, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Each language's best `top` collocations: lang, rank, phrase, a, l, r, n, score.

    Text is lower-cased (A-Z), split at . , ; : ! ? and line ends into pieces, and these at spaces and tabs into words.
    a counts a phrase's places, l and r those of its two parts at the cut that scores lowest (the first of equals), n all
    words of the language; score is floor(1000000 * a * a / (l * r)). A phrase goes if a longer candidate around it has
    half its count or more. Ties are ranked by a, then by the phrase's bytes. Null texts have no words, a null language is
    `und`; documents count as often as they come. Without candidates there are no rows, and other columns are ignored.
    """
    counted = materialize(word_counts(docs, text_col, lang_col), "phrase-words")
    total = counted.groupBy("lang").agg(F.sum("n").alias("n"))
    words = counted.where(F.col("n") >= least)
    found = materialize(frequent_phrases(docs, words, least, cells, hot, text_col, lang_col).select("lang", F.col("phrase").cast("string").alias("phrase"), "a"), "phrases")
    size = F.size(F.split("phrase", " "))
    longer = found.where(size == 3).select("lang", F.explode(F.array(_part(F.col("phrase"), 1, 2), _part(F.col("phrase"), 2, 2))).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    free = found.join(longer, ["lang", "phrase"], "left").where("around is null or 100 * around < 50 * a").select("lang", "phrase", "a")
    cut = F.explode(F.sequence(F.lit(1), size - 1)).alias("k")
    cuts = free.select("lang", "phrase", "a", size.alias("size"), cut).select("*", _part(F.col("phrase"), 1, F.col("k")).alias("head"), F.array_join(F.slice(F.split("phrase", " "), F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("rest"))
    known = words.select("lang", F.col("word").cast("string").alias("part"), F.col("n").alias("times")).unionByName(found.where(size == 2).select("lang", F.col("phrase").alias("part"), F.col("a").alias("times")))
    l, r = (known.select("lang", F.col("part").alias(p), F.col("times").alias(c)) for p, c in (("head", "l"), ("rest", "r")))
    wide = lambda c: F.col(c).cast("decimal(15,0)")
    score = F.call_function("div", wide("a") * wide("a") * F.lit(1000000).cast("decimal(7,0)"), wide("l") * wide("r"))
    scored = cuts.join(l, ["lang", "head"]).join(r, ["lang", "rest"]).withColumn("score", score.cast("long"))
    least_cut = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("x")).select("lang", "phrase", "a", "x.l", "x.r", "x.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    in_part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).orderBy(*order)
    best = least_cut.withColumn("rank", F.row_number().over(in_part)).where(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(F.broadcast(total), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
