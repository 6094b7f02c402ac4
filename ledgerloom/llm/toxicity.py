"""Toxicity by the nearest labelled examples.

Examples are texts with labels: at most `most` toxic and `most` clean ones (the ones with the smallest hashes of their
texts; copies of one text are one example with their mean label). Words are terms if toxic examples
have them twice as often, best by chi-squared (at most `terms` of them); their document frequencies come from all documents. An example or document is its TF-IDF vector over these terms, of length one.

The index lists each term's examples in blocks, with the largest weight of each block. A document bounds its cosine with
all examples of a block by these maxima, opens blocks from the largest bound down, and stops when its k-th neighbour is
above all bounds that are left: the k nearest are exact. Neighbours vote by their distance, and a logistic curve, fitted
to the votes that examples get from the other ones and weighted by how frequent the classes are, makes votes scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from .common import Carried, Coded, byte_classes, materialize, slices, spread

#: Bounds of what is fitted: examples of each class, and terms.
MOST, TERMS = 4000, 4096
#: Terms stand in so many examples and mark the toxic ones so well (chi-squared).
LEAST, TELLING, OFTENER = 5, 15.0, 2.0
#: Neighbours that vote, examples in a block, blocks opened first (then twice as many), what a distance of zero counts as.
NEIGHBOURS, BLOCK, OPENED, NEAR = 25, 64, 4, 0.05
#: Votes that stand for doubt, in terms of one neighbour's at no distance.
DOUBT = 0.1
CHUNK = 1 << 22
_WORD = b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
_TABLE = byte_classes(bytes(c for c in range(128) if c not in _WORD))


def _occurrences(texts: pa.Array, known: dict[bytes, int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(text, term, times) by text and term, of the known terms or of all words; and the words."""
    words = Coded(texts, _TABLE)
    names, text, term = words.words(), words.text_of(), words.code
    if known is not None:
        number = np.array([known.get(w, -1) for w in names.to_pylist()], np.int64)
        term = number[term] if words.n else term
        text, term = text[term >= 0], term[term >= 0]
    most = len(names) if known is None else len(known)
    pairs, times = np.unique(text * max(most, 1) + term, return_counts=True)
    return pairs // max(most, 1), pairs % max(most, 1), times, names


class Index:
    """Examples' vectors by term and block, and what makes scores of votes. `terms` has each term's inverse frequency."""

    def __init__(self, terms: list[bytes], idf: np.ndarray, ids: list[str], label: np.ndarray, vectors: list[tuple[np.ndarray, np.ndarray]], base: float):
        self.known, self.idf, self.ids, self.label, self.base = {t: i for i, t in enumerate(terms)}, idf, ids, label, base
        self.blocks = -(-len(ids) // BLOCK)
        example = np.repeat(np.arange(len(ids)), [len(t) for t, _ in vectors])
        term = np.concatenate([t for t, _ in vectors]) if vectors else np.zeros(0, np.int64)
        weight = np.concatenate([self._unit(t, n) for t, n in vectors]) if vectors else np.zeros(0)
        key = example // BLOCK * len(terms) + term
        order = np.lexsort((example, key))
        self.start = np.searchsorted(key[order], np.arange(self.blocks * len(terms) + 1))
        self.place, self.weight = (example % BLOCK)[order], weight[order]
        self.most = np.zeros((len(terms), self.blocks))
        np.maximum.at(self.most, (term, example // BLOCK), weight)
        self.slope, self.lift = 0.0, float(np.log(base / (1 - base)))

    def _unit(self, terms: np.ndarray, times: np.ndarray) -> np.ndarray:
        w = (1 + np.log(times)) * self.idf[terms]
        return w / np.sqrt((w * w).sum()) if len(w) else w

    def nearest(self, terms: np.ndarray, times: np.ndarray, k: int = NEIGHBOURS, but: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples (without `but`) of the largest cosines above zero, and these; of equal ones the first."""
        w = self._unit(terms, times)
        found, cosines, kth, have, done, size = [], [], 0.0, 0, 0, OPENED
        bound = w @ self.most[terms] if len(terms) and self.blocks else np.zeros(0)
        order = np.argsort(-bound, kind="stable")
        order = order[: np.count_nonzero(bound > 0)]
        while done < len(order) and (have < k or bound[order[done]] >= kth - 1e-9):
            opened = order[done : done + size]
            opened = opened[bound[opened] >= (kth - 1e-9 if have >= k else 0)]
            key = (opened[:, None] * len(self.idf) + terms).ravel()
            lo = self.start[key]
            row, nth = spread(self.start[key + 1] - lo)
            at = lo[row] + nth
            own = np.bincount(row // len(terms) * BLOCK + self.place[at], self.weight[at] * w[row % len(terms)], len(opened) * BLOCK)
            near = np.flatnonzero(own > 0)
            example = opened[near // BLOCK] * BLOCK + near % BLOCK
            near, example = near[example != but], example[example != but]
            found.append(example)
            cosines.append(own[near])
            have += len(near)
            if have >= k:
                kth = np.partition(np.concatenate(cosines), have - k)[have - k]
            done, size = done + size, size * 2
        if not have:
            return np.zeros(0, np.int64), np.zeros(0)
        example, cosine = np.concatenate(found), np.minimum(np.concatenate(cosines), 1.0)
        best = np.lexsort((example, -np.round(cosine, 12)))[:k]
        return example[best], cosine[best]

    def vote(self, example: np.ndarray, cosine: np.ndarray) -> float:
        """From -1 (clean) to 1 (toxic); 0 without neighbours."""
        w = NEAR / (1 - cosine + NEAR)
        return float((w * (2 * self.label[example] - 1)).sum() / (w.sum() + DOUBT))

    def score(self, vote: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * vote + self.lift, -30, 30))))

    def calibrate(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> Index:
        """Fit the curve to the votes that examples get from the others, by Newton steps."""
        y = self.label
        if not len(y) or (y >= 0.5).all() or (y < 0.5).all():
            return self
        x = np.array([self.vote(*self.nearest(t, n, but=i)) for i, (t, n) in enumerate(vectors)])
        toxic = y >= 0.5
        share = np.where(toxic, self.base / toxic.mean(), (1 - self.base) / (1 - toxic.mean()))
        design, beta = np.stack([x, np.ones(len(x))], 1), np.array([0.0, self.lift])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
            slope = design.T @ (share * (p - y)) + 1e-3 * np.array([beta[0], 0])
            curve = (design * (share * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
            step = np.linalg.solve(curve, slope)
            beta -= np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-9:
                break
        self.slope, self.lift = float(beta[0]), float(beta[1])
        return self


def _frequencies(batches: Iterator[pa.RecordBatch], known: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    n, total = np.zeros(len(known) + 1, np.int64), 0
    for b in slices(batches, 0, CHUNK):
        n[: len(known) + 1] += np.bincount(_occurrences(b.column(0), known)[1], minlength=len(known) + 1)
        total += b.num_rows
    n[-1] = total
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n), dtype=np.int32)), pa.array(n)], names=["term", "n"])


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, 0, CHUNK):
        text, term, _, names = _occurrences(b.column(0))
        toxic = np.asarray(b.column(1)).astype(np.float64)[text] >= 0.5
        yield pa.RecordBatch.from_arrays([names, pa.array(np.bincount(term, minlength=len(names))), pa.array(np.bincount(term[toxic], minlength=len(names)))], names=["term", "n", "n_toxic"])


def _vectors(batches: Iterator[pa.RecordBatch], known: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, 0, CHUNK):
        text, term, times, _ = _occurrences(b.column(0), known)
        at = pa.array(np.searchsorted(text, np.arange(b.num_rows + 1)).astype(np.int32))
        yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.ListArray.from_arrays(at, pa.array(term.astype(np.int32))), pa.ListArray.from_arrays(at, pa.array(times.astype(np.int32)))], names=["p", "h", "doc_id", "terms", "times"])


def examples(docs: DataFrame, labels: DataFrame, most: int = MOST, text_col: str = "text") -> tuple[DataFrame, float]:
    """(text, p, h, doc_id): at most `most` toxic and as many clean texts with their mean labels; and the share of toxic
    texts among all labelled ones. Ids and hashes are joined and grouped, and only chosen texts are fetched."""
    hashed = docs.select(F.col("doc_id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text")).where("text is not null")
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.avg("toxic").alias("toxic"), F.count("*").alias("n"))
    grouped = materialize(hashed.select("doc_id", "h").join(known, "doc_id").dropDuplicates(["doc_id", "h"]).groupBy("h").agg((F.sum(F.col("toxic") * F.col("n")) / F.sum("n")).alias("p"), F.min("doc_id").alias("doc_id")), "labelled-texts")
    counts = grouped.agg(F.count_if(F.col("p") >= 0.5).alias("toxic"), F.count("*").alias("n")).first()
    chosen = grouped.where("p >= 0.5").orderBy("h").limit(most).unionByName(grouped.where("p < 0.5").orderBy("h").limit(most))
    fetched = hashed.join(F.broadcast(chosen), ["doc_id", "h"]).select("text", "p", "h", F.col("doc_id").cast("string").alias("doc_id")).dropDuplicates(["h"])
    return materialize(fetched, "toxic-examples"), (counts["toxic"] + 0.1) / (counts["n"] + 1)


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST, terms: int = TERMS, text_col: str = "text") -> Index:
    """The index of labelled examples. labels: doc_id, toxic (0 or 1).

    Repeated labels of a text count by their mean; without toxic or without clean examples all scores are the share of
    toxic texts among the labelled ones (0.1 where there are none).
    """
    chosen, base = examples(docs, labels, most, text_col)
    n, toxic = F.col("n").cast("double"), F.col("n_toxic").cast("double")
    had = chosen.agg(F.count("*").alias("size"), F.count_if(F.col("p") >= 0.5).alias("bad")).first()
    size, bad = F.lit(float(had["size"])), F.lit(float(had["bad"]))
    counted = chosen.select("text", "p").mapInArrow(_term_counts, "term binary, n long, n_toxic long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("n_toxic").alias("n_toxic")).where(F.col("n") >= LEAST)
    chi = size * F.pow(toxic * (size - bad - n + toxic) - (n - toxic) * (bad - toxic), 2) / (n * (size - n) * bad * (size - bad))
    telling = counted.where((bad > 0) & (bad < size) & (n < size) & (toxic * (size - bad) > OFTENER * (n - toxic) * bad)).withColumn("chi", chi).where(F.col("chi") >= TELLING)
    names = [bytes(r["term"]) for r in telling.orderBy(F.desc("chi"), "term").limit(terms).collect()]
    known = {t: i for i, t in enumerate(names)}
    sent = docs.sparkSession.sparkContext.broadcast(known)
    sums = docs.select(F.col(text_col).alias("text")).mapInArrow(lambda x: _frequencies(x, sent.value), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(len(names) + 1)
    for r in sums:
        n[r["term"]] = r["n"]
    idf = np.log((1 + n[-1]) / (1 + n[:-1])) + 1
    rows = chosen.select("text", "p", "h", "doc_id").mapInArrow(lambda x: _vectors(x, sent.value), "p double, h long, doc_id string, terms array<int>, times array<int>").collect()
    rows.sort(key=lambda r: (r["p"] < 0.5, max(r["terms"], default=-1, key=lambda t: idf[t]), r["h"]))
    vectors = [(np.array(r["terms"], np.int64), np.array(r["times"], np.int64)) for r in rows]
    return Index(names, idf, [r["doc_id"] for r in rows], np.array([r["p"] for r in rows]), vectors, base).calibrate(vectors)


_EVIDENCE = ArrayType(StructType([StructField("doc_id", StringType()), StructField("similarity", DoubleType()), StructField("toxic", DoubleType())]), False)
_FOUND = pa.list_(pa.struct([("doc_id", pa.string()), ("similarity", pa.float64()), ("toxic", pa.float64())]))


def score_toxicity(docs: DataFrame, index: Index, text_col: str = "text", evidence: int = 5) -> DataFrame:
    """docs with score (0 to 1), predicted (1 from 0.5 on) and evidence: its nearest examples with cosine and label.

    A score depends on the text alone; null, empty and foreign texts have no neighbours and get the curve's value there.
    Repeated rows get equal scores. Columns of these names are replaced, others pass.
    """
    own = Carried(docs, ["score", "predicted", "evidence"])
    at = own.of[text_col]
    schema = StructType([*own.schema.fields, StructField("score", DoubleType()), StructField("predicted", IntegerType()), StructField("evidence", _EVIDENCE)])
    sent = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, at, CHUNK):
            x = sent.value
            text, term, times, _ = _occurrences(b.column(at), x.known)
            edge = np.searchsorted(text, np.arange(b.num_rows + 1))
            scores, shown = np.full(b.num_rows, x.score(0.0)), [[] for _ in range(b.num_rows)]
            for i in np.flatnonzero(np.diff(edge)).tolist():
                near, cosine = x.nearest(term[edge[i] : edge[i + 1]], times[edge[i] : edge[i + 1]])
                scores[i] = x.score(x.vote(near, cosine))
                shown[i] = [{"doc_id": x.ids[e], "similarity": c, "toxic": x.label[e]} for e, c in zip(near[:evidence].tolist(), cosine[:evidence].tolist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)), pa.array(shown, _FOUND)], names=schema.fieldNames())

    return docs.select(*own.into).mapInArrow(run, schema).select(*own.back, "score", "predicted", "evidence")


def held_out(doc_id: Column) -> Column:
    """Whether no label of this document is learned: its id's CRC-32 is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))
