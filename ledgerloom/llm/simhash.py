"""SimHash near-duplicates by a grid join in segment-popcount space.

A fingerprint of 64 bits is cut into 32 segments of two bits. The vector of segment bit counts embeds it: two
fingerprints differ in at least as many bits as their vectors differ under Manhattan distance. The segments form seven
groups, so vectors within distance 3 agree exactly on four groups at least; each choice of four groups is one grid, and
only fingerprints of the same cell meet. What meets is cut by the Manhattan bound and then by the exact count of bits.

Distinct fingerprints take part, so copies never pair. Fingerprints of a cell agree in the counts of their segments on
four groups; if they also link, at most one of these segments differs, so three of the four groups agree bit by bit. A
cell with more than CELL of them is therefore dealt again by each choice of three, and what is still too large is split
into blocks that meet two by two, in tasks of their own. Each task returns the links that join what it has not joined yet
(a spanning forest of its cell), and components follow by alternating large-star and small-star steps on those links.
Their nodes are fingerprints, so a component holds together whatever ids its rows have.

A null text, like one without words, has fingerprint zero and links as any other. Repeated rows (also of one doc_id)
each get a row of the result. Null ids are kept and have their component's smallest id (null if it has no other); empty
tables give no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Carried, lower_ascii, materialize, slices

SEED = 42
GROUPS = 7
#: Distinct fingerprints of one cell that one task compares at once.
CELL = 2048


def _fingerprints(texts: list[str | None], shingle: int) -> np.ndarray:
    """Of each text, the bits set in over half of its shingles' hashes."""
    one, hashes, many = xxhash.xxh64_intdigest, [], []
    for t in texts:
        w = lower_ascii((t or "").encode("utf-8", "replace")).split()
        if len(w) < shingle:
            own = [one(b" ".join(w), SEED)] if w else []
        else:
            own = [one(b" ".join(x), SEED) for x in zip(*(w[i:] for i in range(shingle)))]
        hashes += own
        many.append(len(own))
    n = np.array(many, np.int64)
    out = np.zeros(len(n), np.uint64)
    if hashes:
        h, starts = np.array(hashes, np.uint64), (np.cumsum(n) - n)[n > 0]
        for bit in range(64):
            ones = np.add.reduceat(((h >> np.uint64(bit)) & np.uint64(1)).astype(np.int32), starts)
            out[n > 0] |= (2 * ones > n[n > 0]).astype(np.uint64) << np.uint64(bit)
    return out


def fingerprints(docs: DataFrame, text_col: str = "text", shingle: int = 3) -> DataFrame:
    """docs' other columns and `fp`, the fingerprint as a signed long; docs has no column of that name."""
    kept = [f for f in docs.schema.fields if f.name != text_col]
    rows = docs.select(F.col(text_col).cast("string").alias(text_col), *[f.name for f in kept])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 0):
            fp = _fingerprints(b.column(0).to_pylist(), shingle).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(fp)], names=[*b.schema.names[1:], "fp"])

    return rows.mapInArrow(add, rows.drop(text_col).schema.add("fp", "long"))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _choices(most: int) -> list[tuple[int, ...]]:
    """The choices of GROUPS - most groups, each group as the mask of its bits."""
    cuts = [64 * i // (2 * GROUPS) * 2 for i in range(GROUPS + 1)]
    return list(itertools.combinations([(1 << hi) - (1 << lo) for lo, hi in zip(cuts, cuts[1:])], GROUPS - most))


def _grid(fp: Column, most: int) -> Column:
    """The cells of a fingerprint: for each choice of groups, a hash of the choice and of their popcounts."""
    odd = F.lit(0x5555555555555555)
    low, high = fp.bitwiseAND(odd), F.shiftrightunsigned(fp, 1).bitwiseAND(odd)
    # the bit counts of all 32 segments at once, two bits each: a sum that can't overflow
    counts = low.bitwiseXOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))
    return F.array(*[F.xxhash64(F.lit(n), counts.bitwiseAND(F.lit(_signed(sum(c))))) for n, c in enumerate(_choices(most))])


def _finer(fp: Column, cell: Column, n: Column, most: int) -> Column:
    """The cells into which a hot cell of choice n is dealt: for all but every (most // 2) of its groups, their bits.

    Segments of equal counts differ in two bits or none, so links of `most` bits differ in most // 2 of them at most.
    """
    masks = [[_signed(sum(c)) for c in itertools.combinations(groups, max(1, len(groups) - most // 2))] for groups in _choices(most)]
    own = F.get(F.array(*[F.array(*map(F.lit, m)) for m in masks]), n)
    return F.transform(own, lambda m, i: F.xxhash64(cell, i, fp.bitwiseAND(m)))


def _near(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Which pairs differ in at most `most` bits; the bound in popcount space comes first."""
    odd = np.uint64(0x5555555555555555)
    seg = lambda x: ((x & odd) + ((x >> np.uint64(1)) & odd)).view(np.uint8).reshape(*x.shape, 8)
    x, y = seg(a), seg(b)
    low = np.zeros(a.shape, np.int64)
    for s in range(0, 8, 2):
        low += np.abs(((x >> s) & 3).astype(np.int8) - ((y >> s) & 3).astype(np.int8)).sum(-1)
    ok = low <= most
    ok[ok] = np.bitwise_count(a[ok] ^ b[ok]) <= most
    return ok


def _forest(key: np.ndarray, fp: np.ndarray, node: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of each cell; rows are sorted by key, and a cell's rows stand together."""
    label, links = np.arange(len(key)), []
    for lag in range(1, len(key)):
        i = np.flatnonzero(key[lag:] == key[:-lag])
        if not len(i):
            break
        i = i[label[i] != label[i + lag]]
        i = i[_near(fp[i], fp[i + lag], most)]
        for a, b in zip(i.tolist(), (i + lag).tolist()):
            u, v = a, b
            while label[u] != u:
                label[u] = label[label[u]]
                u = label[u]
            while label[v] != v:
                label[v] = label[label[v]]
                v = label[v]
            if u != v:
                label[max(u, v)] = min(u, v)
                links.append((int(node[a]), int(node[b])))
        if len(i):
            while not (label == label[label]).all():
                label = label[label]
    return links


def _by_shuffle(df: DataFrame) -> DataFrame:
    """df as a side of joins that never send it through the driver, as small tables of each round otherwise would be."""
    return df.hint("merge")


def _sized(cells: DataFrame) -> DataFrame:
    """cells with `size`, where it is above one; counts are summed by task first, and a hot cell is split in the join."""
    return cells.join(_by_shuffle(cells.groupBy("cell").agg(F.count("*").alias("size")).where("size > 1")), "cell")


def links(nodes: DataFrame, most: int = 3) -> DataFrame:
    """From distinct fp: links (u, v) of fingerprints, u > v, that connect whatever links of `most` bits connect."""
    cells = nodes.select("fp", F.posexplode(_grid(F.col("fp"), most)).alias("n", "cell"))
    sized = materialize(_sized(cells), "cells")
    again = sized.where(F.col("size") > CELL).select("fp", F.explode(_finer(F.col("fp"), F.col("cell"), F.col("n"), most)).alias("cell"))
    blocks = F.ceil(F.col("size") / F.lit(CELL)).cast("int")
    split = (
        _sized(again).withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
        .select("fp", "cell", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        .select("fp", F.xxhash64("cell", F.least("own", "other"), F.greatest("own", "other")).alias("cell"))
    )
    met = sized.where(F.col("size") <= CELL).select("fp", "cell").unionByName(split)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.zeros(0, np.int64)] * 2

        def found(cols: list[np.ndarray]) -> pa.RecordBatch:
            pairs = _forest(cols[0], cols[1].view(np.uint64), cols[1], most)
            u, v = [max(x) for x in pairs], [min(x) for x in pairs]
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

        for b in batches:
            cols = [np.concatenate([h, np.asarray(b.column(c)).astype(np.int64)]) for h, c in zip(held, ("cell", "fp"))]
            if len(cols[0]):
                cut = int(np.searchsorted(cols[0], cols[0][-1]))  # the last cell may go on in the next batch
                if cut:
                    yield found([c[:cut] for c in cols])
                held = [c[cut:] for c in cols]
        yield found(held)

    return met.repartition("cell").sortWithinPartitions("cell").mapInArrow(meet, "u long, v long").distinct()


def components(pairs: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (u, v): component is the smallest node reachable.

    Large-star then small-star until nothing changes; each round is written to the shared folder, so that no lineage
    grows. A node's neighbours are never collected: the smallest comes by an aggregate and is joined back.
    """
    edges = materialize(pairs.select("u", "v").where("u <> v"), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(_by_shuffle(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # now u > v always: the small neighbours of u, and u itself, go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(_by_shuffle(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        new = materialize(small, "edges")
        # stars only: no node is both a centre and a leaf, and each leaf has one centre
        leaves = new.groupBy("u").agg(F.count("*").alias("n"))
        if new.join(_by_shuffle(new.select(F.col("u").alias("v")).distinct()), "v", "left_semi").isEmpty() and leaves.where("n > 1").isEmpty():
            break
        edges = new
    return new.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(new.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _components(marked: DataFrame, most: int) -> DataFrame:
    """(fp, component) for every fingerprint of marked: the smallest fingerprint (as a signed long) that links reach."""
    nodes = marked.select("fp").distinct()
    named = components(links(nodes, most)).select(F.col("node").alias("fp"), "component")
    return nodes.join(_by_shuffle(named), "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, most: int = 3) -> DataFrame:
    """One row per document: its id, `fingerprint` (16 hex digits) and `component_id`, the smallest id of its component."""
    marked = materialize(fingerprints(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), "text", shingle), "fingerprints")
    of = _components(marked, most)
    least = marked.groupBy("fp").agg(F.min("id").alias("id")).join(_by_shuffle(of), "fp").groupBy("component").agg(F.min("id").alias("component_id"))
    named = of.join(_by_shuffle(least), "component").select("fp", "component_id")
    return marked.join(_by_shuffle(named), "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, most: int = 3) -> DataFrame:
    """docs without near-duplicates: of each component the row with the smallest id stays.

    Of rows that share it, the one with the smallest hash of its values stays, and of equal rows one. Rows of one id in
    different components each count in their own. Rows without an id can't be named: all stay, and none is dropped for them.
    """
    own = Carried(docs)
    key = F.xxhash64(*[F.col(f.name) for f in own.schema.fields if "map<" not in f.dataType.simpleString()])
    rows = docs.select(*own.into).withColumn("id", F.col(own.of[id_col]).cast("long")).withColumn("key", key)
    marked = materialize(fingerprints(rows.select("id", "key", F.col(own.of[text_col]).alias("text")), "text", shingle), "fingerprints")
    first = marked.where("id is not null").groupBy("fp").agg(F.min(F.struct("id", "key")).alias("first"))
    stay = first.join(_by_shuffle(_components(marked, most)), "fp").groupBy("component").agg(F.min("first").alias("first")).select("first.*")
    once = rows.join(_by_shuffle(stay), ["id", "key"], "left_semi").withColumn("nth", F.row_number().over(Window.partitionBy("id", "key").orderBy("id"))).where("nth = 1")
    return once.select(*own.back).unionByName(rows.where("id is null").select(*own.back))
