"""Removal of repeated byte strings with suffix arrays by shard.

A byte goes if it lies in a string of `least` bytes that also starts earlier: in a document of smaller id, or before in
its own. Every such string has an anchor, the leftmost of its GRAM-byte grams with the smallest hash; strings in a row
with the same anchor form a context. Equal strings have equal anchors at equal places, so contexts meet by anchor:

1. Grams that are frequent in the corpus are found and avoided as anchors; copies of a context in one batch are merged.
   Each context's anchor, place and hash are then shuffled by anchor. A context seen earlier under its anchor (equal in
   48 bits of the anchor's hash and 64 of its own) is covered whole. If an anchor has other contexts too, each distinct
   one goes on to step 2; single anchors end here. Where all grams of a string are frequent, so is its anchor: its
   contexts are shuffled by themselves, and each distinct one goes on.
2. Distinct contexts are dealt to shards by anchor. A shard sorts the strings that start in its contexts into a suffix
   array by Larsson-Sadakane refinement (only groups that are still tied are sorted again, at twice the depth), gets the
   common prefixes of neighbours by Kasai's walk (all contexts step in parallel), and marks what has an earlier equal.
   A group above SHARD_BYTES is cut into several arrays, and each looks its strings up in the ones before it by binary
   search. An anchor with more than HOT distinct contexts is dealt by string, so that no group is unbounded.
3. What is covered is joined to the documents, whose text was shuffled once for steps 2 and 3.

A null text is empty. A null id comes after all others. Rows that share an id are one document: a string is no earlier
than itself, rows with equal texts have equal results, and those with other texts compare by start. Empty tables give no
rows; columns of docs named as the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from .common import Carried, HashSet, materialize, mix, slices

GRAM = 24
#: Grams at more than one in so many places are frequent.
SHARE = 40_000
#: ... if each eighth place shows them so often at least.
FREQUENT = 100
#: Strings that one numpy step of the anchors looks at; its arrays then stay in the processor's cache.
STEP = 1 << 17
_PLACE = np.uint64((1 << 20) - 1)
SHARD_BYTES = 1 << 20
HOT = 20_000


def _packed(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as a big-endian number (zeros beyond the end)."""
    x = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    x = (x[:-1] << np.uint64(8)) | x[1:]
    x = (x[:-2] << np.uint64(16)) | x[2:]
    return ((x[:-4] << np.uint64(32)) | x[4:])[: len(data)]


def _grams(eight: np.ndarray, n: int, step: int = 1) -> np.ndarray:
    """Hashes of the grams at places 0 to n - 1, each step-th; eight: the packed bytes from each place on."""
    h = eight[:n:step] * np.uint64(0x9E3779B97F4A7C15)
    for o in range(8, GRAM, 8):
        h = mix(h ^ eight[o : o + n : step])
    return h


def frequent_grams(docs: DataFrame) -> np.ndarray:
    """Hashes of the grams at more than one in SHARE places, of which there can be SHARE at most.

    They would make hot anchors, so anchors avoid them where a string has others. What is found here decides how work
    is dealt and never what is removed, so each task looks at every eighth place and reports what it sees often.
    """

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen, total = [np.zeros(0, np.uint64)], 0
            for part in slices(iter([b]), 0):
                data = np.frombuffer(b"".join(part.column(0).to_pylist()), np.uint8)
                if len(data) >= GRAM:
                    seen.append(_grams(_packed(data), len(data) - GRAM + 1, 8))
            gram, n = np.unique(np.concatenate(seen), return_counts=True)
            total, often = int(n.sum()), n >= max(4, int(n.sum()) // SHARE)
            yield pa.RecordBatch.from_arrays([pa.array([None, *gram[often].view(np.int64).tolist()], pa.int64()), pa.array([total, *n[often].tolist()], pa.int64())], names=["gram", "n"])

    counts = materialize(docs.select("bytes").mapInArrow(look, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")), "grams")
    total = counts.where("gram is null").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    often = counts.where(F.col("gram").isNotNull() & (F.col("n") * SHARE > total) & (F.col("n") >= FREQUENT)).select("gram").collect()  # SHARE rows at most
    return np.sort(np.array([r.gram for r in often], np.int64).view(np.uint64))


def _contexts(data: np.ndarray, doc_ends: np.ndarray, least: int, frequent: HashSet | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For documents laid end to end: each context's start, its number of strings, its anchor's hash and its own hash."""
    width = least - GRAM + 1
    out: list[tuple[np.ndarray, ...]] = []
    bounds = np.concatenate([[0], doc_ends])
    bad = np.zeros(len(data) + 1, np.int8)  # strings that would cross into the next document
    np.add.at(bad, np.maximum(doc_ends - least + 1, bounds[:-1]), 1)
    np.add.at(bad, doc_ends, -1)
    bad = np.cumsum(bad)[:-1] > 0
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_OF_BYTE[data] * _up(len(data)), dtype=np.uint64)])
    for lo in range(0, len(data) - least + 1, STEP):
        hi = min(lo + STEP, len(data) - least + 1)  # starts of strings: lo to hi - 1
        eight = _packed(data[lo : hi + least - 1])
        n = hi - lo + width - 1
        h = _grams(eight, n)
        if frequent is not None and len(frequent.values):
            often, _ = frequent.find(h)
            h = h >> np.uint64(1)
            h[often] |= np.uint64(1 << 63)  # smallest only where all grams are frequent
        least_at = (h & ~_PLACE) | np.arange(n, dtype=np.uint64)
        span = 1
        while 2 * span <= width:
            least_at = np.minimum(least_at[:-span], least_at[span:])
            span *= 2
        if span < width:
            least_at = np.minimum(least_at[: n - width + 1], least_at[width - span :][: n - width + 1])
        at = (least_at & _PLACE).astype(np.int64)
        at[bad[lo:hi]] = -1
        starts = np.concatenate([[0], np.flatnonzero(np.diff(at) != 0) + 1])
        size = np.diff(np.append(starts, hi - lo))
        keep = at[starts] >= 0
        starts, size = starts[keep], size[keep]
        out.append((starts + lo, size, h[at[starts]]))
    if not out:
        return (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    start, size, anchor = (np.concatenate(x) for x in zip(*out))
    own = mix((sums[start + size + least - 1] - sums[start]) * _down(len(data) + 1)[start]) ^ mix(size.astype(np.uint64))
    return start, size, anchor, own


_tables: dict[str, np.ndarray] = {}
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: A number for each byte, so that the sums of powers below don't follow from the bytes' own order.
_OF_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _table(name: str, base: np.uint64, n: int) -> np.ndarray:
    if name not in _tables or len(_tables[name]) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        _tables[name] = np.multiply.accumulate(steps)
    return _tables[name][:n]


def _up(n: int) -> np.ndarray:
    return _table("up", _BASE, n)


def _down(n: int) -> np.ndarray:
    return _table("down", _BASE_INVERSE, n)


def anchors(docs: DataFrame, by: list[str], least: int, frequent: np.ndarray) -> DataFrame:
    """From (by..., text as bytes): (by..., anchor, own, place, known); place is start * 256 + number of strings.

    Of equal contexts in one batch only the first goes by its anchor; the others are known to be covered and are dealt by
    their own place, so that copies don't make an anchor hot.
    """
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = HashSet(shared.value)
        for b in batches:
            found: list[tuple[np.ndarray, ...]] = []
            base = 0
            for part in slices(iter([b]), len(by)):
                texts = part.column(len(by)).to_pylist()
                ends = np.cumsum([len(t) for t in texts])
                start, size, anchor, own = _contexts(np.frombuffer(b"".join(texts), np.uint8), ends, least, often)
                doc = np.searchsorted(ends, start, "right")
                found.append((doc + base, (start - (ends[doc] - np.diff(ends, prepend=0)[doc])) * 256 + size, anchor >> np.uint64(16), own))
                base += len(texts)
            if not found:
                continue
            doc, place, anchor, own = (np.concatenate(x) for x in zip(*found))
            ids = [np.asarray(b.column(i))[doc] for i in range(len(by))]
            order = np.lexsort((place, *ids[::-1], own, anchor))
            again = np.zeros(len(order), bool)
            again[order[1:]] = (anchor[order[1:]] == anchor[order[:-1]]) & (own[order[1:]] == own[order[:-1]])
            anchor[again] = mix(own[again] ^ mix((place[again] + (ids[0][again] << 20)).view(np.uint64))) >> np.uint64(16)
            cols = [*ids, anchor.view(np.int64), own.view(np.int64), place, again]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=[*by, "anchor", "own", "place", "known"])

    schema = ", ".join([*(f"{c} long" for c in by), "anchor long, own long, place long, known boolean"])
    return docs.mapInArrow(find, schema)


def suffix_order(data: np.ndarray, left: np.ndarray, least: int) -> np.ndarray:
    """Order of all places by their next bytes, to `least` bytes: ranks, equal where these bytes are equal.

    left: the bytes from each place to the end of its text. Ranks hold for places with at least `least` bytes left.
    """
    eight = _packed(data)
    at = np.flatnonzero(left >= 8)
    order = at[np.argsort(eight[at], kind="stable")]
    rank = np.zeros(len(data), np.int64)
    head = np.concatenate([[True], eight[order[1:]] != eight[order[:-1]]]) if len(order) else np.zeros(0, bool)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))
    depth = 8
    while depth < least:
        step = min(depth, least - depth)
        tied = np.bincount(rank[at], minlength=len(data) + 1)
        at = at[(left[at] >= depth + step) & (tied[rank[at]] > 1)]
        if not len(at):
            break
        old, ahead = rank[at], rank[at + step]
        o = np.lexsort((ahead, old))
        old, ahead = old[o], ahead[o]
        group = np.concatenate([[True], old[1:] != old[:-1]])
        first = np.maximum.accumulate(np.where(group, np.arange(len(o)), 0))
        head = group | np.concatenate([[True], ahead[1:] != ahead[:-1]])
        new = old + np.maximum.accumulate(np.where(head, np.arange(len(o)), 0)) - first
        rank = rank.copy()
        rank[at[o]] = new
        depth += step
    return rank


def common_prefixes(data: np.ndarray, order: np.ndarray, starts: np.ndarray, sizes: np.ndarray, least: int) -> np.ndarray:
    """For each place its common prefix (to `least`) with the place that stands before it in the order, by Kasai's walk.

    Contexts (starts, sizes) walk in parallel: from one place to the next the prefix shrinks by one at most, if the
    neighbour's next place is in the order, and before the own one (ties beyond `least` bytes may turn round).
    """
    eight = _packed(data)
    nth = np.full(len(data) + 1, -1, np.int64)
    nth[order] = np.arange(len(order))
    out = np.zeros(len(data), np.int64)
    lanes = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[lanes], sizes[lanes]
    have = np.zeros(len(starts), np.int64)
    for step in range(int(sizes[0]) if len(sizes) else 0):
        n = int(np.searchsorted(-sizes, -step, "left"))  # contexts with more than `step` strings come first
        at = starts[:n] + step
        mate = np.where(nth[at] > 0, order[nth[at] - 1], -1)
        h = np.where(mate >= 0, have[:n], 0)
        go = np.flatnonzero(mate >= 0)
        while len(go):
            go = go[h[go] < least]
            same = eight[at[go] + h[go]] == eight[mate[go] + h[go]]
            rest = go[~same]
            go = go[same]
            h[go] += 8
            if len(rest):
                x = eight[at[rest] + h[rest]] ^ eight[mate[rest] + h[rest]]
                h[rest] += sum((x < np.uint64(1 << bits)).astype(np.int64) for bits in range(8, 64, 8))  # equal bytes in front
        h = np.minimum(h, least)
        out[at] = h
        onward = (mate >= 0) & (nth[mate + 1] >= 0) & (nth[mate + 1] < nth[at + 1])
        have = have.copy()
        have[:n] = np.where(onward, np.maximum(h - 1, 0), 0)
    return out


def _shard(contexts: list[bytes], ids: np.ndarray, places: np.ndarray, least: int, earlier: list[np.ndarray] | None = None) -> np.ndarray:
    """Which strings have an equal one earlier; contexts come by id and place. earlier: sorted strings of arrays before."""
    size = np.array([len(c) for c in contexts], np.int64)
    data = np.frombuffer(b"".join(contexts), np.uint8)
    starts = np.cumsum(size) - size
    left = np.repeat(starts + size, size) - np.arange(len(data))
    rank = suffix_order(data, left, least)
    at = np.flatnonzero(left >= least)
    order = at[np.argsort(rank[at], kind="stable")]
    prefix = common_prefixes(data, order, starts, size - least + 1, least)
    head = prefix[order] < least
    first = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
    row = np.repeat(np.arange(len(size)), size)
    place = places[row] + np.arange(len(data)) - starts[row]
    covered = np.zeros(len(data), bool)
    covered[order] = (ids[row[order]] != ids[row[first]]) | (place[order] != place[first])
    if earlier is not None:
        heads = order[head]
        ones = np.ones((len(heads), 1), np.uint8)  # keeps zero bytes at the end of a string
        own = np.hstack([np.lib.stride_tricks.sliding_window_view(data, least)[heads], ones]).copy().view(f"S{least + 1}").ravel()
        known = np.zeros(len(own), bool)
        for other in earlier:
            i = np.minimum(np.searchsorted(other, own), len(other) - 1)
            known |= other[i] == own
        covered[order] |= known[np.cumsum(head) - 1]
        earlier.append(own)
    return covered


def _merged(marks: np.ndarray, contexts: list[bytes], places: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of covered strings as (row, lo, hi) in the bytes of their documents."""
    size = np.array([len(c) for c in contexts], np.int64)
    row = np.repeat(np.arange(len(size)), size)
    on = np.flatnonzero(marks)
    new = np.ones(len(on), bool)
    new[1:] = (np.diff(on) != 1) | (np.diff(row[on]) != 0)
    lo = on[new]
    hi = on[np.append(np.flatnonzero(new)[1:], len(on)) - 1] if len(on) else lo
    base = (places - (np.cumsum(size) - size))[row[lo]]
    return row[lo], lo + base, hi + base + least


def match_contexts(contexts: DataFrame, by: list[str], least: int) -> DataFrame:
    """From (key, by..., place, bytes) dealt by key and sorted by key, id and place: covered (by..., lo, hi)."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(rows: dict, earlier: list[np.ndarray] | None = None) -> pa.RecordBatch:
            places = np.array(rows["place"], np.int64)
            marks = _shard(rows["bytes"], np.array(rows[by[0]], np.int64), places, least, earlier)
            row, lo, hi = _merged(marks, rows["bytes"], places, least)
            ids = [pa.array(np.array(rows[c], np.int64)[row]) for c in by]
            return pa.RecordBatch.from_arrays([*ids, pa.array(lo), pa.array(hi)], names=[*by, "lo", "hi"])

        names = ["key", *by, "place", "bytes"]
        held: dict[str, list] = {c: [] for c in names}
        size, earlier, of = 0, None, None
        for b in batches:
            cols = {c: b.column(c).to_pylist() for c in names}
            for n in range(b.num_rows):
                key = cols["key"][n]
                if held["key"] and key != held["key"][-1] and (size >= SHARD_BYTES or earlier is not None):
                    yield found(held, earlier if of == held["key"][-1] else None)
                    held, size, earlier = {c: [] for c in names}, 0, None
                elif size >= 2 * SHARD_BYTES:  # one group goes on: the rows before it, then its own by parts
                    last = held["key"][-1]
                    cut = held["key"].index(last) if earlier is None else 0
                    if cut:
                        yield found({c: v[:cut] for c, v in held.items()})
                    earlier, of = [] if earlier is None else earlier, last
                    yield found({c: v[cut:] for c, v in held.items()}, earlier)
                    held, size = {c: [] for c in names}, 0
                for c in names:
                    held[c].append(cols[c][n])
                size += len(cols["bytes"][n])
        if held["key"]:
            yield found(held, earlier)

    return contexts.mapInArrow(solve, ", ".join([*(f"{c} long" for c in by), "lo long", "hi long"]))


def _bytes_at(text: Column, place: Column, n: Column) -> Column:
    return F.substring(text, place + 1, n)


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = 100) -> DataFrame:
    """One row per row of docs: its other columns, n_bytes, removed (spans of bytes, end exclusive) and kept (bytes)."""
    own = Carried(docs, (text_col, "n_bytes", "removed", "kept"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    last = F.lit((1 << 63) - 1)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), last).alias("id"), text.alias("bytes"), *own.into)
    shared = not rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    by = ["id", "fp"] if shared else ["id"]
    rows = rows.withColumn("fp", F.xxhash64("bytes")) if shared else rows
    once = rows.select(*by, "bytes").dropDuplicates(by) if shared else rows.select(*by, "bytes")
    dealt_texts = once.repartition(*by)  # one exchange of the texts, read twice

    often = frequent_grams(once)
    # anchors of strings that have frequent grams only carry a mark (see _contexts)
    marked = F.shiftright("anchor", 47) == 1 if len(often) else F.lit(False)
    under, context = Window.partitionBy("deal"), Window.partitionBy("deal", "anchor", "own")
    seen = (
        anchors(once, by, least, often)
        .withColumn("deal", F.when(marked, F.xxhash64("anchor", "own")).otherwise(F.col("anchor")))
        .repartition("deal")  # both windows below then share one exchange
        .withColumn("first", ~F.col("known") & (F.row_number().over(context.orderBy("known", "id", *by[1:], "place")) == 1))
        .withColumn("others", F.when(marked, F.lit(HOT + 1).cast("long")).otherwise(F.sum(F.col("first").cast("int")).over(under)))
        .where("not first or others > 1")
    )
    # one list for both uses, so that both read one exchange
    found = seen.groupBy(*by).agg(F.collect_list(F.struct("first", "place", F.when(F.col("first"), F.col("anchor")).alias("anchor"), "others")).alias("every"))
    covered = F.transform(F.filter("every", lambda x: ~x["first"]), lambda x: x["place"])
    each = dealt_texts.join(found, by).select(*by, "bytes", F.explode(F.filter("every", lambda x: x["first"])).alias("x"))
    each = each.select(*by, "bytes", "x.anchor", "x.others", F.shiftright("x.place", 8).alias("start"), F.col("x.place").bitwiseAND(F.lit(255)).alias("n"))
    # contexts of an anchor with too many of them go string by string, dealt by what the string is
    hot = F.col("others") > HOT
    parts = F.when(hot, F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.struct((F.col("start") + i).alias("place"), F.lit(least).cast("long").alias("size")))).otherwise(F.array(F.struct(F.col("start").alias("place"), (F.col("n") + least - 1).alias("size"))))
    each = each.select(*by, "bytes", "anchor", "others", F.explode(parts).alias("y"))
    cut = each.select("anchor", "others", *by, F.col("y.place").cast("long").alias("place"), _bytes_at(F.col("bytes"), F.col("y.place").cast("int"), F.col("y.size").cast("int")).alias("bytes"))
    key = F.when(F.col("others") > HOT, F.xxhash64("bytes")).otherwise(F.col("anchor"))
    dealt = cut.select(key.alias("key"), *by, "place", "bytes").repartition("key").sortWithinPartitions("key", "id", "place")
    spans = match_contexts(dealt, by, least).groupBy(*by).agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    texts = dealt_texts.join(found, by, "left").select(*by, "bytes", covered.alias("covered")).join(spans, by, "left")
    return _cut_out(texts.join(rows.select(*by, *own.names), by), own, least)


def _cut_out(rows: DataFrame, own: Carried, least: int) -> DataFrame:
    """The documents without the bytes that their covered contexts and spans hold."""
    names = own.names
    flat = rows.select(*names, "bytes", "covered", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, len(names)):
            total, removed, kept = [], [], []
            for text, covered, spans in zip(*(b.column(len(names) + i).to_pylist() for i in range(3))):
                runs: list[list[int]] = []
                every = [(p >> 8, (p >> 8) + (p & 255) + least - 1) for p in covered or []] + [(s["lo"], s["hi"]) for s in spans or []]
                for lo, hi in sorted(every):
                    if runs and lo <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], hi)
                    else:
                        runs.append([lo, hi])
                ends = [0, *(x for r in runs for x in r), len(text)]
                total.append(len(text))
                removed.append([{"lo": lo, "hi": hi} for lo, hi in runs])
                kept.append(b"".join(text[lo:hi] for lo, hi in zip(ends[::2], ends[1::2])))
            spans_type = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(total, pa.int64()), pa.array(removed, spans_type), pa.array(kept, pa.binary())], names=[*names, "n_bytes", "removed", "kept"])

    spans = ArrayType(StructType([StructField("lo", LongType()), StructField("hi", LongType())]))
    schema = own.schema.add("n_bytes", LongType()).add("removed", spans).add("kept", BinaryType())
    return flat.mapInArrow(cut, schema).select(*own.back, "n_bytes", "removed", "kept")
