"""State over rounds and runs: carried findings, runs of equal exits, seeds with known misses, last writer."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def carried(findings: DataFrame, corpus: str, round_: str, kind: str, struck: DataFrame) -> DataFrame:
    """Findings of each corpus's latest round that weren't struck (corpus, kind)."""
    w = Window.partitionBy(corpus)
    latest = findings.withColumn("_last", F.max(round_).over(w)).where(F.col(round_) == F.col("_last")).drop("_last")
    return latest.join(struck.select(corpus, kind), [corpus, kind], "left_anti").select(corpus, kind).distinct()


def equal_runs(events: DataFrame, by: str, order: list[str], value: str) -> DataFrame:
    """The longest run of equal values in a row for each key, and the run it ends with."""
    w = Window.partitionBy(by).orderBy(*order)
    new = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    runs = events.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    sizes = runs.groupBy(by, "_run").agg(F.count("*").alias("n"))
    return sizes.groupBy(by).agg(F.max("n").alias("longest"), F.max_by("n", "_run").alias("current"))


def lookup_with_misses(requests: DataFrame, seeds: DataFrame, key: str, found: str) -> DataFrame:
    """hit, miss (a seed that knows there is nothing) or ask (no seed); found: an array, empty for a known miss."""
    j = requests.join(seeds.select(key, found), key, "left")
    return j.withColumn("state", F.when(F.col(found).isNull(), "ask").when(F.size(found) == 0, "miss").otherwise("hit"))


def last_writer(rows: DataFrame, keys: list[Column], names: list[str], seq: str) -> DataFrame:
    """Of the rows of one key the last."""
    keyed = rows.withColumns(dict(zip(names, keys)))
    return keyed.withColumn("_n", F.row_number().over(Window.partitionBy(*names).orderBy(F.col(seq).desc()))).where("_n = 1").drop("_n")


def better_precision(base: DataFrame, new: DataFrame, seq: str, ranks: list[str]) -> DataFrame:
    """Coordinates of new (seq, lat, lng, precision) where its precision ranks higher; unknown ones count as street."""
    rank = lambda c: F.array_position(F.array(*map(F.lit, ranks)), F.when(c.isin(ranks), c).otherwise("street"))
    j = base.join(new.select(seq, F.col("lat").alias("_lat"), F.col("lng").alias("_lng"), F.col("precision").alias("_p")), seq, "left")
    up = F.coalesce(F.col("_p").isNotNull() & (rank(F.col("_p")) > rank(F.col("precision"))), F.lit(False))
    return j.select(*[c for c in base.columns if c not in ("lat", "lng", "precision")], *[F.when(up, F.round(f"_{c}", 6)).otherwise(F.col(c)).alias(c) for c in ("lat", "lng")], F.when(up, F.col("_p")).otherwise(F.col("precision")).alias("precision"))


def field_by_field(used: DataFrame, code: str, sources: list[DataFrame], fields: list[str]) -> DataFrame:
    """The codes in use, each field from the first source that has it."""
    codes = used.select(code).where(F.col(code).isNotNull()).distinct()
    joined = reduce(lambda d, n: d.join(sources[n].select(F.col(code), *[F.col(f).alias(f"_{n}_{f}") for f in fields]), code, "left"), range(len(sources)), codes)
    return joined.select(code, *[F.coalesce(*[F.col(f"_{n}_{f}") for n in range(len(sources))]).alias(f) for f in fields])
