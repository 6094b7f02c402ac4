"""Precedence merge: many records of one thing to one row, each field by its own order, with what lost and why kept."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def long_form(records: DataFrame, key: str, fields: list[str], keep: list[str]) -> DataFrame:
    """One row for each record and field: key, kept columns, field, value (string)."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    return records.select(key, *keep, F.explode(pairs).alias("x")).select(key, *keep, "x.field", "x.value")


def ranked(long: DataFrame, key: str, order: list[Column], known: Column) -> DataFrame:
    """Known values numbered by precedence within (key, field); order must end in a column that is unique there."""
    return long.where(known).withColumn("precedence", F.row_number().over(Window.partitionBy(key, "field").orderBy(*order)))


def precedence_merge(records: DataFrame, key: str, fields: list[str], order: list[Column], keep: list[str], known: Column | None = None) -> DataFrame:
    """Per key and field: the first known value, how many records had one and how many other values were discarded."""
    long = long_form(records, key, fields, keep)
    r = ranked(long, key, order, F.col("value").isNotNull() if known is None else known)
    return r.groupBy(key, "field").agg(
        F.min_by("value", "precedence").alias("value"),
        F.count("*").alias("n_records"),
        (F.count_distinct("value") - 1).alias("n_discarded"),
    )


def conflict_candidates(records: DataFrame, key: str, fields: list[str], order: list[Column], keep: list[str]) -> DataFrame:
    """(key, field) with two different known values or more: each once, labelled a, b, ... in order of precedence."""
    long = long_form(records, key, fields, keep)
    first = ranked(long, key, order, F.col("value").isNotNull()).groupBy(key, "field", "value").agg(F.min("precedence").alias("precedence"))
    w = Window.partitionBy(key, "field")
    out = first.withColumn("n", F.count("*").over(w)).withColumn("rank", F.row_number().over(w.orderBy("precedence")))
    return out.where("n > 1").select(key, "field", F.chr(F.lit(96) + F.col("rank")).alias("label"), "value")


def mode_first_seen(df: DataFrame, value: str, seq: str) -> DataFrame:
    """The most frequent value; of several, the one seen first. One row."""
    counted = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"), F.min(seq).alias("first_seen"))
    return counted.agg(F.max_by(value, F.struct("n", -F.col("first_seen"))).alias(value), F.max("n").alias("n"))


def keep_first(df: DataFrame, keys: list[str], order: list[Column], null_keys_pass: bool = False) -> DataFrame:
    """The first row of each key; with null_keys_pass, rows without a whole key are all kept."""
    first = df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return first.where((F.col("_n") == 1) | (~whole if null_keys_pass else F.lit(False))).drop("_n")


def with_suffixes(df: DataFrame, base: str, seq: str, out: str) -> DataFrame:
    """base, base-2, base-3, ... in order of seq."""
    n = F.row_number().over(Window.partitionBy(base).orderBy(seq))
    return df.withColumn(out, F.when(n == 1, F.col(base)).otherwise(F.concat_ws("-", base, n)))


def authority(clusters: DataFrame, cluster: str, family: str, chosen: str) -> DataFrame:
    """Rows of clusters that a chosen family vouches for, or that no family does; all rows if that leaves none."""
    w = Window.partitionBy(cluster)
    vouched = F.coalesce(F.max((F.col(family) == chosen).cast("int")).over(w) == 1, F.lit(False)) | (F.count(family).over(w) == 0)
    marked = clusters.withColumn("_ok", vouched)
    any_left = marked.agg(F.coalesce(F.bool_or("_ok"), F.lit(False)).alias("_any"))  # one row
    return marked.crossJoin(F.broadcast(any_left)).where("_ok or not _any").drop("_ok", "_any")
