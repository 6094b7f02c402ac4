"""Ledgers and rules: upserts, managed replacement, coverage, snapshots and checks as rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .merge import long_form


def upsert(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """New rows replace those of the same key, others are added; `action` says which."""
    o, n = old.select(*keys, *values, F.lit(True).alias("_o")), new.select(*keys, *values, F.lit(True).alias("_n"))
    for v in values:
        o, n = o.withColumnRenamed(v, f"_o_{v}"), n.withColumnRenamed(v, f"_n_{v}")
    j = o.join(n, keys, "full_outer")
    action = F.when(F.col("_n").isNull(), "kept").when(F.col("_o").isNull(), "added").otherwise("replaced")
    return j.select(*keys, *[F.when(F.col("_n"), F.col(f"_n_{v}")).otherwise(F.col(f"_o_{v}")).alias(v) for v in values], action.alias("action"))


def replace_managed(old: DataFrame, new: DataFrame, managed: Column) -> DataFrame:
    """Rows that the writer manages go, whether or not it has new ones; its new rows are added."""
    return old.where(~F.coalesce(managed, F.lit(False))).unionByName(new)


def untraced(values: DataFrame, ledger: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field) that hold a value without a row in the ledger (key, field)."""
    held = long_form(values, key, fields, []).where("value is not null").select(key, "field")
    return held.join(ledger.select(key, "field").distinct(), [key, "field"], "left_anti")


def account(inputs: DataFrame, key: str, buckets: list[tuple[str, DataFrame]]) -> DataFrame:
    """Each input in the first bucket that has its key; `unaccounted` if none does."""
    out, state = inputs, F.lit(None).cast("string")
    for name, b in buckets:
        out = out.join(b.select(F.col(key)).distinct().withColumn(f"_{name}", F.lit(True)), key, "left")
        state = F.coalesce(state, F.when(F.col(f"_{name}"), name))
    return out.withColumn("bucket", F.coalesce(state, F.lit("unaccounted"))).drop(*[f"_{n}" for n, _ in buckets])


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """ADDED and REMOVED keys, and CHANGED fields with both values."""
    a, b = before.select(key, *[F.col(f).cast("string").alias(f"_a_{f}") for f in fields], F.lit(True).alias("_a")), after.select(key, *[F.col(f).cast("string").alias(f"_b_{f}") for f in fields], F.lit(True).alias("_b"))
    j = a.join(b, key, "full_outer")
    none = F.lit(None).cast("string")
    row = lambda kind, f, o, n: F.struct(F.lit(kind).alias("change"), F.lit(f).cast("string").alias("field"), o.alias("old"), n.alias("new"))
    changes = F.array(*[F.when(~F.col(f"_a_{f}").eqNullSafe(F.col(f"_b_{f}")), row("CHANGED", f, F.col(f"_a_{f}"), F.col(f"_b_{f}"))) for f in fields])
    rows = F.when(F.col("_a").isNull(), F.array(row("ADDED", None, none, none))).when(F.col("_b").isNull(), F.array(row("REMOVED", None, none, none))).otherwise(F.filter(changes, lambda x: x.isNotNull()))
    return j.select(key, F.explode(rows).alias("x")).select(key, "x.*")


def capped(rows: DataFrame, order: list[Column], most: int, text: str) -> DataFrame:
    """The first `most` rows and how many there are in all: a report never hides that it was cut."""
    total = rows.agg(F.count("*").alias("n_total"))
    return rows.orderBy(*order).limit(most).crossJoin(F.broadcast(total)).select(text, "n_total", F.greatest(F.col("n_total") - most, F.lit(0)).alias("n_cut"))


def violations(df: DataFrame, key: str, rules: list[tuple[str, str, Column]]) -> DataFrame:
    """One row for each key and rule (name, severity, condition) that holds."""
    found = F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(n).alias("rule"), F.lit(s).alias("severity"))) for n, s, c in rules])
    return df.select(key, F.explode(F.filter(found, lambda x: x.isNotNull())).alias("x")).select(key, "x.rule", "x.severity")


def capture_symmetry(df: DataFrame, source: str, fields: list[str], core: list[str], affected: int = 5, present: int = 3) -> DataFrame:
    """Fields that some sources hold and others never do, with how many records that concerns."""
    counts = df.groupBy(source).agg(F.count("*").alias("n"), *[F.count(f).alias(f"_{f}") for f in fields])
    each = counts.select(source, "n", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_{f}").alias("held")) for f in fields])).alias("x")).select(source, "n", "x.*")
    by = each.groupBy("field").agg(
        F.count_if(F.col("held") == 0).alias("sources_without"), F.count_if(F.col("held") > 0).alias("sources_with"),
        F.coalesce(F.sum(F.when(F.col("held") == 0, F.col("n"))), F.lit(0)).alias("affected"), F.coalesce(F.sum("held"), F.lit(0)).alias("present"),
    )
    signal = F.col("field").isin(core) | ((F.col("affected") >= affected) & (F.col("present") >= present))
    return by.where("sources_without > 0 and sources_with > 0").select("*", signal.alias("signal"), F.least("affected", "present").alias("weight"))


def id_mismatch(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys of one side only."""
    left = a.select(key).distinct().join(b.select(key), key, "left_anti").withColumn("side", F.lit("left"))
    return left.unionByName(b.select(key).distinct().join(a.select(key), key, "left_anti").withColumn("side", F.lit("right")))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), frames)
