"""Outputs: ordered exports, reports and documents; unknown values get their placeholders here and nowhere else."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.unknown import sentinel


def flat_export(df: DataFrame, columns: dict[str, str], order: list[Column]) -> DataFrame:
    """Columns in the given order under their shown names, all text, unknown values as placeholders."""
    return df.orderBy(*order).select(*[sentinel(F.col(c).cast("string"), c).alias(shown) for c, shown in columns.items()])


def with_overrides(df: DataFrame, key: str, columns: list[str], overrides: DataFrame) -> DataFrame:
    """df with the cells that overrides (key, field, value) name replaced."""
    wide = overrides.where(F.col("field").isin(columns)).groupBy(key).pivot("field", columns).agg(F.max("value"))
    j = df.join(wide.select(key, *[F.col(c).alias(f"_o_{c}") for c in columns]), key, "left")
    return j.select(*[F.coalesce(f"_o_{c}", F.col(c).cast("string")).alias(c) if c in columns else F.col(c) for c in df.columns])


def without_blobs(df: DataFrame, blobs: list[str]) -> DataFrame:
    return df.drop(*blobs)


def gaps_report(df: DataFrame, key: str, core: list[str], other: list[str]) -> DataFrame:
    """(key, kind, field): core fields that a row lacks, and other fields that it lacks though some row has them."""
    some = df.agg(*[F.max(F.col(c).isNotNull().cast("int")).alias(f"_{c}") for c in other])  # one row
    gaps = [F.when(F.col(c).isNull(), F.struct(F.lit("core").alias("kind"), F.lit(c).alias("field"))) for c in core]
    gaps += [F.when(F.col(c).isNull() & (F.col(f"_{c}") == 1), F.struct(F.lit("other").alias("kind"), F.lit(c).alias("field"))) for c in other]
    return df.crossJoin(F.broadcast(some)).select(key, F.explode(F.filter(F.array(*gaps), lambda x: x.isNotNull())).alias("x")).select(key, "x.*")


def payload(df: DataFrame, by: str, item: list[str]) -> DataFrame:
    """One JSON line for each group: its count and its items' fields as arrays, ready for a text sink."""
    each = F.array_sort(F.collect_list(F.struct(*item)))
    return df.groupBy(by).agg(F.count("*").alias("n"), each.alias("items")).select(by, F.to_json(F.struct("n", "items")).alias("document"))
