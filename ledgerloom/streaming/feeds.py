"""Feeds that grow: newest value by key, windowed counts, new findings and skipped work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_feed(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A folder of Parquet files as a stream; times without a zone are taken in the session's, as event times need one."""
    feed = spark.readStream.schema(schema).parquet(path)
    return feed.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema.fields if f.dataType.simpleString() == "timestamp_ntz"})


def newest_by_key(feed: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """The value of the newest row of each key; of equal ones the larger by the rest of `order`. Run in update mode."""
    return feed.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value), F.max(order[0]).alias(order[0]))


def windowed_counts(feed: DataFrame, time: str, by: str, length: str, late: str) -> DataFrame:
    """Counts by window of event time; rows later than `late` after the newest are left out once their window is closed."""
    w = F.window(time, length)
    return feed.withWatermark(time, late).groupBy(w, by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")


def distinct_events(feed: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """Each event once, though the feed may repeat it within `late`."""
    return feed.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def finding_class(text: Column) -> Column:
    """The gate and field that a finding is about, whatever the record."""
    return F.concat_ws("|", F.regexp_extract(text, r"^\[?([a-z-]+)", 1), F.regexp_extract(text, r"\.([A-Za-z]+)", 1))


def seen_elsewhere(history: DataFrame, current: DataFrame, run: str, kind: str) -> DataFrame:
    """Classes of the current run that other runs had too."""
    return current.select(kind).distinct().join(history.select(F.col(kind)).distinct(), kind, "left_semi")


def stale(inputs: DataFrame, outputs: DataFrame, key: str, digest: str) -> DataFrame:
    """Inputs whose digest their output doesn't carry: the work that is left."""
    return inputs.join(outputs.select(key, digest), [key, digest], "left_anti")


def unanswered(asked: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """Questions not yet answered or declined."""
    return asked.join(answers.select(key), key, "left_anti")
