"""Transitive grouping of records that share keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import materialize


def sites(keys: DataFrame, node: str, key: str, out: str) -> DataFrame:
    """(node, out): nodes that share a key, directly or through others, get the smallest of their nodes.

    Each round gives every key the smallest label of its nodes and every node the smallest of its keys, then follows the
    labels' own labels; keys with any number of nodes need no pairs, only sums that each task starts by itself.
    """
    pairs = keys.select(F.col(node).alias("n"), F.col(key).alias("k")).where("k is not null").distinct()
    pairs = materialize(pairs, "keys")
    label = materialize(keys.select(F.col(node).alias("n")).distinct().withColumn("l", F.col("n")), "labels")
    while True:
        by_key = pairs.join(label, "n").groupBy("k").agg(F.min("l").alias("l"))
        least = pairs.join(by_key, "k").groupBy("n").agg(F.min("l").alias("m"))
        near = label.join(least, "n", "left").select("n", "l", F.least("l", F.coalesce("m", "l")).alias("m"))
        # a node also takes the label that its label has reached
        ahead = near.select(F.col("n").alias("m"), F.col("m").alias("a"))
        new = materialize(near.join(ahead, "m", "left").select("n", "l", F.least("m", F.coalesce("a", "m")).alias("m")), "labels")
        done = new.where("l <> m").isEmpty()
        label = new.select("n", F.col("m").alias("l"))
        if done:
            return label.select(F.col("n").alias(node), F.col("l").alias(out))
