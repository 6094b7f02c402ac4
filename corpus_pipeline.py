"""A training corpus from raw documents: quality rules, line dedup, near-dedup, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Stages
are written as Parquet and read again, so lineage ends at each and a lost executor costs its own stage's work at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import bpe, decontaminate, line_dedup, quality, queries, simhash
from ledgerloom.llm.common import Carried, materialize


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their source's boilerplate; n_chars follows the text."""
    own = Carried(docs)
    rows = docs.select(*own.into)
    freed = line_dedup.dedup_lines(rows, rows[own.of["source"]], text_col=own.of["text"])
    if "n_chars" in own.of:
        freed = freed.withColumn(own.of["n_chars"], F.char_length(own.of["text"]).cast("long"))
    return freed.select(*own.back)


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids."""
    return bpe.encode_documents(docs, queries.vocabulary())


STAGES = [("quality rules", keep_good), ("line dedup", drop_boilerplate), ("near-dedup", keep_one), ("decontamination", drop_contaminated), ("encoding", encode)]

#: Fingerprints (XXH64) and byte-pair merges have no SQL form; tests/llm hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
