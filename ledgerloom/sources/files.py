"""Files as tables: discovery, ledgers, records, logs, mail and sheets."""

from __future__ import annotations

import email
import email.policy
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from .workbooks import read_workbooks

#: What a file is by its extension.
ROUTES = {"pdf": "decks", "pptx": "decks", "xlsx": "sheets", "csv": "sheets", "jpg": "images", "jpeg": "images", "png": "images", "eml": "mail", "msg": "mail", "json": "records"}


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def route(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in ROUTES.items() for x in kv])
    return F.coalesce(F.try_element_at(known, F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))), F.lit("unclassified"))


def discover(spark: SparkSession, folder: str, own_outputs: str = r"(?i)/(longlist|gaps_report|ledger)[^/]*$") -> DataFrame:
    """(path, name, kind, digest, duplicate_of): all files but hidden ones, lock files and earlier outputs.

    Of files with equal bytes the first path counts; the others name it. Hashes are made where the files are read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    rows = files.select("path", basename(F.col("path")).alias("name"), F.sha2("content", 256).alias("digest"))
    rows = rows.where(~F.col("name").rlike(r"^(\.|~\$|_)") & ~F.col("path").rlike(own_outputs))
    first = F.first("path").over(Window.partitionBy("digest").orderBy("path"))
    return rows.select("path", "name", route(F.col("path")).alias("kind"), "digest", F.when(first != F.col("path"), first).alias("duplicate_of"))


def basename_collisions(files: DataFrame, path: str = "path") -> DataFrame:
    """Names that more than one path carries, with how many and the first two of them."""
    w = Window.partitionBy("name").orderBy(path)
    rows = files.select(basename(F.col(path)).alias("name"), path).distinct().withColumn("n", F.row_number().over(w))
    return rows.groupBy("name").agg(F.count("*").alias("n_paths"), F.min(path).alias("first_path"), F.max(F.when(F.col("n") == 2, F.col(path))).alias("second_path")).where("n_paths > 1")


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """A CSV ledger with a header, all strings; a byte order mark before the first name is dropped."""
    df = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)
    return df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])


def read_records(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A JSON array of records, or an object that holds it under `records`; unknown keys are not read."""
    both = StructType([*schema.fields, StructField("records", ArrayType(schema))])
    df = spark.read.schema(both).json(path, multiLine=True)
    one = F.array(F.struct(*[f.name for f in schema.fields])).cast(ArrayType(schema))
    return df.select(F.explode(F.coalesce("records", one)).alias("r")).select("r.*")


def read_log(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """JSON lines; those that can't be read are left out."""
    rows = spark.read.schema(StructType([*schema.fields, StructField("_corrupt_record", StringType())])).json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record")
    return rows.where("_corrupt_record is null").drop("_corrupt_record")


_MAIL = "path string, subject string, sender string, date string, body string, n_attachments int, ok boolean, error string"


def read_mail(spark: SparkSession, folder: str) -> DataFrame:
    """Messages (.eml) with their plain text (HTML ones stripped); a message that can't be read is a row with its error."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([_message(p, bytes(c)) for p, c in zip(f["path"], f["content"])], columns=[x.split()[0] for x in _MAIL.split(", ")])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.eml").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "content").mapInPandas(parse, _MAIL)


def _message(path: str, content: bytes) -> tuple:
    try:
        m = email.message_from_bytes(content, policy=email.policy.default)
        part = m.get_body(("plain", "html"))
        body = part.get_content() if part else ""
        if part and part.get_content_type() == "text/html":
            body = re.sub(r"\s+", " ", re.sub(r"<[^>]+>", " ", re.sub(r"(?is)<(script|style)\b.*?</\1\s*>", " ", body)))
        return path, str(m["subject"] or ""), str(m["from"] or ""), str(m["date"] or ""), body.strip(), sum(1 for _ in m.iter_attachments()), True, None
    except Exception as e:  # the error is the row
        return path, None, None, None, None, None, False, f"{type(e).__name__}: {e}"[:300]


def read_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Workbooks (.xlsx) as cells: sheet, zero-based row and column, text, link. `read_workbooks` also has the errors."""
    return read_workbooks(spark, folder).where("error is null").drop("error")


def find_header_row(cells: DataFrame, scan: int = 10) -> DataFrame:
    """Per file and sheet, of the first rows the one with most distinct texts that are no numbers; the first of several."""
    named = cells.where((F.col("row") < scan) & F.col("text").isNotNull() & ~F.col("text").rlike(r"^\s*[-+]?[\d.,\s%€£$]+\s*$"))
    rows = named.groupBy("path", "sheet", "row").agg(F.count_distinct(F.lower(F.trim("text"))).alias("n"))
    return rows.groupBy("path", "sheet").agg(F.max_by("row", F.struct("n", -F.col("row"))).alias("header_row"))


def col_to_index(letters: Column) -> Column:
    """A1 column letters to a zero-based number."""
    return (F.aggregate(F.split(letters, ""), F.lit(0), lambda n, c: F.when(c == "", n).otherwise(n * 26 + F.ascii(c) - 64)) - 1).cast("int")


def expand_ref(ref: Column) -> Column:
    """All (row, col) of a reference such as Z2:AA4, zero-based, rows first."""
    part = lambda n, g: F.regexp_extract(ref, r"^([A-Z]+)(\d+)(?::([A-Z]+)(\d+))?$", g) if n else None
    c0, r0 = col_to_index(part(1, 1)), part(1, 2).cast("int") - 1
    c1 = F.when(part(1, 3) == "", c0).otherwise(col_to_index(part(1, 3)))
    r1 = F.when(part(1, 4) == "", r0).otherwise(part(1, 4).try_cast("int") - 1)
    return F.flatten(F.transform(F.sequence(r0, r1), lambda r: F.transform(F.sequence(c0, c1), lambda c: F.struct(r.alias("row"), c.alias("col")))))


def iso_date(raw: Column) -> Column:
    """The ISO date of an RFC 2822 date; empty if it is none."""
    t = F.regexp_replace(F.regexp_replace(raw, r"^\s*[A-Za-z]{3},\s*", ""), r"\s*\([^)]*\)\s*$", "")
    return F.coalesce(F.date_format(F.try_to_timestamp(t, F.lit("d MMM yyyy HH:mm:ss Z")), "yyyy-MM-dd"), F.lit(""))


def name_index(names: DataFrame, code: str, variants: Column) -> DataFrame:
    """(variant, code) for the name variants that only one code has."""
    each = names.select(F.col(code).alias("code"), F.explode(variants).alias("variant")).distinct()
    return each.groupBy("variant").agg(F.count("*").alias("n"), F.first("code").alias("code")).where("n = 1").select("variant", "code")
