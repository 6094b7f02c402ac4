"""Line dedup by site-relative frequency.

A site's boilerplate is what stands on many of its pages: the pages that hold a line, divided by the pages of the site.
Lines above `ratio` on sites of at least `least_pages` pages go, wherever they stand in that site's pages. Each page
counts a line once, before anything is shuffled; counts are summed by task first, so a site with a third of all rows
spreads by its lines. A site has at most (distinct lines a page) / ratio such lines, which bounds the set; it is
broadcast if it holds at most BROADCAST_LINES, and otherwise joined by site and line.

Lines are the parts between line feeds, trimmed of white space for comparison; lines without a word always stay. A null
text stays null and counts as a page without lines. A null site is a site. Repeated rows are pages of their own; empty
tables give no rows; columns of docs named as the results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Carried, materialize

BROADCAST_LINES = 100_000
#: Lists into which a site's lines are dealt by their hash, so that a line is looked for in a short one.
LISTS = 256


def line_key(line: Column) -> Column:
    """A line as compared: trimmed; null if nothing is left."""
    return F.nullif(F.btrim(line, F.lit(" \t\n\x0b\x0c\r")), F.lit(""))


def _code(line: Column) -> Column:
    """96 hash bits of a line, as the shuffles carry them."""
    return F.struct(F.xxhash64(line).alias("a"), F.hash(line).alias("b"))


def boilerplate(docs: DataFrame, site: Column, text_col: str, ratio: float, least_pages: int) -> DataFrame:
    """(site, line): the codes of each site's boilerplate."""
    rows = docs.select(site.cast("string").alias("site"), F.col(text_col).cast("string").alias("text"))
    pages = rows.groupBy("site").agg(F.count("*").alias("pages")).where(F.col("pages") >= least_pages)
    lines = F.array_distinct(F.transform(F.split("text", "\n"), lambda x: F.when(line_key(x).isNotNull(), _code(line_key(x)))))
    held = rows.select("site", F.explode(lines).alias("line")).where("line is not null").groupBy("site", "line").agg(F.count("*").alias("n"))
    often = held.where("n > 1").join(F.broadcast(pages), held["site"].eqNullSafe(pages["site"])) if pages.limit(100_001).count() <= 100_000 else held.where("n > 1").join(pages, held["site"].eqNullSafe(pages["site"]))
    return often.where(F.col("n") > F.lit(ratio) * F.col("pages")).select(held["site"], "line")


def dedup_lines(docs: DataFrame, site: Column, *, text_col: str = "text", ratio: float = 0.08, least_pages: int = 20) -> DataFrame:
    """docs with text_col freed of its site's boilerplate, and n_lines and n_dropped added."""
    found = materialize(boilerplate(docs, site, text_col, ratio, least_pages), "boilerplate")
    own = Carried(docs, ["n_lines", "n_dropped"])
    rows = docs.select(*own.into, site.cast("string").alias("site"), F.split(F.col(text_col).cast("string"), "\n").alias("lines"))
    if found.count() <= BROADCAST_LINES:
        dealt = F.transform(F.sequence(F.lit(0), F.lit(LISTS - 1)), lambda n: F.filter("bad", lambda x: F.pmod(x["a"], F.lit(LISTS)) == n))
        by_site = found.groupBy("site").agg(F.collect_set("line").alias("bad")).select(F.col("site").alias("of"), dealt.alias("bad"))
        marked = rows.join(F.broadcast(by_site), rows["site"].eqNullSafe(by_site["of"]), "left")
        listed = lambda code: F.array_contains(F.get(F.col("bad"), F.pmod(code["a"], F.lit(LISTS)).cast("int")), code)
        stays = lambda x: line_key(x).isNull() | ~listed(_code(line_key(x)))
        marked = marked.withColumn("kept", F.when(F.col("bad").isNull(), F.col("lines")).otherwise(F.filter("lines", stays)))
    else:
        numbered = materialize(rows.withColumn("row", F.expr("uuid()")), "numbered")
        each = numbered.select("row", "site", F.posexplode("lines").alias("n", "line")).withColumn("code", _code(line_key(F.col("line"))))
        stay = each.join(found, each["site"].eqNullSafe(found["site"]) & (each["code"] == found["line"]), "left_anti")
        back = stay.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]).alias("kept"))
        marked = numbered.join(back, "row", "left").withColumn("kept", F.when(F.col("lines").isNotNull(), F.coalesce("kept", F.array().cast("array<string>"))))
    text = F.array_join("kept", "\n")
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("long")
    back = [text.alias(text_col) if n == own.of[text_col] else c for n, c in zip(own.names, own.back)]
    return marked.select(*back, size("lines").alias("n_lines"), (size("lines") - size("kept")).alias("n_dropped"))
