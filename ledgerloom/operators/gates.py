"""Gates and side inputs: coverage, validation, containment, answers, families and merged leads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gross_split(records: DataFrame, cluster: str, area: str, stated_total: str) -> DataFrame:
    """Adds gross (the area is the record's own stated total) and demoted (gross, in a cluster that has net areas too)."""
    gross = F.coalesce(F.col(area) == F.col(stated_total), F.lit(False))
    w = Window.partitionBy(cluster)
    both = F.bool_or("gross").over(w) & ~F.bool_and("gross").over(w)
    return records.withColumn("gross", gross).withColumn("demoted", F.col("gross") & both)


def label(*names: Column, town: Column) -> Column:
    """The first name that is known, with the town where it doesn't hold it."""
    name = F.coalesce(*names)
    return F.when(town.isNull() | F.lower(name).contains(F.lower(town)), name).otherwise(F.concat_ws(", ", name, town))


def thousands(low: Column, high: Column) -> Column:
    """`33.6 - 76k`: a range in thousands without closing zeros; one figure where both are equal."""
    show = lambda x: F.regexp_replace(F.format_string("%.1f", x / 1000), r"\.0$", "")
    return F.when(low == high, F.concat(show(low), F.lit("k"))).otherwise(F.concat(show(low), F.lit(" - "), show(high), F.lit("k")))


def absorb_leads(blocks: DataFrame, searched: str, leads: str, seq: str) -> DataFrame:
    """Leads once by country and place: the first stands, all searches that mention it are named, and whether one was abroad.

    leads: array of (country, place).
    """
    each = blocks.select(searched, seq, F.posexplode(leads).alias("pos", "x")).select(searched, seq, "pos", "x.country", "x.place")
    key = F.concat_ws("|", F.lower(F.trim("country")), F.lower(F.trim("place")))
    return each.groupBy(key.alias("key")).agg(
        F.min_by(F.struct("country", "place"), F.struct(seq, "pos")).alias("lead"), F.array_sort(F.collect_set(searched)).alias("mentioned_by"),
        F.bool_or(F.lower(searched) != F.lower("country")).alias("cross_border"),
    ).select("key", "lead.country", "lead.place", "mentioned_by", "cross_border")


def coverage(df: DataFrame, key: str, identity: list[str], core: list[str], least: float) -> DataFrame:
    """(key, problem): rows that repeat another's identity, and rows with too few core facts."""
    same = F.count("*").over(Window.partitionBy(*identity)) > 1
    fill = sum((F.col(c).isNotNull().cast("double") for c in core[1:]), F.col(core[0]).isNotNull().cast("double")) / len(core)
    found = F.array_compact(F.array(F.when(F.col("_same"), "duplicate"), F.when(fill < least, "thin")))
    return df.withColumn("_same", same).select(key, F.explode(found).alias("problem"))


def reconcile(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows (repeats counted) that one side has and the other lacks."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def contained(claims: DataFrame, pages: DataFrame, on: list[str], value: str, text: str) -> DataFrame:
    """claims with `found`: every word of four letters or more stands in the page that the claim names."""
    flat = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    words = F.regexp_extract_all(F.lower(F.col(value)), F.lit("([a-z]{4,})"), 1)
    j = claims.join(pages.select(*on, flat(F.col(text)).alias("_flat")), on, "left")
    return j.withColumn("found", F.col("_flat").isNotNull() & F.forall(words, lambda w: F.col("_flat").contains(w))).drop("_flat")


def apply_answers(records: DataFrame, answers: DataFrame, key: str, value: str, unit: str) -> DataFrame:
    """Units from answers (key, unit) where a record has a number and no unit."""
    j = records.join(answers.select(key, F.col(unit).alias("_answer")), key, "left")
    return j.withColumn(unit, F.when(F.col(unit).isNull() & F.col(value).isNotNull(), F.col("_answer")).otherwise(F.col(unit))).drop("_answer")


def only_family(records: DataFrame, cluster: str, family: str) -> DataFrame:
    """(family, clusters): how many clusters a family alone vouches for."""
    one = records.where(F.col(family).isNotNull()).groupBy(cluster).agg(F.count_distinct(family).alias("n"), F.min(family).alias(family)).where("n = 1")
    return one.groupBy(family).agg(F.count("*").alias("clusters"))


def merge_acks(durable: DataFrame, current: DataFrame, run: str, keys: str) -> DataFrame:
    """Acknowledged keys by run, joined as sets; nothing acknowledged is lost."""
    both = durable.select(run, keys).unionByName(current.select(run, keys))
    return both.select(run, F.explode(keys).alias("k")).distinct().groupBy(run).agg(F.array_sort(F.collect_list("k")).alias(keys))


def match_by_place_or_name(left: DataFrame, right: DataFrame, key: str, place: list[str], name: list[str], prefer: Column) -> DataFrame:
    """left with right's id by equal place columns, else by equal name columns; of several the preferred one."""
    best = lambda on: right.where(" and ".join(f"{c} is not null" for c in on)).groupBy(*on).agg(F.max_by("id", prefer).alias("id"))
    by_place, by_name = best(place).withColumnRenamed("id", "_p"), best(name).withColumnRenamed("id", "_n")
    j = left.join(by_place, place, "left").join(by_name, name, "left")
    return j.select(key, F.coalesce("_p", "_n").alias("id"), F.when(F.col("_p").isNotNull(), "place").when(F.col("_n").isNotNull(), "name").alias("by")).where("id is not null")


def contains_lookup(places: DataFrame, city: str, gazetteer: DataFrame, name: str, ord_: str) -> DataFrame:
    """places with the first gazetteer name that equals the city, or else that holds it or is held by it.

    Names that contain each other share a start of three letters at some word, so only such pairs are looked at.
    """
    exact = gazetteer.select(F.col(name).alias("_exact")).distinct()
    starts = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(c) - 2, F.lit(1))), lambda i: F.substring(c, i, F.lit(3))))
    g = gazetteer.select(F.col(name).alias("_name"), F.col(ord_).alias("_ord"), F.explode(starts(F.col(name))).alias("_k"))
    p = places.select(F.col(city).alias("_city")).distinct()
    pairs = p.withColumn("_k", F.explode(starts(F.col("_city")))).join(g, "_k").where(F.col("_name").contains(F.col("_city")) | F.col("_city").contains(F.col("_name")))
    near = pairs.groupBy("_city").agg(F.min_by("_name", "_ord").alias("_near"))
    j = places.join(exact, F.col(city) == F.col("_exact"), "left").join(near, F.col(city) == F.col("_city"), "left")
    return j.withColumn("matched", F.coalesce("_exact", "_near")).drop("_exact", "_near", "_city")
