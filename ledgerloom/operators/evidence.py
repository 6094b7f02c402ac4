"""Frozen tables, remembered work, implied rows and pages that only one claimant can have."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.session import dealt

#: Fixed value: below this a printed number is a count, not an area.
LEAST_FIGURE = 1000


def row_text(df: DataFrame) -> Column:
    """A row as text from which its values can be told: each with its length before it, nulls as a dash."""
    c = lambda n: F.col("`" + n.replace("`", "``") + "`").cast("string")
    return F.array_join(F.array(*[F.coalesce(F.concat(F.char_length(c(n)).cast("string"), F.lit(":"), c(n)), F.lit("-")) for n in df.columns]), ",")


def fingerprint(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """What a table holds, whatever the order of its rows: their number and two sums of hashes, for each value of `by`.

    Any changed, dropped, added or doubled row changes a sum. Sums of parts add up to that of the whole, so fingerprints
    of partitions can be kept and merged; each task sums before anything is shuffled.
    """
    digest = F.md5(row_text(df).cast("binary"))
    half = lambda at: F.conv(F.substring(F.col("_h"), at, 15), 16, 10).cast("decimal(38,0)")
    hashed = df.select(*(by or []), digest.alias("_h"))
    return hashed.groupBy(*(by or [])).agg(F.count("*").alias("n"), F.coalesce(F.sum(half(1)), F.lit(0)).cast("string").alias("low"), F.coalesce(F.sum(half(16)), F.lit(0)).cast("string").alias("high"))


def merge_fingerprints(parts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The fingerprint of all rows from those of parts."""
    total = lambda c: F.coalesce(F.sum(F.col(c).cast("decimal(38,0)")), F.lit(0)).cast("string").alias(c)
    return parts.groupBy(*(by or [])).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), total("low"), total("high"))


def frozen_state(frozen: DataFrame, now: DataFrame, by: list[str]) -> DataFrame:
    """(by, state): same, changed, missing or new, from the fingerprints that a review began with and those of now."""
    mark = F.struct("n", "low", "high")
    j = frozen.select(*by, mark.alias("_was")).join(now.select(*by, mark.alias("_is")), by, "full")
    return j.select(*by, F.when(F.col("_is").isNull(), "missing").when(F.col("_was").isNull(), "new").when(F.col("_was") == F.col("_is"), "same").otherwise("changed").alias("state"))


def remembered(rows: DataFrame, text: str, memo: DataFrame, compute: Callable[[Column], Column], out: str) -> tuple[DataFrame, DataFrame]:
    """rows with `out` = compute(text), and what the memo (digest, value) is to be extended by.

    Each text's value is looked up by its SHA-256. Only texts that the memo lacks are computed, each distinct one once;
    a memo that holds all of them computes nothing. A null text has a null value and no digest.
    """
    keyed = rows.withColumn("_digest", F.sha2(F.col(text).cast("binary"), 256))
    known = memo.dropDuplicates(["digest"]).select(F.col("digest").alias("_digest"), F.col("value").alias(out))
    fresh = keyed.where("_digest is not null").select("_digest", F.col(text).alias("_said")).join(known, "_digest", "left_anti").groupBy("_digest").agg(F.any_value("_said").alias("_said"))
    made = fresh.select("_digest", compute(F.col("_said")).alias(out))
    return keyed.join(known.unionByName(made), "_digest", "left").drop("_digest"), made.select(F.col("_digest").alias("digest"), F.col(out).alias("value"))


def schedule_figures(c: Column) -> Column:
    """Whole numbers of the text from LEAST_FIGURE on, digits grouped by commas or spaces; distinct and sorted."""
    bare = F.transform(F.regexp_extract_all(c, F.lit(r"(\d[\d,. ]*)"), 1), lambda x: F.regexp_replace(F.regexp_replace(x, "[, ]", ""), r"\.+$", ""))
    return F.array_sort(F.array_distinct(F.filter(F.transform(bare, lambda x: F.when(x.rlike(r"^\d{4,18}$"), x.cast("long"))), lambda v: v >= LEAST_FIGURE)))


def implied_rows(values: DataFrame, baked: DataFrame, recorded: DataFrame, cache: DataFrame) -> DataFrame:
    """(property_id, field, original, translated, reconstructed): the audit rows that translated values imply.

    values: property_id, field, value; baked and recorded: property_id, field, original, translated; cache: source,
    translated. A value's original is what this pass translated, else what an earlier one recorded if that has the same
    translation, else the smallest source that the cache translates so, marked as reconstructed. Others imply no row.
    """
    one = lambda df, names: df.groupBy("property_id", "field").agg(F.max_by(F.struct("original", "translated"), "translated").alias(names))
    inverse = cache.where("source <> translated").groupBy(F.col("translated").alias("value")).agg(F.min("source").alias("_source"))
    j = values.where("value is not null").join(one(baked, "_b"), ["property_id", "field"], "left").join(one(recorded, "_r"), ["property_id", "field"], "left").join(inverse, "value", "left")
    told = F.when(F.col("_b").isNotNull(), F.col("_b")).when(F.col("_r.translated") == F.col("value"), F.col("_r"))
    rows = j.select("property_id", "field", F.when(told.isNotNull(), told["original"]).otherwise(F.col("_source")).alias("original"), F.col("value").alias("translated"), told.isNull().alias("reconstructed"))
    return rows.where("original is not null or not reconstructed")


def row_changes(held: DataFrame, implied: DataFrame, keys: list[str]) -> DataFrame:
    """held against implied rows, as change (add, retract, keep) and the row; a row with another value is both.

    Rows of both sides are told by all their columns. Applying the changes to held gives implied: nothing else needs to be
    rewritten.
    """
    columns = implied.columns
    safe = [F.col(f"_l.{c}").eqNullSafe(F.col(f"_r.{c}")) for c in columns]
    same = safe[0]
    for s in safe[1:]:
        same = same & s
    l, r = held.select(F.struct(*columns).alias("_l")).distinct(), implied.select(F.struct(*columns).alias("_r")).distinct()
    key = [F.col(f"_l.{k}") == F.col(f"_r.{k}") for k in keys]
    j = l.join(r, [*key, same], "full")
    change = F.when(F.col("_l").isNull(), "add").when(F.col("_r").isNull(), "retract").otherwise("keep")
    return j.select(change.alias("change"), *[F.coalesce("_r", "_l")[c].alias(c) for c in columns])


def apply_changes(held: DataFrame, changes: DataFrame) -> DataFrame:
    """held after the changes: its rows without the retracted ones, and the added ones; equal rows count once."""
    of = lambda kind: changes.where(F.col("change") == kind).select(*held.columns)
    return held.subtract(of("retract")).unionByName(of("add"))


def reach_pages(touched: DataFrame, spoken: DataFrame, figures: DataFrame, pages: DataFrame) -> DataFrame:
    """(claimant, deck, page, reason): the pages that nobody has claimed and that only one claimant can have.

    touched: claimant, deck; spoken: deck, page (claimed or anchored); figures: claimant, figure; pages: deck, page,
    figures (array). A deck's only claimant without known figures gets all free pages (`alone`), with figures those that
    print one of them (`own figure`). Of several, each is told by figures that no other claimant of the deck has; at least
    two must be told so, and a page goes to the one of them whose figures it prints, if it prints no other's
    (`only figure`).
    """
    t, own = touched.select("claimant", "deck").distinct(), figures.select("claimant", "figure").where("figure is not null").distinct()
    free = pages.join(spoken.select("deck", "page").distinct(), ["deck", "page"], "left_anti").groupBy("deck", "page").agg(F.flatten(F.collect_set("figures")).alias("figures"))
    printed = free.select("deck", "page", F.explode(F.array_distinct("figures")).alias("figure"))
    n = t.groupBy("deck").agg(F.count("*").alias("owners"))
    told = t.join(n, "deck").join(own, "claimant", "left")
    alone = told.where("owners = 1 and figure is null").select("claimant", "deck").join(free.select("deck", "page"), "deck").withColumn("reason", F.lit("alone"))
    single = told.where("owners = 1 and figure is not null").select("claimant", "deck", "figure").join(printed, ["deck", "figure"]).select("claimant", "deck", "page").distinct().withColumn("reason", F.lit("own figure"))
    only = told.where("owners > 1 and figure is not null").groupBy("deck", "figure").agg(F.count("*").alias("n"), F.min("claimant").alias("claimant")).where("n = 1").select("claimant", "deck", "figure")
    several = only.groupBy("deck").agg(F.count_distinct("claimant").alias("n")).where("n > 1").select("deck")
    named = only.join(several, "deck", "left_semi").join(printed, ["deck", "figure"]).groupBy("deck", "page").agg(F.count_distinct("claimant").alias("n"), F.min("claimant").alias("claimant")).where("n = 1")
    columns = ["claimant", "deck", "page", "reason"]
    return alone.select(columns).unionByName(single.select(columns)).unionByName(named.withColumn("reason", F.lit("only figure")).select(columns))


def contested_pages(claims: DataFrame) -> DataFrame:
    """(deck, first, last, claimants): stretches of pages that more than one claimant's page ranges cover.

    claims: deck, claimant, first, last. Ranges are swept in page order: each opens one claimant's cover and closes it
    after its last page; a claimant's own ranges are merged first, so overlaps with itself don't count. Ranges are dealt to
    all partitions, as the few bytes of each would else put very many into one task's sort.
    """
    before = Window.partitionBy("deck", "claimant").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    new = F.coalesce(F.col("first") > F.max("last").over(before) + 1, F.lit(True))
    grouped = dealt(claims.where("first <= last"), "deck", "claimant").withColumn("_new", new.cast("int")).withColumn("_part", F.sum("_new").over(Window.partitionBy("deck", "claimant").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, 0)))
    merged = grouped.groupBy("deck", "claimant", "_part").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    steps = merged.select("deck", F.explode(F.array(F.struct(F.col("first").alias("at"), F.lit(1).alias("step")), F.struct((F.col("last") + 1).alias("at"), F.lit(-1).alias("step")))).alias("x")).groupBy("deck", "x.at").agg(F.sum("x.step").alias("step"))
    order = Window.partitionBy("deck").orderBy("at")
    cover = steps.withColumn("claimants", F.sum("step").over(order)).withColumn("_next", F.lead("at").over(order))
    runs = cover.where("claimants > 1")
    fresh = F.coalesce(F.lag("_next").over(order) < F.col("at"), F.lit(True)).cast("int")
    joined = runs.withColumn("_n", fresh).withColumn("_run", F.sum("_n").over(order))
    return joined.groupBy("deck", "_run").agg(F.min("at").alias("first"), (F.max("_next") - 1).alias("last"), F.max("claimants").alias("claimants")).drop("_run")
