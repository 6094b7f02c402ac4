"""Rules that transcribed records must keep against the decks they were read from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.numbers import area_band, magnitude_note, rent_band

#: Areas that a deck's text is asked for, rents that look like a month's, and how near a number must be.
ASKED, LOW_RENT, NEAR = (200.0, 2_000_000.0), 15.0, 0.005
ERROR, WARNING = "error", "warning"


def _told(value: Column, numbers: Column) -> Column:
    """Whether some number of the deck is the value, give or take NEAR of the larger one (0.05 at least)."""
    return F.exists(numbers, lambda n: F.abs(value - n) <= F.greatest(F.lit(0.05), NEAR * F.greatest(F.abs(value), F.abs(n))))


def _shown(c: Column) -> Column:
    """A figure as text, without an exponent where its digits can stand in full."""
    digits = F.regexp_replace(c.try_cast("decimal(38,18)").cast("string"), "0+$", "")
    plain = F.when(digits.endswith("."), F.concat(digits, F.lit("0"))).otherwise(digits)
    return F.when((F.abs(c) < 1e16) & (plain.try_cast("double") == c), plain).otherwise(c.cast("string"))


def record_findings(records: DataFrame, decks: DataFrame, numbers: DataFrame) -> DataFrame:
    """(deck, record, rule, detail, severity): each rule that a record breaks, and rules of whole decks (record null).

    records: deck, record, page, image_pages (array, null if not stated), plan_page, plan_stated, hero, excluded (map of
    page to candidates), source, rent, rent_unit, area, plot_area, area_unit, lat, lng, note, unreadable. decks: deck, source,
    pages (array). numbers: deck, values (array of the numbers in its text). A page out of its deck is an error, as it would
    bind a neighbour's picture; a page that two records claim is a warning, and says whether a record anchors it.
    """
    real = ~F.coalesce(F.col("unreadable"), F.lit(False))
    known = decks.select("deck", F.col("source").alias("_source"), F.col("pages").alias("_pages")).join(numbers.select("deck", F.col("values").alias("_values")), "deck", "left")
    j = records.join(known, "deck", "left")
    pages, page = F.coalesce("_pages", F.array().cast("array<int>")), F.col("page")
    has = F.size(pages) > 0
    absent = lambda p: has & ~F.array_contains(pages, F.coalesce(p, F.lit(-1)))
    rule = lambda when, name, severity, detail=None: F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(name).alias("rule"), (detail if detail is not None else F.lit(None)).cast("string").alias("detail"), F.lit(severity).alias("severity")))
    each = lambda items, when, name, severity: F.transform(F.filter(F.coalesce(items, F.array().cast("array<int>")), when), lambda p: F.struct(F.lit(name).alias("rule"), p.cast("string").alias("detail"), F.lit(severity).alias("severity")))
    rent, band = F.col("rent"), rent_band(F.col("rent_unit"))
    metric = ~F.coalesce(F.col("rent_unit").contains("ft"), F.lit(False))
    yearly = F.coalesce(F.col("note").rlike(r"(?i)x\s*12|annualis"), F.lit(False))
    unit = F.coalesce("area_unit", F.lit("sq m"))
    values = F.coalesce("_values", F.array().cast("array<double>"))
    asked = F.size(F.array_distinct(values)) >= 2
    out_of = F.flatten(F.transform(F.map_keys(F.coalesce("excluded", F.create_map().cast("map<int,array<int>>"))), lambda p: F.when(absent(p), F.array(p)).otherwise(F.array().cast("array<int>"))))
    singles = F.array_compact(F.array(
        rule(page.isNull() | (page < 0), "no page", ERROR), rule(page >= 0, "page", "none"),
        rule((page >= 0) & absent(page), "page out of deck", ERROR, page),
        rule((F.size(pages) > 1) & (F.col("image_pages").isNull() | ~F.coalesce(F.col("plan_stated"), F.lit(False))), "keys not stated", WARNING),
        rule((F.col("plan_page") < 0) | (F.col("plan_page").isNotNull() & absent(F.col("plan_page"))), "plan out of deck", ERROR, F.col("plan_page")),
        rule((F.col("plan_page") == page) & ~absent(page), "hero on the plan page", WARNING, page),
        rule(F.array_contains(F.try_element_at("excluded", page), F.col("hero")), "hero excluded", ERROR, F.col("hero")),
        rule((F.col("source") != F.col("_source")) & (F.col("_source") != ""), "other source", WARNING, F.col("source")),
        rule(~rent.between(*band), "rent out of band", ERROR, _shown(rent)),
        rule(rent.between(*band) & metric & (rent < LOW_RENT) & ~yearly, "rent of a month", WARNING, _shown(rent)),
        rule(F.col("lat").isNotNull() & ~F.coalesce(F.col("lat").between(-90, 90) & F.col("lng").between(-180, 180), F.lit(False)), "place out of range", ERROR),
        rule(asked & rent.between(*band) & ~_told(rent, values) & ~_told(rent / 12, values), "rent not in text", WARNING, _shown(rent)),
        *[x for f in ("area", "plot_area") for x in (
            rule(~F.col(f).between(*area_band(unit)), f"{f} out of band", WARNING, _shown(F.col(f))),
            rule(magnitude_note(F.col(f), unit).isNotNull(), f"{f} of the other unit", WARNING, _shown(F.col(f))),
            rule(asked & F.col(f).between(*ASKED) & ~_told(F.col(f), values), f"{f} not in text", WARNING, _shown(F.col(f))),
        )],
    ))
    lists = [each(F.col("image_pages"), lambda p: (p < 0) | absent(p), "image page out of deck", ERROR), each(out_of, lambda p: F.lit(True), "excluded page out of deck", ERROR)]
    own = j.where(real).select("deck", "record", F.explode(F.concat(singles, *lists)).alias("x")).select("deck", "record", "x.*").where(F.col("severity") != "none")
    anchors = j.where(~absent(page) & (page >= 0)).select("deck", "page").distinct()
    claims = j.where(real).select("deck", "record", F.explode("image_pages").alias("page"), "_pages").where((F.col("page") >= 0) & (F.size(pages).isin(0, -1) | F.array_contains(pages, F.col("page")))).select("deck", "record", "page").distinct()
    late = claims.withColumn("_first", F.min("record").over(Window.partitionBy("deck", "page"))).where("record <> _first").join(anchors.withColumn("_held", F.lit(True)), ["deck", "page"], "left")
    contested = late.select("deck", "record", F.when(F.col("_held"), "page claimed twice, anchored").otherwise("page claimed twice").alias("rule"), F.col("page").cast("string").alias("detail"), F.lit(WARNING).alias("severity"))
    seen = anchors.groupBy("deck").agg(F.collect_set("page").alias("_seen"))
    counted = records.where(real).groupBy("deck").agg(F.count("*").alias("_n"))
    whole = decks.join(records.select("deck").distinct(), "deck", "left_semi").join(seen, "deck", "left").join(counted, "deck", "left")
    left = F.array_sort(F.array_except("pages", F.coalesce("_seen", F.array().cast("array<int>"))))
    rules = F.array_compact(F.array(rule(F.size(left) > 0, "pages without a record", WARNING, F.array_join(left.cast("array<string>"), ",")), rule((F.col("_n") > 0) & (2 * F.col("_n") < F.size("pages")), "few records", WARNING, F.col("_n"))))
    deck_rows = whole.select("deck", F.lit(None).cast(records.schema["record"].dataType).alias("record"), F.explode(rules).alias("x")).select("deck", "record", "x.*")
    return own.unionByName(contested).unionByName(deck_rows)
