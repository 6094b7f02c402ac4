"""Decks as records: which pages describe a property, what they say of it, and what the contents page calls it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.unknown import clean_value, looks_unknown

#: Labels of fields on a page, as words before a colon or alone on the line above their value.
LABELS = {
    "city": ["city", "location", "town"], "developer": ["developer", "promoter"], "landlord": ["landlord", "owner"], "warehouseArea": ["warehouse area", "warehouse", "gla"],
    "plotArea": ["plot area", "site area"], "warehouseRent": ["warehouse rent", "rent", "headline rent"], "clearHeight": ["clear height", "eaves"], "status": ["status", "availability"],
}
#: Fields of which a page without a name of its own must have one.
CORE = ["warehouseArea", "plotArea", "warehouseRent", "city"]
#: Labels that make a page a property's; entries that make a contents page.
PAGE_LABELS, CONTENTS = 2, 3
_ENTRY = r"^\s*(\S.*?)(?:\s*\.{2,}|\t|\s{2,})\s*(\d{1,3})\s*$"


def page_lines(pages: DataFrame) -> DataFrame:
    """(deck, page, line, text) for the lines of pages (deck, page, text) that aren't blank, numbered from 0."""
    lines = F.filter(F.transform(F.split("text", r"\r\n|[\n\r\x0B\x0C]"), clean_value), lambda x: x != "")
    return pages.select("deck", "page", F.posexplode(lines).alias("line", "text"))


def _field(label: Column, labels: dict[str, list[str]]) -> Column:
    return F.coalesce(*[F.when(label.isin(names), f) for f, names in labels.items()])


def page_fields(pages: DataFrame, labels: dict[str, list[str]] = LABELS) -> DataFrame:
    """(deck, page, field, value, inline): each labelled value of a page, the first known one of a field.

    `Label: value` is an inline label. A label alone on its line (a colon may follow) has the next line as its value,
    unless that one is a label as well. What a window over a page's lines needs is in one task only for one page.
    """
    lines = page_lines(pages)
    said = F.lower(F.regexp_extract("text", r"^([^:]{1,40}?)\s*:?\s*$", 1))
    before, after = F.lower(F.trim(F.regexp_extract("text", r"^([^:]{1,40}):\s*\S", 1))), F.trim(F.regexp_extract("text", r"^[^:]{1,40}:\s*(\S.*)$", 1))
    own, inline = _field(said, labels), _field(before, labels)
    w = Window.partitionBy("deck", "page").orderBy("line")
    marked = lines.select("*", own.alias("_own"), inline.alias("_in"), after.alias("_after")).withColumn("_next", F.lead(F.struct("text", F.coalesce("_own", "_in").alias("label"))).over(w))
    below = F.when(F.col("_own").isNotNull() & F.col("_next").isNotNull() & F.col("_next.label").isNull(), F.col("_next.text"))
    found = marked.select("deck", "page", "line", F.coalesce("_in", "_own").alias("field"), F.when(F.col("_in").isNotNull(), F.col("_after")).otherwise(below).alias("value"), F.col("_in").isNotNull().alias("inline")).where("field is not null")
    known = F.when(~looks_unknown(F.col("value")), F.col("line"))
    return found.groupBy("deck", "page", "field").agg(F.min_by("value", known).alias("value"), F.min("inline").alias("inline"))


def contents(pages: DataFrame, least: int = CONTENTS) -> DataFrame:
    """(deck, names): of decks whose first page has `least` entries of a name, leader dots or a gap, and a page number."""
    first = pages.groupBy("deck").agg(F.min_by("text", "page").alias("text"))
    entries = F.filter(F.transform(F.split("text", "\n"), lambda x: F.regexp_extract(x, _ENTRY, 1)), lambda x: x != "")
    return first.select("deck", entries.alias("names")).where(F.size("names") >= least)


def deck_records(pages: DataFrame, labels: dict[str, list[str]] = LABELS, core: list[str] = CORE) -> DataFrame:
    """(deck, page, park, fields) from the text of decks (deck, page, text): one record for each page of a property.

    A page is a property's if it has two labels that stand alone; the k-th of a deck is called by the k-th name of its
    contents page, if it has one (which is no property's itself). A deck without such pages has records where two inline
    labels stand. A page that is not named must know a core field. Blank and null pages are passed over.
    """
    full = pages.where(F.length(F.trim("text")) > 0).dropDuplicates(["deck", "page"])
    named = contents(full)
    first = full.groupBy("deck").agg(F.min("page").alias("_first")).join(named, "deck")
    inner = full.join(first, "deck", "left").where("_first is null or page <> _first").select("deck", "page", "text", "names")
    fields = page_fields(inner, labels)
    each = fields.groupBy("deck", "page").agg(F.count_if(~F.col("inline")).alias("alone"), F.count_if(F.col("inline")).alias("inline"), F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("field", "value"))))).alias("fields"))
    lead = each.withColumn("own", F.col("alone") >= PAGE_LABELS).withColumn("_any", F.max("own").over(Window.partitionBy("deck")))
    used = lead.where(F.when(F.col("_any"), F.col("own")).otherwise(F.col("inline") >= PAGE_LABELS))
    numbered = used.withColumn("_k", F.row_number().over(Window.partitionBy("deck").orderBy("page"))).join(named, "deck", "left")
    park = F.when(F.col("_any"), F.get("names", F.col("_k") - 1))
    has = F.exists(F.array(*[F.map_contains_key("fields", f) for f in core]), lambda x: x)
    return numbered.select("deck", "page", park.alias("park"), "fields").where(F.col("park").isNotNull() | has)
