"""Headers of tracker sheets: which column is which field, and the records that follow from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.geo import coords_from_text
from ledgerloom.functions.numbers import normalize_number
from ledgerloom.functions.unknown import clean_value, looks_unknown
from ledgerloom.session import materialize

#: Names of fields in headers, the preferred one first.
FIELDS = {
    "park": ["park", "marketing name", "project", "scheme", "property", "site name", "building name", "logistics park", "unit name"],
    "developer": ["developer", "promoter"],
    "landlord": ["landlord", "owner", "asset manager", "freeholder"],
    "city": ["city", "town", "location", "municipality"],
    "country": ["country", "pais", "país", "pays", "paese", "kraj"],
    "region": ["region", "county", "province"],
    "warehouseArea": ["warehouse area", "gla", "gia", "warehouse sqm", "size", "area sqm", "total area", "floor area", "building size", "total size"],
    "plotArea": ["site area", "plot area", "land area", "plot size", "site size"],
    "officeArea": ["office area", "office content", "office sqm", "offices"],
    "warehouseRentVal": ["rent", "headline rent", "quoting rent", "current quoting rent", "asking rent", "rent eur", "warehouse rent"],
    "serviceCharge": ["service charge"],
    "landPrice": ["land price", "asking price", "guide price", "plot price", "land value"],
    "leaseTerm": ["lease term", "lease terms"],
    "incentives": ["incentive", "incentives"],
    "status": ["status", "availability", "construction status"],
    "earlyAccess": ["early access", "availability date", "delivery", "pc of construction", "practical completion", "completion date"],
    "clearHeight": ["clear height", "eaves", "haunch", "clear internal height", "height"],
    "floorLoad": ["floor loading", "floor load", "slab loading"],
    "loadingDocks": ["dock level doors", "dock doors", "loading docks", "docks"],
    "overheadDoors": ["level access doors", "overhead doors", "drive in doors", "ground level doors", "level access"],
    "electricity": ["power", "power supply", "electricity", "kva"],
    "truckParking": ["trailer spaces", "truck parking", "hgv parking", "lorry parking"],
    "carParking": ["car parking", "car parking spaces", "parking spaces", "car spaces"],
    "breeam": ["breeam", "breeam rating", "certification"],
    "epc": ["epc", "epc rating", "epc band", "epc score", "energy performance certificate"],
    "motorway": ["motorway", "highway", "corridor", "road corridor", "m25 segment"],
    "brochureLink": ["brochure", "online brochure", "online brochure link", "brochure link", "brochure url", "particulars", "marketing brochure", "listing link", "listing url"],
    "latlng": ["latitude, longitude", "lat, long", "lat/long", "coordinates", "lat lng", "latlong"],
    "lat": ["latitude", "lat"],
    "lng": ["longitude", "lng", "long", "lon"],
}
#: What a header must not say for a field.
NEVER = {
    "warehouseRentVal": r"rent\s*free|free\s*rent|service\s*charge|incentive|deposit|historic|achieved|per\s+annum|p\.?a\.?\b|review|deal",
    "city": "note|comment|remark|description",
    "warehouseArea": r"plot|land|office|unit\b|ratio",
    "plotArea": "ratio",
    "clearHeight": r"or above|above\?|ratio",
    "loadingDocks": "ratio|total",
    "overheadDoors": "ratio|total",
    "electricity": r"charg|ev\b|solar",
    "breeam": r"\bepc\b|energy\s+performance",
    "epc": "breeam",
    "status": "verified",
    "developer": "verified",
    "landlord": "verified",
    "leaseTerm": "start|expiry|break|outside",
    "park": "solus|/",
    "landPrice": r"rent|per\s*sq|psf|/\s*sq|service",
}
#: Fields where a zero is an empty cell, fields that are figures, and headers of monthly rents.
ZERO_IS_UNKNOWN = ["clearHeight", "floorLoad", "loadingDocks", "overheadDoors", "electricity", "truckParking", "carParking", "leaseTerm", "officeArea", "serviceCharge", "incentives", "warehouseArea", "plotArea"]
FIGURES = ["warehouseArea", "plotArea", "officeArea", "warehouseRentVal", "serviceCharge", "landPrice"]
MONTHLY = r"month|/\s*mo\b|/mes\b|p\.?\s?m\b|monat|mensual|mensuel"
#: Letters of a near spelling that may differ, of 100; fields that make a sheet a tracker, and a rich one.
NEAR, TRACKER, RICH = 10, 3, 8


def plain_header(c: Column) -> Column:
    return F.lower(clean_value(c))


def _named(rows: DataFrame, header: str, fields: dict[str, list[str]], never: dict[str, str]) -> DataFrame:
    """rows with `_h`, the plain header, and `best`, the field that fits it best: tier, coverage, preference, field.

    Tier 3 is the very name, 2 the name as whole words, 1 a near spelling (nine tenths of the letters in common); coverage
    is the share of the header that the name explains, preference minus the name's place among its field's. Structs
    compare as candidates do. Each distinct header is judged once, however many sheets have it, and what it names is written.
    """
    h = F.col("_h")
    names = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(-i).alias("preference"), F.lit(-k).alias("order"), F.lit(f).alias("field")) for k, (f, own) in enumerate(fields.items()) for i, n in enumerate(own)])

    def judged(a: Column) -> Column:
        size, own = F.char_length(a["name"]), F.char_length(h)
        whole = h.contains(a["name"]) & F.regexp_like(h, F.concat(F.lit(r"(?<![a-z0-9])\Q"), a["name"], F.lit(r"\E(?![a-z0-9])")))
        close = (100 * F.abs(own - size) <= NEAR * (own + size)) & (100 * (2 * F.levenshtein(h, a["name"]) - F.abs(own - size)) <= NEAR * (own + size))
        tier = F.when(h == a["name"], 3).when(whole, 2).when(close, 1)
        return F.struct(tier.alias("tier"), F.when(tier == 3, 1.0).otherwise(size / own).alias("coverage"), a["preference"].alias("preference"), a["order"].alias("order"), a["field"].alias("field"))

    plain = rows.withColumn("_h", plain_header(F.col(header)))
    each = plain.select("_h").where("_h <> ''").distinct().withColumn("_barred", F.array_compact(F.array(F.lit(""), *[F.when(h.rlike(p), f) for f, p in never.items()])))
    fitting = F.filter(F.transform(F.filter(names, lambda a: ~F.array_contains("_barred", a["field"])), judged), lambda x: x["tier"].isNotNull())
    return plain.join(materialize(each.select("_h", F.array_max(fitting).alias("best")), "headers"), "_h", "left")


def bind_columns(headers: DataFrame, outer: DataFrame | None = None, fields: dict[str, list[str]] = FIELDS, never: dict[str, str] = NEVER) -> DataFrame:
    """(path, sheet, col, header, field, by, tier, coverage, rank) for header cells (path, sheet, col, header).

    A column is the field that fits it best; a field keeps all its columns, ranked by how well they fit, then from the
    left: where the best one is empty in a row, the next one fills in. outer (path, sheet, col, field) names columns by
    other means and is believed first, unless the header bars that field; its columns rank before all others of the field.
    Columns that name no field have a null field.
    """
    rows = _named(headers.groupBy("path", "sheet", "col").agg(F.min("header").alias("header")), "header", fields, never).where("_h <> ''").withColumnRenamed("best", "x")
    if outer is not None:
        told = outer.where(F.col("field").isin(list(fields))).groupBy("path", "sheet", "col").agg(F.min("field").alias("told"))
        barred = F.coalesce(*[F.when(F.col("told") == f, F.col("_h").rlike(p)) for f, p in never.items()], F.lit(False))
        rows = rows.join(told, ["path", "sheet", "col"], "left").withColumn("told", F.when(~barred, F.col("told")))
    else:
        rows = rows.withColumn("told", F.lit(None).cast("string"))
    by = F.when(F.col("told").isNotNull(), "outer").when(F.col("x").isNotNull(), "name")
    named = rows.select("path", "sheet", "col", "header", F.coalesce("told", "x.field").alias("field"), by.alias("by"), F.when(F.col("told").isNull(), F.col("x.tier")).alias("tier"), F.when(F.col("told").isNull(), F.col("x.coverage")).alias("coverage"), F.when(F.col("told").isNull(), F.col("x.preference")).alias("_p"))
    order = Window.partitionBy("path", "sheet", "field").orderBy(F.col("by") != "outer", F.desc("tier"), F.desc("coverage"), F.desc("_p"), "col")
    return named.withColumn("rank", F.when(F.col("field").isNotNull(), F.row_number().over(order))).drop("_p")


def find_headers(cells: DataFrame, scan: int = 8, fields: dict[str, list[str]] = FIELDS, never: dict[str, str] = NEVER) -> DataFrame:
    """(path, sheet, head, n): of the first rows the one that names most fields (the first of several), if it names TRACKER."""
    named = _named(cells.where(F.col("row") < scan).select("path", "sheet", "row", "text"), "text", fields, never).select("path", "sheet", "row", F.col("best.field").alias("field")).where("field is not null")
    rows = named.groupBy("path", "sheet", "row").agg(F.count_distinct("field").alias("n"))
    return rows.groupBy("path", "sheet").agg(F.max_by(F.struct(F.col("row").alias("head"), "n"), F.struct("n", -F.col("row"))).alias("x")).select("path", "sheet", "x.*").where(F.col("n") >= TRACKER)


def _columns(cells: DataFrame, heads: DataFrame, outer: DataFrame | None, fields: dict[str, list[str]], never: dict[str, str]) -> DataFrame:
    heads = materialize(heads, "heads")  # asked for three times
    header = cells.join(heads.select("path", "sheet", "head"), ["path", "sheet"]).where("row = head").select("path", "sheet", "head", "col", F.col("text").alias("header"))
    return bind_columns(header, outer, fields, never).join(heads.select("path", "sheet", "head"), ["path", "sheet"])


def read_trackers(cells: DataFrame, outer: DataFrame | None = None, scan: int = 8, fields: dict[str, list[str]] = FIELDS, never: dict[str, str] = NEVER) -> DataFrame:
    """Values of tracker sheets from cells (path, sheet, row, col, text): path, sheet, row, field, value, number, col, note.

    Each field of a row has the first known cell of its columns by rank. A zero is unknown where no real value is zero.
    number is the figure of areas, rents and prices; a rent under a monthly header is made annual, which note says.
    Coordinates in one column are split into lat and lng, unless columns of their own have these. Rows of totals, and rows
    with fewer than two fields, are none.

    Cells are read several times, so they are written first. Known cells are shuffled once, by row: what follows needs
    no more than a row at a time.
    """
    cells = materialize(cells.select("path", "sheet", "row", "col", "text"), "cells")
    columns = _columns(cells, find_headers(cells, scan, fields, never), outer, fields, never).where("field is not null")
    held = cells.join(columns, ["path", "sheet", "col"]).where(F.col("row") > F.col("head")).select("path", "sheet", "row", "col", "field", "rank", "header", clean_value(F.col("text")).alias("value"))
    figure = normalize_number(F.col("value"))
    known = held.where(~looks_unknown(F.col("value")) & ~(F.col("field").isin(ZERO_IS_UNKNOWN) & F.coalesce(figure == 0, F.lit(False))))
    own = known.repartition("path", "sheet", "row").groupBy("path", "sheet", "row", "field").agg(F.min_by(F.struct("value", "col", "header"), "rank").alias("x")).select("path", "sheet", "row", "field", "x.*")
    at = coords_from_text(F.when(F.col("field") == "latlng", F.col("value")))
    as_is = F.struct("field", "value", F.lit(False).alias("split"))
    half = lambda c: F.struct(F.lit(c).alias("field"), F.col("_at")[c].cast("string").alias("value"), F.lit(True).alias("split"))
    said = F.when(F.col("field") != "latlng", F.array(as_is)).when(F.col("_at").isNotNull(), F.array(half("lat"), half("lng")))
    rows = own.withColumn("_at", at).select("path", "sheet", "row", F.explode(said).alias("x"), "col", "header").select("path", "sheet", "row", "x.*", "col", "header")
    lead = next(iter(fields))
    w = Window.partitionBy("path", "sheet", "row")
    has = {c: F.max((F.col("field") == c) & ~F.col("split")).over(w) for c in ("lat", "lng")}
    rows = rows.withColumns({f"_{c}": x for c, x in has.items()}).where(~F.col("split") | ((F.col("field") == "lat") & ~F.col("_lat")) | ((F.col("field") == "lng") & ~F.col("_lng")))
    total = F.max(F.when(F.col("field") == lead, F.col("value").rlike(r"(?i)^(?:total|sum|average|avg|gesamt|summe|moyenne)\b"))).over(w)
    kept = rows.withColumn("_total", F.coalesce(total, F.lit(False))).withColumn("_n", F.count("*").over(w)).where("_n >= 2 and not _total")
    monthly = (F.col("field") == "warehouseRentVal") & F.lower(F.col("header")).rlike(MONTHLY)
    n = F.when(F.col("field").isin(FIGURES), normalize_number(F.col("value")))
    return kept.select("path", "sheet", "row", "field", "value", F.when(monthly, n * 12).otherwise(n).alias("number"), "col", F.when(monthly, "monthly rent made annual").alias("note"))


def header_report(cells: DataFrame, outer: DataFrame | None = None, scan: int = 8, fields: dict[str, list[str]] = FIELDS, never: dict[str, str] = NEVER) -> DataFrame:
    """(path, sheet, head, populated, mapped, rich, unmapped) of each tracker sheet: how many columns have values and how
    many of these name a field, whether RICH fields or more are named, and the headers of the others, sorted."""
    cells = materialize(cells.select("path", "sheet", "row", "col", "text"), "cells")
    columns = _columns(cells, find_headers(cells, scan, fields, never), outer, fields, never)
    filled = cells.join(columns.select("path", "sheet", "col", "head"), ["path", "sheet", "col"]).where((F.col("row") > F.col("head")) & (F.trim("text") != "")).select("path", "sheet", "col").distinct().withColumn("filled", F.lit(1))
    j = columns.join(filled, ["path", "sheet", "col"], "left")
    other = F.array_sort(F.collect_set(F.when(F.col("field").isNull() & F.col("filled").isNotNull(), F.col("header"))))
    return j.groupBy("path", "sheet", "head").agg(F.count("filled").alias("populated"), F.count_if(F.col("field").isNotNull() & F.col("filled").isNotNull()).alias("mapped"), (F.count_distinct("field") >= RICH).alias("rich"), other.alias("unmapped"))


def map_conflicts(headers: DataFrame, outer: DataFrame, fields: dict[str, list[str]] = FIELDS, never: dict[str, str] = NEVER) -> DataFrame:
    """(path, sheet, col, header, told, named, verdict): where an outer map and the names differ: barred, unknown field,
    or differs."""
    h = F.col("_h")
    named = _named(headers, "header", fields, never).select("path", "sheet", "col", "header", "_h", F.col("best.field").alias("named"))
    j = named.join(outer.select("path", "sheet", "col", F.col("field").alias("told")), ["path", "sheet", "col"])
    barred = F.coalesce(*[F.when(F.col("told") == f, h.rlike(p)) for f, p in never.items()], F.lit(False))
    verdict = F.when(~F.col("told").isin(list(fields)), "unknown field").when(barred, "barred").when(~F.col("told").eqNullSafe(F.col("named")), "differs")
    return j.withColumn("verdict", verdict).where("verdict is not null").drop("_h")
