"""What is done to merged records before they are shown: canonical rents, pins, routes, trackers, and their gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.cleaning import header_field
from ledgerloom.functions.geo import coords_from_text
from ledgerloom.functions.numbers import normalize_number, plausible, rent_band, rent_unit_of_text
from ledgerloom.functions.parsing import plain_number
from ledgerloom.functions.text import stated_year
from ledgerloom.functions.unknown import clean_value, looks_unknown

#: Words for a month's rent, short map links, columns of a tracker by language.
MONTHLY = r"(?i)/\s*(?:month|monat|mese|maand|mies\w*|mês|mois|mes|mo)\b|\bper\s+month\b|\bp\.\s?m\b|monatlich|mensile|mensual|mensuel|miesięcznie"
MAP_LINK = r"(?i)^https?://(?:maps\.app\.goo\.gl|goo\.gl/maps|(?:www\.|maps\.)?google\.[a-z.]+/maps|maps\.google\.)"
SHORT_LINK = r"(?i)^https?://(?:maps\.app\.goo\.gl|goo\.gl/maps)/"
ALIASES = {
    "park": ["park", "property", "scheme", "name", "objekt", "parc", "parque"],
    "city": ["city", "town", "location", "ort", "stadt", "ville", "ciudad"],
    "area": ["area", "size", "gla", "fläche", "surface", "superficie"],
    "rent": ["rent", "asking rent", "miete", "loyer", "renta"],
}
NEVER = {"rent": "free|period", "area": "office|plot"}


def rent_display(value: Column, unit: Column) -> Column:
    """An annual rent in its own convention; without a unit the number says so."""
    part = F.split(unit, "/")
    money, per = F.coalesce(F.nullif(part[0], F.lit("")), F.lit("€")), F.coalesce(F.nullif(F.get(part, 1), F.lit("")), F.lit("sq m"))
    return F.when(unit.isNull(), F.concat(plain_number(value), F.lit(" (unit not stated)"))).otherwise(F.concat(money, plain_number(value), F.lit(" / "), per, F.lit(" / year")))


def stated_rent(said: Column, unit: Column) -> Column:
    """(value, unit) that a text quotes: a month's rent for the year, null outside the unit's plausible band."""
    known = F.coalesce(unit, rent_unit_of_text(said))
    number = normalize_number(said)
    number = F.when(said.rlike(MONTHLY), F.round(number * 12, 2)).otherwise(number)
    ok = ~looks_unknown(said) & (plausible(number, rent_band(known)) == "pass")
    return F.when(ok, F.struct(number.alias("value"), known.alias("unit")))


def canonical_rent(value: Column, said: Column, unit: Column) -> Column:
    """(value, unit, said): the text is made from the number where there is one, and the number from the text where not."""
    u = F.coalesce(unit, F.when(~looks_unknown(said), rent_unit_of_text(said)))
    found = stated_rent(said, unit)
    kept = F.struct(value.alias("value"), unit.alias("unit"), said.alias("said"))
    return (
        F.when(value.isNotNull(), F.struct(value.alias("value"), u.alias("unit"), rent_display(value, u).alias("said")))
        .when(found.isNotNull(), F.struct(found["value"].alias("value"), found["unit"].alias("unit"), rent_display(found["value"], found["unit"]).alias("said")))
        .otherwise(kept)
    )


def office_area(said: Column) -> Column:
    """An office's area as a number; a share of the whole is none."""
    n = normalize_number(said)
    return F.when(~looks_unknown(said) & ~said.contains("%") & (n > 0), n)


def expansion_value(said: Column) -> Column:
    n = normalize_number(said)
    return F.when(n >= 1000, n)


def backfill_pins(records: DataFrame, key: str, pages: DataFrame) -> DataFrame:
    """records (key, lat, lng, map_link) with what their pages (key, page, link, text) offer, only where it is absent.

    The first page with a pair of coordinates gives them, its link before its text; the first map link is kept. Adds `pin`:
    own, link, text or null.
    """
    by_link, by_text = coords_from_text(F.col("link")), coords_from_text(F.col("text"))
    pin = F.coalesce(F.when(by_link.isNotNull(), F.struct(by_link["lat"].alias("lat"), by_link["lng"].alias("lng"), F.lit("link").alias("by"))), F.when(by_text.isNotNull(), F.struct(by_text["lat"].alias("lat"), by_text["lng"].alias("lng"), F.lit("text").alias("by"))))
    offered = pages.select(key, "page", pin.alias("pin"), F.when(F.col("link").rlike(MAP_LINK), F.col("link")).alias("link"))
    first = offered.groupBy(key).agg(F.min_by("pin", F.when(F.col("pin").isNotNull(), F.col("page"))).alias("_pin"), F.min_by("link", F.when(F.col("link").isNotNull(), F.col("page"))).alias("_link"))
    own = F.col("lat").isNotNull() & F.col("lng").isNotNull()
    j = records.join(first, key, "left")
    at = lambda c: F.when(own, F.col(c)).otherwise(F.col("_pin")[c]).alias(c)
    return j.select(*[c for c in records.columns if c not in ("lat", "lng", "map_link")], at("lat"), at("lng"), F.coalesce("map_link", "_link").alias("map_link"), F.when(own, "own").otherwise(F.col("_pin.by")).alias("pin"))


def follow_links(records: DataFrame, cache: DataFrame) -> DataFrame:
    """Records without coordinates take those of their short map link from the cache (link, lat, lng), and are exact then.

    A link that the cache has with several places gives the smallest of them, so records never multiply; with a column
    `cached_at` in the cache, the last one cached.
    """
    place = F.struct("lat", "lng")
    one = F.max_by(place, F.struct("cached_at", place)) if "cached_at" in cache.columns else F.min(place)
    hit = cache.where("lat is not null and lng is not null").groupBy(F.col("link").alias("map_link")).agg(one.alias("_at")).select("map_link", F.col("_at.lat").alias("_lat"), F.col("_at.lng").alias("_lng"))
    j = records.join(hit, "map_link", "left")
    take = F.col("lat").isNull() & F.col("map_link").rlike(SHORT_LINK) & F.col("_lat").isNotNull()
    new = {"lat": F.col("_lat"), "lng": F.col("_lng"), "approx": F.lit(False)}
    return j.select(*[F.when(take, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in records.columns])


def pin_defects(records: DataFrame, key: str, pages: DataFrame) -> DataFrame:
    """(key, state, offers): records with an approximate pin or none whose own link or page text offers a better one."""
    said = pages.where(coords_from_text(F.col("text")).isNotNull()).select(key).distinct().withColumn("_said", F.lit(True))
    bare = F.col("lat").isNull() | F.col("lng").isNull()
    offers = F.array_compact(F.array(F.when(F.col("map_link").rlike(MAP_LINK), "map link"), F.when(F.col("_said"), "page text")))
    j = records.where(bare | F.coalesce(F.col("approx"), F.lit(False))).join(said, key, "left")
    return j.select(key, F.when(bare, "none").otherwise("approximate").alias("state"), offers.alias("offers")).where(F.size("offers") > 0)


def route_maps(records: DataFrame, key: str, routes: DataFrame) -> DataFrame:
    """Located records with their cached routes (key, target, minutes, km) as a map by target; the last one cached counts."""
    newest = routes.groupBy(key, "target").agg(F.max_by(F.struct("minutes", "km"), "seq").alias("x"))
    maps = newest.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("target", "x")))).alias("routes"))
    return records.where("lat is not null and lng is not null").join(maps, key, "left")


def region_findings(regions: DataFrame, year: int, month: int) -> DataFrame:
    """(code, rule, severity) for profiles (code, unemployment, unemployment_as_of, gdp, gdp_as_of, sources, recency_note).

    Unemployment may be a year old, or two until May with a note on the search; older figures of the economy are a note. Two
    regions with one figure are a note on the later one.
    """
    u, g = F.col("unemployment"), F.col("gdp")
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    of = stated_year(F.col("unemployment_as_of"))
    late = (of == year - 2) & F.lit(month <= 5) & ~blank("recency_note")
    rule = lambda when, name, severity: F.when(when, F.struct(F.lit(name).alias("rule"), F.lit(severity).alias("severity")))
    rules = F.array_compact(F.array(
        rule((u.isNotNull() | g.isNotNull()) & blank("sources"), "no sources", "issue"),
        rule(u.isNotNull() & blank("unemployment_as_of"), "unemployment without a date", "issue"),
        rule(g.isNotNull() & blank("gdp_as_of"), "gdp without a date", "issue"),
        rule(u.isNotNull() & ~u.between(0, 60), "unemployment out of range", "note"),
        rule(u.isNotNull() & ~blank("unemployment_as_of") & of.isNull(), "date without a year", "issue"),
        rule(u.isNotNull() & (of < year - 1) & late, "two years old", "note"),
        rule(u.isNotNull() & (of < year - 1) & ~late, "too old", "issue"),
        rule(g.isNotNull() & (stated_year(F.col("gdp_as_of")) < year - 2), "gdp is old", "note"),
    ))
    own = regions.select("code", F.explode(rules).alias("x")).select("code", "x.*")
    for figure in ("unemployment", "gdp"):
        first = regions.where(F.col(figure).isNotNull()).groupBy(figure).agg(F.min("code").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
        same = regions.join(first, figure).where("code <> _first").select("code", F.lit(f"shares its {figure}").alias("rule"), F.lit("note").alias("severity"))
        own = own.unionByName(same)
    return own


def tracker_rows(cells: DataFrame, aliases: dict[str, list[str]] = ALIASES, never: dict[str, str] = NEVER, scan: int = 8) -> DataFrame:
    """Records of tracker sheets from cells (path, sheet, row, col, text): path, sheet, row, and a column for each field.

    The header is the first of the rows before `scan` that names most fields; three make a tracker. A field is the first
    column that names it. Rows of totals, and rows with fewer than two fields, are none; a zero is unknown.
    """
    named = cells.where(F.col("row") < scan).withColumn("field", header_field(F.col("text"), aliases, never)).where("field is not null")
    heads = named.groupBy("path", "sheet", "row").agg(F.count_distinct("field").alias("n")).groupBy("path", "sheet").agg(F.max_by(F.struct(F.col("row").alias("head"), "n"), F.struct("n", -F.col("row"))).alias("x")).select("path", "sheet", "x.*").where("n >= 3")
    columns = named.join(heads, ["path", "sheet"]).where("row = head").groupBy("path", "sheet", "head", "field").agg(F.min("col").alias("col"))
    values = cells.join(columns, ["path", "sheet", "col"]).where(F.col("row") > F.col("head")).select("path", "sheet", "row", "field", clean_value(F.col("text")).alias("value"))
    zero = normalize_number(F.col("value")) == 0
    known = values.where(~looks_unknown(F.col("value")) & ~(F.col("field").isin("area", "rent") & F.coalesce(zero, F.lit(False))))
    rows = known.groupBy("path", "sheet", "row").pivot("field", list(aliases)).agg(F.first("value"))
    total = F.coalesce(F.col(next(iter(aliases))).rlike(r"(?i)^(?:total|sum|average|avg|gesamt|summe|moyenne)\b"), F.lit(False))
    filled = sum((F.col(f).isNotNull().cast("int") for f in aliases), F.lit(0))
    return rows.where(~total & (filled >= 2))


def merge_aliases(base: dict[str, list[str]], more: dict[str, list[str]], blocked: dict[str, set[str]]) -> dict[str, list[str]]:
    """base with the aliases of a learned table added, except the blocked ones and those that another field has."""
    taken = {a: f for f, names in base.items() for a in names}
    out = {f: list(names) for f, names in base.items()}
    for field, names in more.items():
        for a in (n.strip().lower() for n in names):
            if a and a not in blocked.get(field, set()) and taken.setdefault(a, field) == field and a not in out.setdefault(field, []):
                out[field].append(a)
    return out


def verified_picks(picks: DataFrame, pages: DataFrame) -> DataFrame:
    """Picks (deck, page, quote, text_hash, said) whose deck (deck, page, text, deck_hash) is unchanged and has the quote on that page."""
    plain = lambda c: F.lower(clean_value(c))
    j = picks.join(pages.select("deck", "page", "text", "deck_hash"), ["deck", "page"])
    fresh = F.col("text_hash").isNull() | (F.col("text_hash") == F.col("deck_hash"))
    return j.where(fresh & (plain(F.col("quote")) != "") & plain(F.col("text")).contains(plain(F.col("quote")))).select("deck", "page", clean_value(F.col("said")).alias("said"))


def enrichment_trace(found: DataFrame, key: str, source: str, kind: str) -> DataFrame:
    """Audit rows for what enrichment filled in (key, field, value, place): values are cut to 60 characters."""
    lit = lambda v, name: F.lit(v).alias(name)
    return found.select(F.col(key).alias("property_id"), lit("property", "record_type"), "field", F.substring(F.col("value").cast("string"), 1, 60).alias("value"), lit(source, "source_file"), F.col("place").alias("source_locator"), lit(kind, "source_type"), lit("enrich", "extractor"), lit("Medium", "confidence"))


def without_flags(df: DataFrame, flags: tuple[str, ...] = ("_",)) -> DataFrame:
    """df without its working columns, which start with one of the flags."""
    return df.select(*["`" + c.replace("`", "``") + "`" for c in df.columns if not c.startswith(flags)])
