"""Readings of text and tags: numbers by their last separator, rents, labels, links, map features and headings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import normalize_number
from .text import fold
from .unknown import clean_value, looks_unknown

#: Monthly markers, map features and words of drawings.
MONTHLY = r"(?i)/\s*(?:month|monat|mese|maand|mies\w*|mês|mois|mes|mo)\b|\bper\s+month\b|\bp\.\s?m\b|monatlich|mensile|mensual|mensuel|miesięcznie"
CUES = ["floor plan", "site plan", "layout", "elevation", "section", "drawing"]


def to_float(c: Column) -> Column:
    """A number whose last separator is the decimal point, unless three digits follow a comma (or a point, alone)."""
    n = F.regexp_extract(F.regexp_replace(c, r"\s", ""), r"-?\d[\d.,]*\d|-?\d", 0)
    last = F.regexp_extract(n, r"([.,])\d*$", 1)
    grouped = n.rlike(r",\d{3}$") | (n.rlike(r"\.\d{3}$") & ~n.rlike(r",") & ~n.rlike(r"\.\d{1,2}(?!\d)"))
    whole = F.regexp_replace(n, "[.,]", "")
    parts = F.concat(F.regexp_replace(F.regexp_replace(n, r"[.,]\d*$", ""), "[.,]", ""), F.lit("."), F.regexp_extract(n, r"[.,](\d*)$", 1))
    return F.when(n == "", None).when((last == "") | grouped, whole.try_cast("double")).otherwise(parts.try_cast("double"))


def annual_rent(said: Column) -> Column:
    """(value, note): the figure by year; monthly ones twelve times, ranges and unknown ones null."""
    v = normalize_number(said)
    monthly = F.coalesce(said.rlike(MONTHLY), F.lit(False))
    return F.struct(F.round(F.when(monthly, v * 12).otherwise(v), 4).alias("value"), F.when(v.isNotNull(), F.when(monthly, "monthly x 12").otherwise("annual")).alias("note"))


def is_land(area: Column, plot: Column, land_price: Column) -> Column:
    return ~F.coalesce(area > 0, F.lit(False)) & (F.coalesce(plot > 0, F.lit(False)) | ~looks_unknown(land_price))


def map_feature(tags: Column) -> Column:
    """air, port, rail, border or city of a feature's tags; null for others, marinas and security checks."""
    tag = lambda k: F.coalesce(F.try_element_at(tags, F.lit(k)), F.lit(""))
    return (
        F.when((tag("aeroway") == "aerodrome") & ~tag("military").isin("airfield", "yes"), "air").when((tag("harbour") == "yes") & (tag("leisure") != "marina"), "port").when(tag("railway").isin("station", "yard"), "rail")
        .when((tag("barrier") == "border_control") & (tag("level") == "") & (tag("building") == ""), "border").when(tag("place").isin("city", "town"), "city")
    )


def drawing_marker(c: Column) -> Column:
    """A cue word and a scale from 1:50 to 1:2500 that no area unit follows."""
    t = fold(c)
    scale = F.regexp_extract(t, r"\b1\s?[:/]\s?(\d{2,4})\b(?!\s*(?:sq|m2|ha|acre))", 1).try_cast("int")
    return F.exists(F.array(*[t.contains(w) for w in CUES]), lambda x: x) & F.coalesce(scale.between(50, 2500), F.lit(False))


def labelled(c: Column, labels: dict[str, list[str]]) -> Column:
    """A map of field to value from lines `Label: value`; of several lines for a field the first."""
    def one(names: list[str]) -> Column:
        v = F.regexp_extract(c, rf"(?im)^[ \t]*(?:{'|'.join(names)})[ \t]*[:\-][ \t]*(\S[^\n]*?)[ \t]*$", 1)
        return F.when(v != "", v)

    both = F.map_from_arrays(F.array(*map(F.lit, labels)), F.array(*map(one, labels.values())))
    return F.map_filter(both, lambda k, v: v.isNotNull())


def links(c: Column) -> Column:
    """Distinct web addresses, without the punctuation that ends a sentence."""
    found = F.regexp_extract_all(c, F.lit(r"(https?://[^\s<>\"')\]]+)"), 1)
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, "[.,;:!?]+$", "")))


def region_of_name(stem: Column) -> Column:
    """(label, confidence): the part after the last spaced dash without closing remarks, else the whole name."""
    bare = F.regexp_replace(stem, r"(?i)(?:[\s_-]+(?:final|draft|v\d+|\(\d+\)))+$", "")
    tail = F.regexp_extract(bare, r"^.*\s[-–—]\s+(.+)$", 1)
    return F.struct(clean_value(F.when(tail != "", tail).otherwise(bare)).alias("label"), F.when(tail != "", "high").otherwise("low").alias("confidence"))


def plain_number(c: Column) -> Column:
    """A number as short text: six significant digits, no closing zeros."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.6g", c), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def resized(url: Column, host: str, most: int, quality: int) -> Column:
    """An image address of the host with width and quality asked for; other addresses stay."""
    base = F.regexp_replace(url, r"\?.*$", "")
    return F.when(F.regexp_extract(url, "^https?://([^/?#]+)", 1).endswith(host), F.concat(base, F.lit(f"?w={most}&q={quality}"))).otherwise(url)


def normalise_header(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")))


def client_of(stem: Column) -> Column:
    """A client's name from a file name: before the first word that tells the kind of document."""
    head = F.regexp_extract(F.regexp_replace(stem, "[_-]+", " "), r"(?i)^(.*?)\s*\b(?:longlist|tracker|brochures?|shortlist|requirements?)\b", 1)
    return F.when(head != "", F.trim(head))


def requirement_id(url: Column) -> Column:
    return F.regexp_extract(url, r"/requirements/(\d+)", 1).try_cast("long")


def view_url(pano: Column, lat: Column, lng: Column) -> Column:
    """An address of a street view by its id, else by its place; null without either."""
    base = F.lit("https://maps.example/@?api=1&map_action=pano")
    return F.when(pano.isNotNull(), F.concat(base, F.lit("&pano="), pano)).when(lat.isNotNull() & lng.isNotNull(), F.concat(base, F.lit("&viewpoint="), lat.cast("string"), F.lit(","), lng.cast("string")))


def lexicon_hits(c: Column, words: list[str]) -> Column:
    """How many of the words stand in the text, between letters' boundaries, accents and case aside."""
    t = fold(c)
    hits = [t.rlike(rf"(?<![\p{{L}}]){w}(?![\p{{L}}])").cast("int") for w in words]
    return sum(hits[1:], hits[0])


def enum_token(c: Column, filler: str) -> Column:
    """A grade or state without filler words, lower case."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), rf"\b(?:{filler})\b", " "), r"[^a-z0-9+]+", " "))


def hedged(c: Column) -> Column:
    return F.coalesce(c.rlike(r"(?i)\b(?:target(?:ing|ed)?|expected|tbc)\b"), F.lit(False))


def dash_null(c: Column) -> Column:
    """A cell in which a dash or n/a means nothing."""
    return F.when(~F.lower(F.trim(c)).isin("-", "–", "—", "na", "n/a", ""), c)


def month_key(c: Column) -> Column:
    """Year * 12 + month of an ISO date or of `April 2026`; null otherwise."""
    iso = F.regexp_extract(c, r"^\s*(\d{4})-(\d{2})", 0)
    day = F.coalesce(F.try_to_timestamp(F.when(iso != "", F.concat(F.trim(iso), F.lit("-01"))), F.lit("yyyy-MM-dd")), F.try_to_timestamp(F.initcap(F.regexp_extract(c, r"^\s*([A-Za-z]{3,9}\s+\d{4})\s*$", 1)), F.lit("MMMM yyyy")))
    return F.year(day) * 12 + F.month(day)
