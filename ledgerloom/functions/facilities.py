"""Facilities of map and directory exports, boundaries, and keys and names made from records."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import normalize_number

#: Words of posts that no road crosses at, bare unit designators, and page admission.
NO_CROSSING = r"(?iu)customs|aduana|douane|zoll|dogana|alfandega|alfândega|celni|celní|passport|inland border|ticket|check-?in|waiting|dry port|bonded|security"
BARE_UNIT = r"(?i)^units?\b[\s\w\-/&]{0,4}$"
PAGE_CHARS, TEXT_SHARE = 80, 0.5


def _tag(tags: Column, key: str) -> Column:
    return F.coalesce(F.try_element_at(tags, F.lit(key)), F.lit(""))


def is_road_crossing(tags: Column) -> Column:
    """A border post on a road: no indoor post, no building, no customs office or booth."""
    named = F.map_values(F.map_filter(tags, lambda k, v: k.isin("name", "name:en", "int_name", "official_name", "description")))
    indoor = F.map_contains_key(tags, "level") | F.map_contains_key(tags, "building")
    office = _tag(tags, "amenity").isin("customs", "security_control") | F.array_join(named, " ").rlike(NO_CROSSING)
    return (_tag(tags, "barrier") == "border_control") & ~indoor & ~office


def crossing_name(tags: Column, country: Column) -> Column:
    """The first name there is, marked as a border; else the country's."""
    names = [F.nullif(F.trim(_tag(tags, k)), F.lit("")) for k in ("name", "name:en", "int_name")]
    name = F.coalesce(*names, F.concat(country, F.lit(" border crossing")))
    return F.when(F.lower(name).endswith("border"), name).otherwise(F.concat(name, F.lit(" (Border)")))


def crossing_pair(tags: Column) -> Column:
    """`PL/DE` where some tag names both countries."""
    said = F.array_join(F.map_values(tags), " ")
    pair = r"\b([A-Z]{2})\s*[/-]\s*([A-Z]{2})\b"
    return F.when(said.rlike(pair), F.concat_ws("/", F.regexp_extract(said, pair, 1), F.regexp_extract(said, pair, 2)))


def facility(row: Column) -> Column:
    """(name, kind, lat, lng, size) of a row of one of four exports, told by its keys; null for rows that are no facility.

    Airports need scheduled service (or public access) and a large or medium size, ports must be ports or terminals.
    """
    has = lambda k: F.map_contains_key(row, k)
    number = lambda k: F.round(_tag(row, k).try_cast("double"), 4)
    size = F.regexp_replace(_tag(row, "type"), "_airport$", "")
    sized = size.isin("large", "medium")
    out = lambda name, kind, lat, lng, size: F.struct(name.alias("name"), F.lit(kind).alias("kind"), number(lat).alias("lat"), number(lng).alias("lng"), size.cast("string").alias("size"))
    served = F.coalesce(F.try_element_at(row, F.lit("has_scheduled_service")), _tag(row, "scheduled_service")).isin("1", "yes")
    name, none = _tag(row, "name"), F.lit(None)
    found = (
        F.when(has("latitude_deg"), F.when(sized & served, out(name, "air", "latitude_deg", "longitude_deg", size)))
        .when(has("TERMINAL_NAME"), F.when(_tag(row, "TERMINAL_NAME") != "", out(_tag(row, "TERMINAL_NAME"), "rail", "LATITUDE", "LONGITUDE", none)))
        .when(has("restriction"), F.when(sized & (_tag(row, "restriction") == "public"), out(name, "air", "lat", "lon", size)))
        .when((name != "") & F.coalesce(F.try_element_at(row, F.lit("itemtype_id")), F.lit("port")).isin("port", "terminal"), out(F.concat(name, F.lit(" (Port)")), "port", "lat", "lng", none))
    )
    return F.when(found["lat"].isNotNull() & found["lng"].isNotNull(), found)


def boundary(geometry: Column) -> Column:
    """(box, polygons) of a GeoJSON polygon or multipolygon; box is west, south, east, north. Null for other shapes."""
    kind, at = F.get_json_object(geometry, "$.type"), F.get_json_object(geometry, "$.coordinates")
    polygons = F.when(kind == "Polygon", F.array(F.from_json(at, "array<array<array<double>>>"))).when(kind == "MultiPolygon", F.from_json(at, "array<array<array<array<double>>>>"))
    points = F.flatten(F.flatten(polygons))
    x, y = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    return F.when(F.size(points) > 0, F.struct(F.array(F.array_min(x), F.array_min(y), F.array_max(x), F.array_max(y)).alias("box"), polygons.alias("polygons")))


def _marked() -> tuple[str, str]:
    """Letters that are an ASCII letter with marks, and these letters; others (ł, ø) are letters of their own."""
    parts = [(chr(c), unicodedata.normalize("NFKD", chr(c))) for c in range(0xC0, 0x250)]
    plain = [(a, b[0]) for a, b in parts if len(b) > 1 and b[0].isascii() and all(map(unicodedata.combining, b[1:]))]
    return "".join(a for a, _ in plain), "".join(b for _, b in plain)


_MARKED = _marked()


def without_marks(c: Column) -> Column:
    return F.regexp_replace(F.translate(c, *_MARKED), r"\p{M}", "")


def loose_key(c: Column) -> Column:
    """Equal for names that differ in case, accents and separators only; other letters stay."""
    return F.regexp_replace(F.replace(F.lower(without_marks(c)), F.lit("ß"), F.lit("ss")), r"[^\p{L}\p{N}]", "")


def region_label_key(label: Column, country: Column, city: Column) -> Column:
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.lower(without_marks(F.coalesce(c, F.lit("")))), "[^a-z0-9 ]", " "), r"\s+", " "))
    return F.concat_ws("|", plain(label), F.upper(F.trim(F.coalesce(country, F.lit("")))), plain(city))


def source_identity(relpath: Column, name: Column) -> Column:
    return F.coalesce(F.nullif(relpath, F.lit("")), name, F.lit(""))


def ledger_confidence(locator: Column, source_type: Column) -> Column:
    """Medium for what was read by eye or from the web, High for structured cells."""
    seen = F.lower(F.coalesce(locator, F.lit(""))).rlike("vision|interpretation")
    return F.when(seen | F.coalesce(source_type.isin("image", "web"), F.lit(False)), "Medium").otherwise("High")


def zero_as_unknown(raw: Column) -> Column:
    return F.when(F.coalesce(normalize_number(raw) == 0, F.lit(False)), None).otherwise(raw)


def street_point(lat: Column, lng: Column, precision: Column) -> Column:
    """(lat, lng) where the place is known to the street at least."""
    return F.when(precision.isin("rooftop", "street") & lat.isNotNull() & lng.isNotNull(), F.struct(lat.alias("lat"), lng.alias("lng")))


def route_key(trucks: Column, lat: Column, lng: Column, to_lat: Column, to_lng: Column) -> Column:
    """Key of a cached route; those of trucks and of cars never meet."""
    point = lambda a, b: F.concat_ws(",", a.cast("string"), b.cast("string"))
    return F.concat(F.when(trucks, "hgv|").otherwise(""), point(lat, lng), F.lit(";"), point(to_lat, to_lng))


def last_verdict(c: Column) -> Column:
    said = F.regexp_extract_all(c, F.lit(r"(?im)^[\s*#]*verdict\s*:\s*\**\s*([A-Za-z][A-Za-z -]*[A-Za-z])"), F.lit(1))
    return F.lower(F.try_element_at(said, F.lit(-1)))


def ranked_item(c: Column) -> Column:
    """(rank, title) of a heading `### 3. Title`; without a number rank is null."""
    head = r"(?s)^###\s+(\d+)\.\s*([^\n]*).*$"
    numbered = c.rlike(head)
    plain = F.trim(F.regexp_replace(F.regexp_extract(c, r"^([^\n]*)", 1), r"^[#\s]+", ""))
    return F.struct(F.when(numbered, F.regexp_extract(c, head, 1).try_cast("int")).alias("rank"), F.when(numbered, F.trim(F.regexp_extract(c, head, 2))).otherwise(plain).alias("title"))


def safe_filename(raw: Column, mime: Column, most: int = 80) -> Column:
    """A name that opens: the stem is cleaned and cut, the extension kept (or taken from the type)."""
    own = F.regexp_extract(raw, r"\.([A-Za-z0-9]{1,10})$", 1)
    guess = F.substring(F.regexp_replace(F.regexp_extract(mime, r"/([^/;]*)(?:;.*)?$", 1), "[^A-Za-z0-9]", ""), 1, 6)
    ext = F.coalesce(F.nullif(own, F.lit("")), F.nullif(guess, F.lit("")))
    stem = F.when(own != "", F.regexp_replace(raw, r"\.[A-Za-z0-9]{1,10}$", "")).otherwise(raw)
    clean = F.trim(F.regexp_replace(F.regexp_replace(stem, r"""[\\/:*?"<>|]""", "-"), r"\s+", " "))
    cut = F.rtrim(F.substring(F.btrim(clean, F.lit(". ")), F.lit(1), F.lit(most) - F.coalesce(F.char_length(ext) + 1, F.lit(0))))
    return F.concat(F.coalesce(F.nullif(cut, F.lit("")), F.lit("attachment")), F.coalesce(F.concat(F.lit("."), ext), F.lit("")))


def property_folder(order: Column, name: Column, postcode: Column) -> Column:
    return F.concat_ws(" - ", F.lpad(order.cast("string"), 2, "0"), name, F.nullif(postcode, F.lit("")))


def display_name(name: Column, line1: Column, line2: Column) -> Column:
    """A title that tells units apart: a bare `Unit 2` is joined by the first part of the address that is none."""
    name = F.nullif(F.trim(name), F.lit(""))
    parts = F.filter(F.transform(F.split(F.concat_ws(",", line1, line2), ","), lambda x: F.trim(x)), lambda x: x != "")
    scheme = F.try_element_at(F.filter(parts, lambda x: ~x.rlike(BARE_UNIT)), F.lit(1))
    unit = F.try_element_at(F.filter(parts, lambda x: x.rlike(BARE_UNIT)), F.lit(1))
    enriched = F.when(scheme.isNull() | F.contains(F.lower(name), F.lower(scheme)), name).otherwise(F.concat_ws(", ", name, scheme))
    return F.when(name.isNotNull() & ~name.rlike(BARE_UNIT), name).when(name.isNotNull(), enriched).otherwise(F.coalesce(F.when(scheme.isNotNull(), F.concat_ws(", ", unit, scheme)), F.nullif(F.array_join(parts, ", "), F.lit("")), F.lit("tbd")))
