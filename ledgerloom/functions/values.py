"""Values of records: completeness, equality of facts, names of countries and families of sources."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import normalize_number
from .text import fold
from .unknown import clean_value, looks_unknown

#: Country names (folded) by code; other names stay as they are.
COUNTRIES = {
    "ES": ["spain", "espana", "espagne", "spanien"], "PT": ["portugal"], "FR": ["france", "francia", "frankreich"], "DE": ["germany", "deutschland", "alemania", "allemagne"],
    "IT": ["italy", "italia", "italie", "italien"], "NL": ["netherlands", "the netherlands", "holland", "nederland"], "BE": ["belgium", "belgique", "belgie", "belgien"], "LU": ["luxembourg", "luxemburg"],
    "AT": ["austria", "osterreich"], "CH": ["switzerland", "schweiz", "suisse", "svizzera"], "GB": ["united kingdom", "uk", "great britain", "england"], "IE": ["ireland", "eire"],
    "PL": ["poland", "polska", "polen"], "CZ": ["czech republic", "czechia", "cesko", "ceska republika"], "SK": ["slovakia", "slovensko"], "HU": ["hungary", "magyarorszag", "ungarn"],
    "RO": ["romania"], "BG": ["bulgaria"], "HR": ["croatia", "hrvatska"], "SI": ["slovenia", "slovenija"], "RS": ["serbia", "srbija"], "GR": ["greece", "hellas", "ελλαδα"],
    "DK": ["denmark", "danmark"], "SE": ["sweden", "sverige"], "NO": ["norway", "norge"], "FI": ["finland", "suomi"], "EE": ["estonia", "eesti"], "LV": ["latvia", "latvija"], "LT": ["lithuania", "lietuva"],
    "TR": ["turkey", "turkiye"], "UA": ["ukraine", "ukraina"], "MA": ["morocco", "maroc", "marruecos"], "US": ["united states", "usa"], "IS": ["iceland", "island"], "CY": ["cyprus", "kypros", "kibris", "κυπρος"],
    "MT": ["malta"], "LI": ["liechtenstein"], "AL": ["albania", "shqiperia"], "MK": ["north macedonia", "macedonia", "severna makedonija", "makedonija"], "BA": ["bosnia and herzegovina", "bosnia", "bosna i hercegovina"],
    "ME": ["montenegro", "crna gora"], "XK": ["kosovo", "kosova"], "MD": ["moldova"], "BY": ["belarus"], "AD": ["andorra"], "MC": ["monaco"], "SM": ["san marino"],
}
#: Units of the same family in the family's own unit.
SCALES = {"m": ("length", 1.0), "km": ("length", 1000.0), "kva": ("power", 1.0), "mva": ("power", 1000.0), "kw": ("load", 1.0), "mw": ("load", 1000.0), "sq ft": ("area", 1.0), "sq m": ("area", 10.7639104), "kn/sq m": ("floor", 1.0)}
FAMILIES = {"tracker": ["xlsx", "csv"], "brochure": ["pdf", "pptx"], "mail": ["eml", "msg"], "image": ["jpg", "jpeg", "png"]}


def country_iso(c: Column) -> Column:
    """Two letters pass in upper case (UK and EL renamed), known names become codes, the rest stays."""
    s = clean_value(c)
    known = F.create_map(*[F.lit(x) for code, names in COUNTRIES.items() for n in names for x in (n, code)])
    upper = F.upper(s)
    short = F.when(upper == "UK", "GB").when(upper == "EL", "GR").otherwise(upper)
    return F.when(s.rlike(r"^\p{L}{2}$"), short).otherwise(F.coalesce(F.try_element_at(known, F.btrim(fold(s), F.lit(" ."))), s))


def core_fill(*groups: list[Column]) -> Column:
    """Share of the facts present; each fact may stand in any of its columns."""
    have = [F.exists(F.array(*[~looks_unknown(c.cast("string")) for c in g]), lambda x: x) for g in groups]
    return sum((h.cast("double") for h in have[1:]), have[0].cast("double")) / len(have)


def scaled(c: Column) -> Column:
    """(value, family) of a number with a unit: in the family's unit; a bare number has family null, an unknown unit no value."""
    unit = F.lower(F.trim(F.regexp_extract(c, r"^\s*-?[\d.,\s]*\d\s*(.*?)\s*$", 1)))
    value = normalize_number(F.regexp_extract(c, r"^\s*(-?[\d.,\s]*\d)", 1))
    factor = F.create_map(*[F.lit(x) for u, (_, f) in SCALES.items() for x in (u, f)])
    family = F.create_map(*[F.lit(x) for u, (n, _) in SCALES.items() for x in (u, n)])
    return F.struct(F.when(unit == "", value).otherwise(value * F.try_element_at(factor, unit)).alias("value"), F.try_element_at(family, unit).alias("family"))


def same_fact(a: Column, b: Column) -> Column:
    """Equal text, or numbers of one family (bare ones fit any) within a thousandth."""
    x, y = scaled(a), scaled(b)
    near = F.abs(x["value"] - y["value"]) <= 0.001 * F.greatest(F.abs(x["value"]), F.abs(y["value"]))
    kin = x["family"].isNull() | y["family"].isNull() | (x["family"] == y["family"])
    return F.coalesce(F.lower(clean_value(a)) == F.lower(clean_value(b)), F.lit(False)) | F.coalesce(near & kin, F.lit(False))


def record_family(name: Column) -> Column:
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    out = F.lit("other")
    for family, kinds in FAMILIES.items():
        out = F.when(ext.isin(kinds), family).otherwise(out)
    return out


def text_key(c: Column, target: str) -> Column:
    """Key of a text in a translation cache: exact for equal texts."""
    return F.sha2(F.concat_ws("\u0000", F.lit(target), c).cast("binary"), 256)
