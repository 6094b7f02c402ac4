"""Repairs of single records: certificates in the wrong field, odd keys, prose and claims, postcodes and ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .unknown import clean_value, looks_unknown

#: Grades, texts that quote no rent, and postcode shapes by country.
GRADES = ["pass", "good", "very good", "excellent", "outstanding"]
NO_RENT = ["- non-quoting", "non-quoting", "rent on application", "roa", "-", "poa", ""]
POSTCODES = {
    "united kingdom": r"\b([A-Za-z]{1,2}\d[A-Za-z\d]?\s*\d[A-Za-z]{2})\b", "uk": r"\b([A-Za-z]{1,2}\d[A-Za-z\d]?\s*\d[A-Za-z]{2})\b", "netherlands": r"\b(\d{4}\s*[A-Za-z]{2})\b",
    "germany": r"\b(\d{5})\b", "france": r"\b(\d{5})\b", "spain": r"\b(\d{5})\b", "italy": r"\b(\d{5})\b", "poland": r"\b(\d{2}-\d{3})\b", "belgium": r"\b(\d{4})\b",
}
POSTCODE = r"\b(\d{4,5}(?:-\d{3})?)\b"
LANGUAGES = {"en": ["en", "english", "englisch", "anglais"], "de": ["de", "german", "deutsch", "allemand"], "fr": ["fr", "french", "français", "francais"], "es": ["es", "spanish", "español", "espanol", "castellano"], "it": ["it", "italian", "italiano"], "pl": ["pl", "polish", "polski"]}
_BAND = r"(?i)^\s*(?:epc\s*:?\s*)?(?:target\s+)?[a-g]\+{0,2}\s*$"
_GRADE = r"(?i)\b(?:breeam|pass|good|excellent|outstanding)\b"


def grade_core(c: Column) -> Column:
    """A grade without remarks in parentheses, lower case."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\(.*?\)", "")))


def route_certificates(grade: Column, band: Column) -> Column:
    """(grade, band, offspec): a letter band in the grade's field and a grade in the band's go where they belong.

    What finds its field taken is kept in offspec; a leading EPC is dropped from a moved band.
    """
    wrong_grade = ~looks_unknown(grade) & grade.rlike(_BAND) & ~grade.rlike(_GRADE)
    wrong_band = ~looks_unknown(band) & band.rlike(_GRADE) & ~band.rlike(_BAND)
    bare = F.trim(F.regexp_replace(grade, r"(?i)^\s*epc\s*:?\s*", ""))
    free_band, free_grade = looks_unknown(band), looks_unknown(grade)
    return F.struct(
        F.when(wrong_grade, None).when(wrong_band & free_grade, F.trim(band)).otherwise(grade).alias("grade"),
        F.when(wrong_grade & free_band, bare).when(wrong_band & ~wrong_grade, None).otherwise(band).alias("band"),
        F.when(wrong_grade & ~free_band, bare).when(wrong_band & ~free_grade & ~wrong_grade, F.trim(band)).alias("offspec"),
    )


def quarantine(extra: Column, known: list[str]) -> Column:
    """(kept, offspec): of a record's other keys those with plain values stay, structures and mere locators are set aside."""
    odd = lambda v: F.coalesce(v.rlike(r"^\s*[\[{]") | v.rlike(r"(?i)^\s*(?:page|slide)\s+\d+\s*(?:\(.*\))?\s*$"), F.lit(False))
    other = F.map_filter(extra, lambda k, v: ~k.isin(known))
    return F.struct(F.map_filter(other, lambda k, v: ~odd(v)).alias("kept"), F.map_filter(other, lambda k, v: odd(v)).alias("offspec"))


def listed_rent(value: Column, said: Column) -> Column:
    """A structured rent as text, else what is said unless it quotes none."""
    s = F.trim(F.coalesce(said, F.lit("")))
    return F.when(value > 0, F.format_string("£%.2f psf", value.cast("double"))).when(~F.lower(s).isin(NO_RENT), s)


def real_messages(messages: Column) -> Column:
    return F.filter(messages, lambda m: (F.trim(m) != "") & ~m.contains("System Note"))


def extract_postcode(address: Column, country: Column) -> Column:
    """The country's postcode in the address, else a number like one; no white space, upper case, empty if none."""
    out = F.regexp_extract(address, POSTCODE, 1)
    for name, p in POSTCODES.items():
        out = F.when(F.lower(F.trim(country)) == name, F.regexp_extract(address, p, 1)).otherwise(out)
    return F.upper(F.regexp_replace(F.coalesce(out, F.lit("")), r"\s+", ""))


def query_ladder(street: Column, postcode: Column, town: Column, region: Column) -> Column:
    """Places to ask for, most specific first, each once whatever its case: (query, precision)."""
    rung = lambda parts, name: F.when(F.forall(F.array(*parts), lambda p: F.coalesce(F.trim(p) != "", F.lit(False))), F.struct(F.concat_ws(", ", *parts).alias("query"), F.lit(name).alias("precision")))
    rungs = F.array_compact(F.array(rung([street, postcode, town], "street"), rung([postcode, town], "city"), rung([town, region], "city"), rung([town], "city")))
    names = F.transform(rungs, lambda r: F.lower(r["query"]))
    return F.filter(rungs, lambda r, i: F.array_position(names, F.lower(r["query"])) == i + 1)


def normalize_lang(c: Column) -> Column:
    known = F.create_map(*[F.lit(x) for code, names in LANGUAGES.items() for n in names for x in (n, code)])
    s = F.lower(F.trim(c))
    return F.coalesce(F.try_element_at(known, F.split(s, "[-_]")[0]), s)


def filetime(ticks: Column) -> Column:
    """100-nanosecond ticks since 1601 as a timestamp."""
    return F.timestamp_micros((ticks / 10).cast("long") - F.lit(11_644_473_600_000_000))


def pair_id(a: Column, b: Column) -> Column:
    """The same id whichever of the two comes first."""
    return F.substring(F.sha1(F.concat(F.least(a, b), F.lit("\u0001"), F.greatest(a, b)).cast("binary")), 1, 12)


def names_other_scheme(figures: Column, own: Column) -> Column:
    """Whether a page has a figure within one order of magnitude of the largest own figure, and none that is its own."""
    most = F.array_max(own)
    return F.exists(figures, lambda x: x.between(most / 10, most * 10)) & (F.size(F.array_intersect(figures, own)) == 0)


def header_field(header: Column, aliases: dict[str, list[str]], never: dict[str, str]) -> Column:
    """The field whose alias fits best: exact before whole word, the longer alias of several, vetoed by a pattern."""
    h = F.lower(clean_value(header))
    scored = []
    for n, (field, names) in enumerate(aliases.items()):
        veto = h.rlike(never[field]) if field in never else F.lit(False)
        for a in names:
            tier = F.when(h == a, 3).when(F.concat(F.lit(" "), F.regexp_replace(h, "[^a-z0-9]+", " "), F.lit(" ")).contains(f" {a} "), 2)
            scored.append(F.when(~veto & tier.isNotNull(), F.struct(tier.alias("tier"), F.lit(len(a)).alias("length"), F.lit(-n).alias("order"), F.lit(field).alias("field"))))
    return F.array_max(F.array_compact(F.array(*scored)))["field"]


def token_bag(c: Column) -> Column:
    """Distinct words of four letters or more, and numbers, lower case and sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"([a-z]{4,}|\d[\d.,]*)"), 1)))


def overlap(a: Column, b: Column) -> Column:
    """Share of a's tokens that b has; 1 for no tokens."""
    return F.when(F.size(a) == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def listing(raw: Column) -> Column:
    """A nested listing (JSON) as flat fields: name, address, rent, three nearest stations, distinct files, agents."""
    d = F.from_json(raw, "name string, folder string, address struct<line1:string,town:string,postcode:string>, rent struct<from:double,string:string>, stations array<struct<name:string,miles:double>>, files array<struct<url:string>>, agents array<struct<name:string,tel:string,mobile:string>>")
    parts = F.filter(F.array(d["address"]["line1"], d["address"]["town"], d["address"]["postcode"]), lambda x: F.coalesce(F.trim(x) != "", F.lit(False)))
    near = F.slice(F.transform(F.array_sort(F.transform(d["stations"], lambda s: F.struct(s["miles"].alias("miles"), s["name"].alias("name")))), lambda s: F.concat(s["name"], F.format_string(" (%.1f miles)", s["miles"]))), 1, 3)
    return F.struct(
        F.coalesce(d["name"], F.regexp_replace(d["folder"], r"^\d+[-_ ]+", "")).alias("name"), F.array_join(parts, ", ").alias("address"), listed_rent(d["rent"]["from"], d["rent"]["string"]).alias("rent"),
        near.alias("stations"), F.array_distinct(F.filter(d["files"]["url"], lambda u: u.isNotNull())).alias("files"), F.transform(d["agents"], lambda a: F.concat_ws(" ", a["name"], F.coalesce(a["tel"], a["mobile"]))).alias("agents"),
    )
