"""Text keys, tokens, addresses, URLs and pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .unknown import clean_value, looks_unknown

#: Folded letters, legal forms, street words and words without identity.
FOLD = ("àáâãäåāăąçćčďđèéêëēęěìíîïīłñńňòóôõöøōŕřśšşťţùúûüūůűýÿźžż", "aaaaaaaaacccddeeeeeeeiiiiilnnnooooooorrsssttuuuuuuuyyzzz")
LEGAL = r"\b(?:gmbh|ag|kg|ltd|limited|plc|llc|inc|bv|nv|sa|sas|sarl|srl|spa|sro|as|oy|ab|sp\.? ?z ?o\.? ?o)\b\.?"
STREET = {"str": "street", "st": "street", "strasse": "strasse", "rd": "road", "ave": "avenue", "av": "avenue", "ln": "lane", "blvd": "boulevard"}
ADDRESS_NOISE = ["unit", "units", "building", "bldg", "warehouse", "dc", "block", "plot", "the", "no", "nr", "number", "ste", "suite", "floor", "fl"]
GENERIC = ["park", "logistics", "industrial", "warehouse", "centre", "center", "business", "estate", "distribution", "unit", "the", "of", "and"]
NOT_PDF = ["html", "htm", "aspx", "php", "xlsx", "docx", "jpg", "png", "zip", "csv"]


def fold(c: Column) -> Column:
    """Lower case without accents; the letters that have two-letter forms first."""
    c = F.lower(c)
    for a, b in (("ß", "ss"), ("æ", "ae"), ("œ", "oe")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.translate(c, *FOLD)


def norm(c: Column) -> Column:
    """Folded, without legal forms, everything but letters and digits a single space."""
    return F.trim(F.regexp_replace(F.regexp_replace(fold(c), LEGAL, " "), "[^a-z0-9]+", " "))


def match_key(city: Column, developer: Column, park: Column) -> Column:
    return F.concat_ws("|", *[F.coalesce(norm(c), F.lit("")) for c in (city, developer, park)])


def tokens(c: Column) -> Column:
    return F.filter(F.split(norm(c), " "), lambda t: t != "")


def distinctive_tokens(c: Column) -> Column:
    """Sorted distinct tokens without generic words, numbers and single letters."""
    kept = F.filter(tokens(c), lambda t: ~t.isin(GENERIC) & ~t.rlike("^[0-9]+$") & (F.char_length(t) > 1))
    return F.array_sort(F.array_distinct(kept))


def normalize_address(c: Column) -> Column:
    """Sorted distinct tokens with street words unified and noise left out."""
    known = F.create_map(*[F.lit(x) for kv in STREET.items() for x in kv])
    words = F.filter(F.split(F.regexp_replace(fold(c), r"[^\p{L}\p{N}_\s]", " "), r"\s+"), lambda t: t != "")
    named = F.transform(words, lambda t: F.coalesce(F.try_element_at(known, t), t))
    return F.array_join(F.array_sort(F.array_distinct(F.filter(named, lambda t: ~t.isin(ADDRESS_NOISE)))), " ")


def token_sort_key(c: Column) -> Column:
    return F.array_join(F.array_sort(tokens(c)), " ")


def slugify(c: Column, limit: int = 60) -> Column:
    """Letters and digits joined by hyphens, cut at a word end; empty if nothing is left."""
    s = F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9]+", "-"), "^-+|-+$", "")
    short = F.regexp_extract(s, rf"^(.{{0,{limit}}})(?:-|$)", 1)
    return F.when(F.char_length(s) <= limit, s).when(short != "", short).otherwise(F.substring(s, 1, limit))


def last_segment(url: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"^[a-zA-Z]+://[^/]+/(?:.*/)?([^/]*)$", 1)


def classify_url(url: Column) -> Column:
    """missing, pdf, not-pdf or probable-pdf (a last part that is only an opaque id)."""
    end = F.lower(last_segment(url))
    ext = F.regexp_extract(end, r"\.([a-z0-9]{2,5})$", 1)
    opaque = end.rlike(r"^(?:[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|[0-9a-f]{24,64})$")
    return (
        F.when(F.coalesce(F.trim(url), F.lit("")) == "", "missing").when(ext == "pdf", "pdf").when(url.rlike(r"(?i)google\.[a-z.]+/maps|maps\.|goo\.gl/maps"), "not-pdf")
        .when(url.contains("?"), "not-pdf").when(ext.isin(NOT_PDF), "not-pdf").when(opaque, "probable-pdf").otherwise("not-pdf")
    )


def predicted_filename(url: Column) -> Column:
    name = F.try_url_decode(last_segment(url))
    return F.when(F.coalesce(name, F.lit("")) == "", "download").otherwise(name)


def looks_like_locator(c: Column) -> Column:
    return c.rlike(r"(?i)^\s*(?:page|slide)\s+\d+\s*(?:\(.*\))?\s*$")


def html_to_text(c: Column) -> Column:
    """Text of a page without scripts, styles and comments; block tags end lines."""
    t = F.regexp_replace(c, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?i)<(?:br|/p|/div|/h[1-6]|/li|/tr)\b[^>]*>", "\n")
    t = F.regexp_replace(t, r"<[^>]+>", " ")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[ \t\r]+", " "), r"\s*\n\s*", "\n"))


def top_only(c: Column) -> Column:
    """A message above the first reply marker."""
    return F.trim(F.regexp_extract(c, r"(?s)^(.*?)(?:\n\s*(?:On .{1,200} wrote:|-{3,} ?Original Message|From: )|$(?![\s\S]))", 1))


def name_variants(c: Column) -> Column:
    """A bilingual name's parts, cleaned, distinct and sorted."""
    parts = F.split(c, r"\s*[/,;()]\s*|\s+-\s+")
    return F.array_sort(F.array_distinct(F.filter(F.transform(parts, lambda x: F.btrim(clean_value(x), F.lit(" -"))), lambda x: x != "")))


def stated_year(c: Column) -> Column:
    """The latest year from 1900 to 2099 in the text."""
    return F.array_max(F.transform(F.regexp_extract_all(c, F.lit(r"\b((?:19|20)[0-9]{2})\b"), 1), lambda y: y.cast("int")))


def prose(c: Column) -> Column:
    """Whether a value is worth translating: known, no locator, and longer than three words or no code, number, date or address of the web."""
    short = F.size(F.split(F.trim(c), r"\s+")) <= 3
    fixed = c.rlike(r"(?i)^\s*(?:https?://\S+|[0-9][0-9.,:/ -]*\S{0,6}|[A-Z0-9-]{1,6}|[£€$].*)\s*$")
    return ~F.coalesce(fixed & short, F.lit(True)) & ~looks_like_locator(c) & ~looks_unknown(c)


def saturation_claim(c: Column, claim: str, negation: str) -> Column:
    """Whether some sentence (up to a full stop, semicolon or line end) makes the claim without a negation."""
    return F.exists(F.split(c, r"[.;\n]"), lambda s: s.rlike(claim) & ~s.rlike(negation))


def sections(c: Column, level: int = 2) -> Column:
    """A document's sections as a map of heading to body, by headings of the level; the first of equal headings counts."""
    mark = "#" * level
    parts = F.filter(F.split(F.concat(F.lit("\n"), c), rf"\n(?={mark} )"), lambda x: x.startswith(f"{mark} "))
    pairs = F.transform(parts, lambda x: F.struct(F.trim(F.regexp_extract(x, rf"^{mark} ([^\n]*)", 1)).alias("key"), F.trim(F.regexp_replace(x, r"^[^\n]*\n?", "")).alias("value")))
    return F.aggregate(pairs, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")), lambda m, p: F.when(F.map_contains_key(m, p["key"]), m).otherwise(F.map_concat(m, F.map_from_arrays(F.array(p["key"]), F.array(p["value"])))))


def field_value(block: Column, name: str) -> Column:
    """The value of a `Name: value` line; null if the block has none."""
    v = F.regexp_extract(block, rf"(?im)^\s*(?:[-*]\s*)?{name}\s*:\s*(.+?)\s*$", 1)
    return F.when(v != "", v)


def dash_lines(c: Column) -> Column:
    """Numbers (from 1) of the lines that hold an em or en dash."""
    return F.filter(F.transform(F.split(c, "\n"), lambda x, i: F.when(x.rlike("[–—]"), i + 1)), lambda x: x.isNotNull())


def figures(c: Column, floor: int = 1000) -> Column:
    """Whole figures of the text from `floor` on, thousands grouped by commas, points or spaces; distinct and sorted."""
    found = F.regexp_extract_all(c, F.lit(r"(?<![\d.,])(\d{1,3}(?:[.,  ]\d{3})+|\d+)(?![\d])"), 1)
    values = F.transform(found, lambda x: F.regexp_replace(x, r"[^\d]", "").try_cast("long"))
    return F.array_sort(F.array_distinct(F.filter(values, lambda x: x >= floor)))


def short_motorway(c: Column, limit: int = 40) -> Column:
    """Road, junction and distance of a prose location, as `M5 J18 2 miles`; null if it names no junction."""
    road, junction = r"(?:M\d+(?:/M\d+)?|A\d+(?:\(M\))?)", r"(?:J|Jct|Junction)\s*(\d+[A-Za-z]?(?:/\d*[A-Za-z]?)?)"
    a, b = rf"(?i)\b{junction}\s*(?:of\s+the\s+)?({road})", rf"(?i)\b({road})\s*[, ]\s*{junction}"
    first = F.when(c.rlike(a), F.concat_ws(" ", F.upper(F.regexp_extract(c, a, 2)), F.concat(F.lit("J"), F.upper(F.regexp_extract(c, a, 1))))).when(c.rlike(b), F.concat_ws(" ", F.upper(F.regexp_extract(c, b, 1)), F.concat(F.lit("J"), F.upper(F.regexp_extract(c, b, 2)))))
    far = F.regexp_extract(c, r"(?i)(\d+(?:\.\d+)?\s*(?:miles?|mi|km))\b", 1)
    return F.substring(F.when(far != "", F.concat_ws(" ", first, far)).otherwise(first), 1, limit)
