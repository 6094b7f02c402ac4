"""Scalar functions on text and numbers made from the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import numbers, text, unknown
from ledgerloom.session import dealt

from .registry import Tables, query


def _list(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


_SPELT = "['TBD', 'n/a.', ' Auf Anfrage ', '??', '12.5 m', NULL, 'según proyecto', 'Sur  demande', 'ok', '—'][(1 + o_orderkey % 10)::INT]"


@query(f"""WITH v AS (SELECT o_orderkey, {_SPELT} AS raw FROM orders), u AS (SELECT *, coalesce(rtrim(lower(trim(raw)), '.') IN ({_list(unknown.UNKNOWN)}), TRUE) AS is_unknown FROM v)
SELECT o_orderkey, is_unknown, is_unknown OR coalesce(trim(raw) = '??', FALSE) AS is_tbd, CASE WHEN is_unknown THEN '—' ELSE trim(regexp_replace(raw, '\\s+', ' ', 'g')) END AS land_price FROM u""")
def unknown_values(t: Tables) -> DataFrame:
    spelt = ["TBD", "n/a.", " Auf Anfrage ", "??", "12.5 m", None, "según proyecto", "Sur  demande", "ok", "—"]
    raw = F.element_at(F.array(*map(F.lit, spelt)), (1 + F.col("o_orderkey") % 10).cast("int"))
    return t.orders.select("o_orderkey", unknown.looks_unknown(raw).alias("is_unknown"), unknown.is_tbd(raw).alias("is_tbd"), unknown.sentinel(raw, "landPrice").alias("land_price"))


@query("""SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN round(l_extendedprice, 2) WHEN 1 THEN round(l_extendedprice, 2) WHEN 2 THEN floor(l_extendedprice) ELSE NULL END AS value FROM lineitem""")
def normalize_number_eu(t: Tables) -> DataFrame:
    """Prices written as 1.234,50, as 1234,50, as 1.234.567-style groups and as ranges, read again."""
    grouped = F.format_number("l_extendedprice", 2)
    european = F.translate(grouped, ",.", ".,")
    whole = F.translate(F.format_number(F.floor("l_extendedprice").cast("double"), 0), ",", " ")
    plain = F.replace(F.format_number("l_extendedprice", 2), F.lit(","), F.lit(""))
    k = F.col("l_linenumber") % 4
    raw = F.when(k == 0, F.concat(F.lit("€ "), european)).when(k == 1, F.replace(plain, F.lit("."), F.lit(","))).when(k == 2, whole).otherwise(F.concat(whole, F.lit(" - "), whole))
    return t.lineitem.select("l_orderkey", "l_linenumber", numbers.normalize_number(raw).alias("value"))


@query("""WITH s AS (SELECT p_partkey, p_partkey % 5 AS k, p_size * 1000 + p_partkey % 1000 AS n FROM part)
SELECT p_partkey, CASE k WHEN 0 THEN round_even(n * 0.09290304::DOUBLE, 0) WHEN 1 THEN n::DOUBLE WHEN 2 THEN round_even(n % 50 * 10000.0::DOUBLE, 0) WHEN 3 THEN CASE WHEN n >= 1000 THEN n::DOUBLE END END AS sqm,
 CASE k WHEN 0 THEN 'sqft' WHEN 1 THEN 'sqm' WHEN 2 THEN 'ha' WHEN 3 THEN CASE WHEN n >= 1000 THEN 'sqm?' END END AS unit FROM s""")
def parse_size(t: Tables) -> DataFrame:
    n = F.col("p_size") * 1000 + F.col("p_partkey") % 1000
    k = F.col("p_partkey") % 5
    said = F.when(k == 0, F.concat(F.format_number(n, 0), F.lit(" sq ft GLA"))).when(k == 1, F.concat(n, F.lit(" sqm"))).when(k == 2, F.concat(n % 50, F.lit(" ha"))).when(k == 3, n.cast("string")).otherwise(F.concat(n, F.lit(" pallet positions")))
    return t.part.select("p_partkey", numbers.parse_size(said).alias("x")).select("p_partkey", "x.sqm", "x.unit")


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, l_extendedprice / 100 AS rent, CASE WHEN l_returnflag = 'A' THEN '£/sq ft/yr' WHEN l_returnflag = 'N' THEN '€/sq m/yr' END AS unit, l_quantity * 5000 AS area FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN rent BETWEEN CASE WHEN unit LIKE '%ft%' THEN 0.5 ELSE 1.5 END AND CASE WHEN unit LIKE '%ft%' THEN 60 ELSE 500 END THEN 'pass' ELSE 'fail' END AS rent_verdict,
 CASE WHEN area BETWEEN 300 AND 600000 THEN 'pass' ELSE 'fail' END AS area_verdict, CASE WHEN area > 60000 THEN 'in the sq-ft range' END AS note FROM s""")
def plausibility_gate(t: Tables) -> DataFrame:
    unit = F.when(F.col("l_returnflag") == "A", "£/sq ft/yr").when(F.col("l_returnflag") == "N", "€/sq m/yr")
    area, metric = F.col("l_quantity") * 5000, F.lit("sq m")
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", numbers.plausible(F.col("l_extendedprice") / 100, numbers.rent_band(unit)).alias("rent_verdict"),
        numbers.plausible(area, numbers.area_band(metric)).alias("area_verdict"), numbers.magnitude_note(area, metric).alias("note"),
    )


_UNITS = "['sq ft', 'sq m', 'acres', 'ha', 'mystery']"


@query(f"""WITH u AS (SELECT p_partkey, {_UNITS}[(1 + p_partkey % 5)::INT] AS a, {_UNITS}[(1 + p_size % 5)::INT] AS b FROM part), f(unit, n) AS (VALUES ('sq ft', 1.0::DOUBLE), ('sq m', 10.7639), ('acres', 43560.0), ('ha', 107639.0))
SELECT p_partkey, round(x.n / y.n, 8) AS factor FROM u LEFT JOIN f x ON x.unit = u.a LEFT JOIN f y ON y.unit = u.b""")
def area_factor(t: Tables) -> DataFrame:
    names = F.array(*map(F.lit, ["sq ft", "sq m", "acres", "ha", "mystery"]))
    pick = lambda c: F.element_at(names, (1 + F.col(c) % 5).cast("int"))
    return t.part.select("p_partkey", F.round(numbers.area_factor(pick("p_partkey"), pick("p_size")), 8).alias("factor"))


_QUOTES = ["£8.50 psf", "EUR 60 per sq m p.a.", "4,20 €/m2/month", "on request", "7.25 sq.ft", "12 ha plot", "55 euro"]


@query(f"""WITH q AS (SELECT o_orderkey, [{_list(_QUOTES)}][(1 + o_orderkey % 7)::INT] AS t FROM orders)
SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN 'sq ft' WHEN 1 THEN 'sq m' WHEN 2 THEN 'sq m' WHEN 4 THEN 'sq ft' WHEN 5 THEN 'ha' END AS area_unit,
 CASE o_orderkey % 7 WHEN 0 THEN '£/sq ft/yr' WHEN 1 THEN '€/sq m/yr' WHEN 2 THEN '€/sq m/yr' WHEN 4 THEN '£/sq ft/yr' WHEN 5 THEN '€/sq m/yr' WHEN 6 THEN '€/sq m/yr' END AS rent_unit FROM q""")
def units_of_text(t: Tables) -> DataFrame:
    said = F.element_at(F.array(*map(F.lit, _QUOTES)), (1 + F.col("o_orderkey") % 7).cast("int"))
    return t.orders.select("o_orderkey", numbers.area_unit_of(said).alias("area_unit"), numbers.rent_unit_of_text(said).alias("rent_unit"))


@query("""WITH s AS (SELECT *, l_extendedprice / l_quantity AS ratio FROM lineitem)
SELECT l_orderkey, l_linenumber, round(ratio, 6) AS ratio, ratio BETWEEN 900 AND 1200 AS in_band, round_even(l_extendedprice * pow(1 + 5.0 / 100, 3), 0) AS projected,
 round(l_extendedprice * pow(1 + 5.0 / 100, 3) / least(greatest(ratio, 900), 1200), 1) AS needed FROM s""")
def forecast(t: Tables) -> DataFrame:
    x = numbers.forecast(F.col("l_extendedprice"), F.col("l_quantity"), F.lit(900.0), F.lit(1200.0), F.lit(5.0), F.lit(3))
    return t.lineitem.select("l_orderkey", "l_linenumber", x.alias("x")).select("l_orderkey", "l_linenumber", "x.ratio", "x.in_band", "x.projected", "x.needed")


@query("""WITH e AS (SELECT event_id, 1 + event_id % 6 AS tier, CASE WHEN event_id % 9 <> 0 THEN ts::DATE END AS d, event_id % 2 = 0 AS v, event_id % 3 AS n FROM events),
m AS (SELECT *, date_diff('day', d, DATE '2026-05-29') / 30.44::DOUBLE AS months FROM e),
b AS (SELECT event_id, CASE WHEN tier <= 2 THEN 2 WHEN tier <= 4 THEN 1 ELSE 0 END AS a, CASE WHEN months IS NULL THEN 1 WHEN months <= (CASE WHEN v THEN 12 ELSE 24 END) THEN 2 WHEN months <= (CASE WHEN v THEN 24 ELSE 60 END) THEN 1 ELSE 0 END AS r, CASE WHEN n >= 2 OR tier = 1 THEN 2 ELSE 1 END AS c FROM m)
SELECT event_id, ['Low', 'Medium', 'High'][least(a, r, c) + 1] AS band, CASE least(a, r, c) WHEN a THEN 'tier' WHEN r THEN 'recency' ELSE 'corroboration' END AS binding FROM b""")
def confidence_band(t: Tables) -> DataFrame:
    k = F.col("event_id")
    x = numbers.confidence(1 + k % 6, F.when(k % 9 != 0, F.to_date("ts")), F.lit("2026-05-29").cast("date"), k % 2 == 0, k % 3)
    return t.events.select("event_id", x.alias("x")).select("event_id", "x.band", "x.binding")


@query("""SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(string_split(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '' AND NOT regexp_full_match(x, '[0-9]+') AND length(x) > 1 AND x NOT IN (""" + _list(text.GENERIC) + """)))), ' ') AS tokens FROM part""")
def token_sets(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.array_join(text.distinctive_tokens(F.col("p_name")), " ").alias("tokens"))


@query("""SELECT c_custkey, array_to_string(list_sort(list_distinct(string_split('road ' || c_custkey % 90 || ' ' || lower(n_name), ' '))), ' ') AS address FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def address_key(t: Tables) -> DataFrame:
    said = F.concat(F.lit("No. "), F.col("c_custkey") % 90, F.lit(" Rd., "), F.col("n_name"))
    return t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", text.normalize_address(said).alias("address"))


_ENDS = ["brochure.PDF", "2f9f75984bdd081e480db806b280d6de", "75984bdd-081e-480d-b806-b280d6deea67", "page.html", "file.xlsx", "view?id=7", ""]


@query("""SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'pdf' WHEN 1 THEN 'probable-pdf' WHEN 2 THEN 'probable-pdf' WHEN 7 THEN 'missing' ELSE 'not-pdf' END AS kind,
 CASE page_id % 8 WHEN 0 THEN 'brochure.PDF' WHEN 1 THEN '2f9f75984bdd081e480db806b280d6de' WHEN 2 THEN '75984bdd-081e-480d-b806-b280d6deea67' WHEN 3 THEN 'page.html' WHEN 4 THEN 'file.xlsx' WHEN 5 THEN 'view' WHEN 6 THEN 'download' ELSE 'download' END AS filename FROM pages""")
def classify_url(t: Tables) -> DataFrame:
    host = F.regexp_extract("url", r"^(https?://[^/]+)", 1)
    k = (F.col("page_id") % 8).cast("int")
    url = F.when(k < 7, F.concat(host, F.lit("/x/"), F.element_at(F.array(*map(F.lit, _ENDS)), F.least(k, F.lit(6)) + 1))).otherwise("")
    return t.pages.select("page_id", text.classify_url(url).alias("kind"), text.predicted_filename(url).alias("filename"))


@query("""SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, trim(regexp_replace(regexp_replace(lower(regexp_replace(url, '^https?://', '')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) AS slug FROM pages""")
def url_parts(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("host"), text.slugify(F.lower(F.regexp_replace("url", "^https?://", "")), 500).alias("slug"))


@query(r"""WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<!--.*?-->', ' ', 'g') AS t FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(t, '(?i)<(?:br|/p|/div|/h[1-6]|/li|/tr)\b[^>]*>', chr(10), 'g'), '<[^>]+>', ' ', 'g') AS t FROM a),
c AS (SELECT page_id, replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&') AS t FROM b)
SELECT page_id, sha256(trim(regexp_replace(regexp_replace(t, '[ \t\r]+', ' ', 'g'), '\s*\n\s*', chr(10), 'g'))) AS digest FROM c""")
def html_to_text(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.sha2(text.html_to_text(F.col("html")).cast("binary"), 256).alias("digest"))


_REPLY = r"'(?s)\n\s*(?:On .{1,200} wrote:|-{3,} ?Original Message|From: ).*$', ''"


@query(rf"""SELECT conv_id, turn, trim(regexp_replace(text, {_REPLY})) AS top, trim(regexp_replace(text || chr(10) || 'On Monday A. Sender wrote:' || chr(10) || '> older', {_REPLY})) AS answered FROM conversations""")
def email_top_only(t: Tables) -> DataFrame:
    """All turns above their first reply marker, as they are and with an older message below them."""
    answered = F.concat("text", F.lit("\nOn Monday A. Sender wrote:\n> older"))
    return t.conversations.select("conv_id", "turn", text.top_only(F.col("text")).alias("top"), text.top_only(answered).alias("answered"))


@query("""SELECT o_orderkey, greatest(1999, year(o_orderdate)) AS year FROM orders""")
def stated_year(t: Tables) -> DataFrame:
    said = F.concat_ws(" ", F.lit("as of 1999, revised"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("(no 20991)"))
    return t.orders.select("o_orderkey", F.greatest(text.stated_year(said), F.lit(0)).alias("year")).withColumn("year", F.col("year").cast("long"))


@query("""SELECT event_id, (props::JSON->>'k')::BIGINT AS k, event_type FROM events""")
def explode_json_props(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.from_json("props", "k long")["k"].alias("k"), "event_type")


@query("""SELECT a.p_partkey AS left_key, b.p_partkey AS right_key, levenshtein(a.p_name, b.p_name) AS distance FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey""")
def closest_names(t: Tables) -> DataFrame:
    """Name distances of parts that share a block of brand, type and size."""
    block = ["p_brand", "p_type", "p_size"]
    a, b = (dealt(t.part.select(F.col("p_partkey").alias(f"{s}_key"), F.col("p_name").alias(f"{s}_name"), *block), *block) for s in ("left", "right"))
    return a.join(b.hint("shuffle_hash"), block).where("left_key < right_key").select("left_key", "right_key", F.levenshtein("left_name", "right_name").cast("long").alias("distance"))
