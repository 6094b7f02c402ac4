"""Readings and state on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import parsing
from ledgerloom.operators import history

from .records import _pick, _sql
from .registry import Tables, query

_NUMBERS = [("1,234.56", 1234.56), ("1.234,56", 1234.56), ("12,5", 12.5), ("12,500", 12500.0), ("12.500", 12500.0), ("7.25", 7.25), ("none", None)]


@query("SELECT p_partkey, [" + ", ".join("NULL" if v is None else f"{v}::DOUBLE" for _, v in _NUMBERS) + "][(1 + p_partkey % 7)::INT] AS value FROM part")
def to_float(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", parsing.to_float(_pick([a for a, _ in _NUMBERS], "p_partkey")).alias("value"))


_RENTS = ["€4.20 / sq m / month", "55 €/sq m/yr", "£8.50 psf", "4 - 5 € per month", "3 miesięcznie", "on request"]


@query(f"SELECT o_orderkey, [50.4, 55, 8.5, NULL, 36, NULL][(1 + o_orderkey % 6)::INT]::DOUBLE AS value, {_sql(['monthly x 12', 'annual', 'annual', None, 'monthly x 12', None])}[(1 + o_orderkey % 6)::INT] AS note FROM orders")
def annual_rent(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", parsing.annual_rent(_pick(_RENTS, "o_orderkey")).alias("x")).select("o_orderkey", "x.value", "x.note")


@query("SELECT p_partkey, NOT (p_size > 25) AND (p_partkey % 2 = 0 OR p_partkey % 3 = 0) AS land FROM part")
def land_records(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    return t.part.select("p_partkey", parsing.is_land(F.when(F.col("p_size") > 25, F.col("p_size")), F.when(k % 2 == 0, F.lit(5)), F.when(k % 3 == 0, "100").otherwise("tbd")).alias("land"))


_TAGS = [{"aeroway": "aerodrome"}, {"harbour": "yes", "leisure": "marina"}, {"harbour": "yes"}, {"railway": "station"}, {"barrier": "border_control"}, {"barrier": "border_control", "level": "1"}, {"place": "town"}, {"shop": "x"}]


@query(f"SELECT s_suppkey, {_sql(['air', None, 'port', 'rail', 'border', None, 'city', None])}[(1 + s_suppkey % 8)::INT] AS kind FROM supplier")
def map_features(t: Tables) -> DataFrame:
    tags = F.element_at(F.array(*[F.create_map(*[F.lit(x) for kv in d.items() for x in kv]) for d in _TAGS]), (1 + F.col("s_suppkey") % 8).cast("int"))
    return t.supplier.select("s_suppkey", parsing.map_feature(tags).alias("kind"))


_PAGES = ["Site plan, scale 1:500", "Site plan 1:20", "Layout 1 : 200 sq m", "scale 1:100", "Floor Plan 1/1250 A3"]


@query("SELECT s_suppkey, s_suppkey % 5 IN (0, 4) AS drawing FROM supplier")
def drawing_markers(t: Tables) -> DataFrame:
    return t.supplier.select("s_suppkey", parsing.drawing_marker(_pick(_PAGES, "s_suppkey")).alias("drawing"))


@query("""SELECT c_custkey, c_name AS park, c_nationkey::VARCHAR AS city, 2 AS n_fields FROM customer""")
def labelled_fields(t: Tables) -> DataFrame:
    page = F.concat(F.lit("Scheme summary\nPark:  "), "c_name", F.lit(" \n Town - "), F.col("c_nationkey").cast("string"), F.lit("\nPark: other\nRent:\n"))
    m = parsing.labelled(page, {"park": ["park", "scheme"], "city": ["city", "town"], "rent": ["rent"]})
    return t.customer.select("c_custkey", m.alias("m")).select("c_custkey", F.col("m")["park"].alias("park"), F.try_element_at("m", F.lit("city")).alias("city"), F.size("m").alias("n_fields"))


@query("SELECT page_id, url AS first_link, 2 AS n_links FROM pages")
def harvest_links(t: Tables) -> DataFrame:
    cell = F.concat(F.lit("see "), "url", F.lit(", or <https://x.example/a.pdf>; again "), "url", F.lit("."))
    found = parsing.links(cell)
    return t.pages.select("page_id", found[0].alias("first_link"), F.size(found).alias("n_links"))


_STEMS = [("Brochures - Brno FINAL", "Brno", "high"), ("Tracker_v2", "Tracker", "low"), ("A - B - Nový Jičín draft v3", "Nový Jičín", "high"), ("Plain  name", "Plain name", "low")]


@query(f"SELECT n_nationkey, {_sql([x for _, x, _ in _STEMS])}[(1 + n_nationkey % 4)::INT] AS label, {_sql([x for *_, x in _STEMS])}[(1 + n_nationkey % 4)::INT] AS confidence FROM nation")
def region_of_name(t: Tables) -> DataFrame:
    return t.nation.select("n_nationkey", parsing.region_of_name(_pick([x for x, *_ in _STEMS], "n_nationkey")).alias("x")).select("n_nationkey", "x.*")


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 1 THEN p_size::BIGINT::VARCHAR || '.5' ELSE (p_size // 2)::BIGINT::VARCHAR || CASE WHEN p_size % 2 = 1 THEN '.5' ELSE '' END END AS shown FROM part")
def plain_numbers(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", parsing.plain_number(F.when(F.col("p_partkey") % 2 == 0, F.col("p_size") / 2.0).otherwise(F.col("p_size") + 0.5)).alias("shown"))


@query("SELECT page_id, CASE WHEN url LIKE '%.example.com/%' THEN regexp_replace(url, '\\?.*$', '') || '?w=800&q=60' ELSE url END AS url FROM pages")
def resized_images(t: Tables) -> DataFrame:
    return t.pages.select("page_id", parsing.resized(F.col("url"), ".example.com", 800, 60).alias("url"))


@query("""WITH f AS (SELECT user_id % 7 AS corpus, event_id // 500 AS round, event_type AS kind FROM events), l AS (SELECT *, max(round) OVER (PARTITION BY corpus) AS last FROM f)
SELECT DISTINCT corpus, kind FROM l WHERE round = last AND NOT (corpus % 2 = 0 AND kind = 'click')""")
def carried_findings(t: Tables) -> DataFrame:
    f = t.events.select((F.col("user_id") % 7).alias("corpus"), F.floor(F.col("event_id") / 500).alias("round"), F.col("event_type").alias("kind"))
    struck = f.where("corpus % 2 = 0 and kind = 'click'").select("corpus", "kind").distinct()
    return history.carried(f, "corpus", "round", "kind", struck)


@query("""WITH n AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS a, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS b FROM events),
r AS (SELECT user_id, event_type, a - b AS g, count(*) AS n, max(a) AS last FROM n GROUP BY 1, 2, 3) SELECT user_id, max(n) AS longest, arg_max(n, last) AS current FROM r GROUP BY 1""")
def equal_exits(t: Tables) -> DataFrame:
    return history.equal_runs(t.events, "user_id", ["ts", "event_id"], "event_type")


@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'hit' WHEN 1 THEN 'miss' ELSE 'ask' END AS state FROM customer""")
def negative_memo(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    seeds = t.customer.where("c_custkey % 3 <> 2").select("c_custkey", F.when(k % 3 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("found"))
    return history.lookup_with_misses(t.customer.select("c_custkey"), seeds, "c_custkey", "found").select("c_custkey", "state")


@query("""SELECT l_suppkey, round_even(l_discount, 1) AS d, max(l_orderkey * 10 + l_linenumber) AS seq FROM lineitem GROUP BY 1, 2""")
def last_writer(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_suppkey", "l_discount", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return history.last_writer(rows.withColumn("d", F.bround("l_discount", 1)), [F.col("l_suppkey"), F.col("d")], ["l_suppkey", "d"], "seq").select("l_suppkey", "d", "seq")


_RANKS = ["tbd", "city", "street", "rooftop"]


@query(f"""WITH b AS (SELECT c_custkey AS seq, 1.0::DOUBLE AS lat, {_sql(_RANKS)}[(1 + c_custkey % 4)::INT] AS precision FROM customer), n AS (SELECT c_custkey AS seq, 2.0::DOUBLE AS lat, {_sql(_RANKS + ['odd'])}[(1 + c_custkey % 5)::INT] AS precision FROM customer WHERE c_custkey % 3 <> 0),
r(name, r) AS (VALUES ('tbd', 1), ('city', 2), ('street', 3), ('rooftop', 4), ('odd', 3))
SELECT b.seq, CASE WHEN rn.r > rb.r THEN n.lat ELSE b.lat END AS lat, CASE WHEN rn.r > rb.r THEN n.precision ELSE b.precision END AS precision FROM b LEFT JOIN n USING (seq) JOIN r rb ON rb.name = b.precision LEFT JOIN r rn ON rn.name = n.precision""")
def better_precision(t: Tables) -> DataFrame:
    place = lambda v, p: (F.lit(v).alias("lat"), F.lit(v).alias("lng"), p.alias("precision"))
    base = t.customer.select(F.col("c_custkey").alias("seq"), *place(1.0, _pick(_RANKS, "c_custkey")))
    new = t.customer.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("seq"), *place(2.0, _pick([*_RANKS, "odd"], "c_custkey")))
    return history.better_precision(base, new, "seq", _RANKS).select("seq", "lat", "precision")


@query("""WITH a AS (SELECT n_nationkey AS code, CASE WHEN n_nationkey % 2 = 0 THEN n_name END AS label, NULL::INT AS region FROM nation WHERE n_nationkey % 3 = 0), b AS (SELECT n_nationkey AS code, lower(n_name) AS label, n_regionkey AS region FROM nation)
SELECT u.code, coalesce(a.label, b.label) AS label, coalesce(a.region, b.region) AS region FROM (SELECT DISTINCT c_nationkey AS code FROM customer) u LEFT JOIN a USING (code) LEFT JOIN b USING (code)""")
def merge_regions(t: Tables) -> DataFrame:
    n = t.nation
    a = n.where("n_nationkey % 3 = 0").select(F.col("n_nationkey").alias("code"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).alias("label"), F.lit(None).cast("int").alias("region"))
    b = n.select(F.col("n_nationkey").alias("code"), F.lower("n_name").alias("label"), F.col("n_regionkey").alias("region"))
    return history.field_by_field(t.customer.select(F.col("c_nationkey").alias("code")), "code", [a, b], ["label", "region"])


@query("""SELECT min(p_size) AS low, max(p_size) AS high, CASE WHEN max(p_size) - min(p_size) <= 10 THEN 1 WHEN max(p_size) - min(p_size) <= 100 THEN 5 ELSE 50 END AS step FROM part""")
def slider_bounds(t: Tables) -> DataFrame:
    span = F.max("p_size") - F.min("p_size")
    return t.part.agg(F.min("p_size").alias("low"), F.max("p_size").alias("high"), F.when(span <= 10, 1).when(span <= 100, 5).otherwise(50).alias("step"))


@query("""SELECT c_custkey, 'new' AS a, CASE WHEN c_custkey % 2 = 0 THEN 'old' END AS b FROM customer""")
def merge_maps(t: Tables) -> DataFrame:
    """A durable map and this pass's: the pass wins, nothing is dropped."""
    old = F.when(F.col("c_custkey") % 2 == 0, F.create_map(F.lit("a"), F.lit("old"), F.lit("b"), F.lit("old"))).otherwise(F.create_map(F.lit("a"), F.lit("old")))
    new = F.create_map(F.lit("a"), F.lit("new"))
    m = F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k)), new)
    return t.customer.select("c_custkey", m.alias("m")).select("c_custkey", F.col("m")["a"].alias("a"), F.try_element_at("m", F.lit("b")).alias("b"))


@query("""SELECT p_partkey, p_brand FROM part WHERE regexp_matches(p_type, '[A-Za-z]') AND p_brand NOT IN (SELECT p_brand FROM part WHERE p_size > 48)""")
def untranslated(t: Tables) -> DataFrame:
    """Values worth translating that the cache lacks."""
    cache = t.part.where("p_size > 48").select("p_brand").distinct()
    return t.part.where(F.col("p_type").rlike("[A-Za-z]")).join(cache, "p_brand", "left_anti").select("p_partkey", "p_brand")


_FILES = [("ACME_Longlist v2", "ACME"), ("Big Box Co - tracker", "Big Box Co"), ("notes", None)]


@query(f"SELECT s_suppkey, {_sql([x for _, x in _FILES])}[(1 + s_suppkey % 3)::INT] AS client, (s_suppkey * 7)::BIGINT AS requirement, 'total size (sq ft)' AS header FROM supplier")
def names_in_paths(t: Tables) -> DataFrame:
    url = F.concat(F.lit("https://x.example/requirements/"), F.col("s_suppkey") * 7, F.lit("/matches"))
    return t.supplier.select("s_suppkey", parsing.client_of(_pick([x for x, _ in _FILES], "s_suppkey")).alias("client"), parsing.requirement_id(url).alias("requirement"), parsing.normalise_header(F.lit("Total Size \n(sq ft)")).alias("header"))


@query("""SELECT c_custkey, 'https://maps.example/@?api=1&map_action=pano' || CASE WHEN c_custkey % 3 = 0 THEN '&pano=p' || c_custkey WHEN c_custkey % 3 = 1 THEN '&viewpoint=' || c_custkey || ',' || c_nationkey END AS url FROM customer""")
def view_urls(t: Tables) -> DataFrame:
    k = F.col("c_custkey") % 3
    return t.customer.select("c_custkey", parsing.view_url(F.when(k == 0, F.concat(F.lit("p"), "c_custkey")), F.when(k == 1, F.col("c_custkey")), F.col("c_nationkey")).alias("url"))


@query("SELECT s_suppkey, [2, 0, 1][(1 + s_suppkey % 3)::INT] AS hits, ['excellent', 'a+', 'very good'][(1 + s_suppkey % 3)::INT] AS token, s_suppkey % 3 = 0 AS hedged FROM supplier")
def lexicon_and_grades(t: Tables) -> DataFrame:
    pages = _pick(["Étage plan: niveau 1", "planning levels", "Ground plan"], "s_suppkey")
    grade = _pick(["Target BREEAM Excellent", "EPC: A+", "BREEAM Very Good"], "s_suppkey")
    return t.supplier.select("s_suppkey", parsing.lexicon_hits(pages, ["plan", "etage"]).alias("hits"), parsing.enum_token(grade, "target|breeam|epc").alias("token"), parsing.hedged(grade).alias("hedged"))


@query("SELECT o_orderkey, (year(o_orderdate) * 12 + month(o_orderdate))::INT AS month_key, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderpriority END AS cell FROM orders")
def month_keys(t: Tables) -> DataFrame:
    said = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "MMMM yyyy"))
    return t.orders.select("o_orderkey", parsing.month_key(said).alias("month_key"), parsing.dash_null(F.when(F.col("o_orderkey") % 4 == 0, " – ").otherwise(F.col("o_orderpriority"))).alias("cell"))


@query("""SELECT c_custkey, array_to_string(list_filter([CASE WHEN c_acctbal < 0 THEN 'negative' END, CASE WHEN c_nationkey > 20 THEN 'far' END, CASE WHEN c_mktsegment = 'BUILDING' THEN 'sector' END], lambda x: x IS NOT NULL), ',') AS flags FROM customer""")
def anti_patterns(t: Tables) -> DataFrame:
    """The rules that a row breaks, in order."""
    flags = F.array_compact(F.array(F.when(F.col("c_acctbal") < 0, "negative"), F.when(F.col("c_nationkey") > 20, "far"), F.when(F.col("c_mktsegment") == "BUILDING", "sector")))
    return t.customer.select("c_custkey", F.array_join(flags, ",").alias("flags"))


@query("""WITH r AS (SELECT l_orderkey, max(l_quantity) AS stated, count(*) FILTER (WHERE l_returnflag <> 'N') AS n FROM lineitem GROUP BY 1) SELECT l_orderkey, CASE WHEN n > 0 THEN stated END AS stated_total FROM r""")
def stated_total(t: Tables) -> DataFrame:
    """A cluster's own printed total, where a record of a known unit prints one."""
    return t.lineitem.groupBy("l_orderkey").agg(F.when(F.count_if(F.col("l_returnflag") != "N") > 0, F.max("l_quantity")).alias("stated_total"))


@query("""SELECT source, round(avg((n_chars > 1000)::INT), 6) AS dark_share, avg((n_chars > 1000)::INT) NOT BETWEEN 0.4 AND 0.6 AS warn FROM documents GROUP BY 1""")
def tone_share(t: Tables) -> DataFrame:
    share = F.avg((F.col("n_chars") > 1000).cast("int"))
    return t.documents.groupBy("source").agg(F.round(share, 6).alias("dark_share"), (~share.between(0.4, 0.6)).alias("warn"))


@query("""SELECT c_custkey, greatest(0, len(list_filter([c_acctbal > 0, c_nationkey > 5, c_mktsegment <> 'BUILDING'], lambda x: x)))::INT AS n_fields FROM customer""")
def chaseable_fields(t: Tables) -> DataFrame:
    """How many of the fields that a chase may ask for a row holds."""
    held = F.map_filter(F.create_map(F.lit("bal"), F.col("c_acctbal") > 0, F.lit("nation"), F.col("c_nationkey") > 5, F.lit("segment"), F.col("c_mktsegment") != "BUILDING", F.lit("balVal"), F.lit(True)), lambda k, v: v & ~k.endswith("Val"))
    return t.customer.select("c_custkey", F.size(F.array_intersect(F.map_keys(held), F.array(*map(F.lit, ["bal", "nation", "segment"])))).alias("n_fields"))
