"""Completeness, exports, citations, caches and names on the driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import geo, text, values
from ledgerloom.operators import merge, resolve
from ledgerloom.session import shared_dir
from ledgerloom.sources import files, sinks
from ledgerloom.streaming import feeds

from .registry import Tables, query


def _pick(options: list, key: str):
    return F.element_at(F.array(*map(F.lit, options)), (1 + F.col(key) % len(options)).cast("int"))


def _sql(options: list) -> str:
    return "[" + ", ".join("NULL" if x is None else "'" + x.replace("'", "''") + "'" for x in options) + "]"


@query("""SELECT o_orderkey, round(((o_orderkey % 2 = 0)::INT + 1 + (o_totalprice > 100000 OR o_orderkey % 3 = 0)::INT) / 3.0, 6) AS core_fill FROM orders""")
def core_fill(t: Tables) -> DataFrame:
    price = F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice").cast("string")).otherwise("tbd")
    fill = values.core_fill([F.when(F.col("o_orderkey") % 2 == 0, "city").otherwise("n/a")], [F.col("o_orderstatus")], [price, F.when(F.col("o_orderkey") % 3 == 0, "9")])
    return t.orders.select("o_orderkey", F.round(fill, 6).alias("core_fill"))


_LANDS = ["España", "uk", "Deutschland.", "Österreich", "EL", "Atlantis", "pl", "Česko", "  Crna   Gora ", "Κύπρος"]
_CODES = ["ES", "GB", "DE", "AT", "GR", "Atlantis", "PL", "CZ", "ME", "Κύπρος"]


@query(f"SELECT c_custkey, {_sql(_CODES)}[(1 + c_custkey % 10)::INT] AS country FROM customer")
def country_iso(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", values.country_iso(_pick(_LANDS, "c_custkey")).alias("country"))


_FACTS = [("12.5 m", "12,5", True), ("1000 kVA", "1 MVA", True), ("131,536 sq ft", "131536", True), ("50 kN/sq m", "50 kVA", False), ("1 MVA", "1 mystery", False), ("Raven  Park", "raven park", True), ("125078", "124746", False)]


@query("SELECT p_partkey, [" + ", ".join(str(x).upper() for *_, x in _FACTS) + "][(1 + p_partkey % 7)::INT] AS same FROM part")
def value_equivalence(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", values.same_fact(_pick([a for a, _, _ in _FACTS], "p_partkey"), _pick([b for _, b, _ in _FACTS], "p_partkey")).alias("same"))


@query("""SELECT n_nationkey, r AS row, c AS col FROM nation, range(n_nationkey::INT, (n_nationkey + 2)::INT) a(r), range((n_nationkey % 5)::INT, (n_nationkey % 5 + 3)::INT) b(c)""")
def expand_refs(t: Tables) -> DataFrame:
    k, c = F.col("n_nationkey"), F.col("n_nationkey") % 5
    ref = F.concat(F.chr(65 + c), k + 1, F.lit(":"), F.chr(67 + c), k + 2)
    return t.nation.select("n_nationkey", F.explode(files.expand_ref(ref)).alias("x")).select("n_nationkey", "x.row", "x.col")


@query("""WITH b AS (SELECT DISTINCT regexp_extract(url, '([^/]*)$', 1) AS name, url FROM pages), n AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY url) AS n FROM b)
SELECT name, count(*) AS n_paths, min(url) AS first_path, max(CASE WHEN n = 2 THEN url END) AS second_path FROM n GROUP BY 1 HAVING count(*) > 1""")
def basename_collisions(t: Tables) -> DataFrame:
    return files.basename_collisions(t.pages, "url")


@query("""WITH e AS (SELECT DISTINCT c_nationkey AS code, unnest(string_split(c_name, '#')) AS variant FROM customer) SELECT variant, min(code) AS code FROM e GROUP BY 1 HAVING count(*) = 1""")
def name_index(t: Tables) -> DataFrame:
    return files.name_index(t.customer, "c_nationkey", F.split("c_name", "#"))


@query("""SELECT c_custkey, 40 + (c_custkey % 1000) / 1000.0 + 0.0001 AS lat, -3 - (c_custkey % 777) / 1000.0 - 0.0001 AS lng FROM customer WHERE c_custkey % 3 <> 0""")
def coords_from_text(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    said = F.when(k % 3 != 0, F.format_string("map q=%.4f, %.4f z", 40 + k % 1000 / 1000.0 + 0.0001, -3 - k % 777 / 1000.0 - 0.0001)).otherwise(F.lit("sizes 120.555, 99.123 and 1,2"))
    return t.customer.select("c_custkey", geo.coords_from_text(said).alias("x")).where("x is not null").select("c_custkey", "x.lat", "x.lng")


_SAID = ["c1", "c2", "c3", "c9"]


@query(f"""WITH s AS (SELECT conv_id, turn, unnest([{_sql(_SAID)}[(1 + conv_id % 4)::INT], {_sql(_SAID)}[(1 + turn % 4)::INT]]) AS claim FROM conversations), l(claim, struck) AS (VALUES ('c1', FALSE), ('c2', TRUE), ('c3', FALSE), ('c4', FALSE))
SELECT DISTINCT conv_id, s.claim, CASE WHEN l.claim IS NULL THEN 'missing' WHEN struck THEN 'struck' END AS defect FROM s LEFT JOIN l USING (claim) WHERE l.claim IS NULL OR struck""")
def citation_defects(t: Tables) -> DataFrame:
    """Cited claims that the ledger lacks or has struck."""
    cited = t.conversations.select("conv_id", F.explode(F.array(_pick(_SAID, "conv_id"), _pick(_SAID, "turn"))).alias("claim"))
    claims = t.spark.createDataFrame([("c1", False), ("c2", True), ("c3", False), ("c4", False)], "claim string, struck boolean").withColumn("known", F.lit(True))
    defect = F.when(F.col("known").isNull(), "missing").when(F.col("struck"), "struck")
    return cited.join(F.broadcast(claims), "claim", "left").select("conv_id", "claim", defect.alias("defect")).where("defect is not null").distinct()


@query("""SELECT event_type AS claim, arg_min(user_id, struct_pack(t := ts, e := event_id)) AS slide FROM events GROUP BY 1""")
def first_citation(t: Tables) -> DataFrame:
    return t.events.groupBy(F.col("event_type").alias("claim")).agg(F.min_by("user_id", F.struct("ts", "event_id")).alias("slide"))


@query("""SELECT p_type AS prefix, count(*) AS n_uncited FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45) GROUP BY 1""")
def uncited_by_prefix(t: Tables) -> DataFrame:
    return t.part.join(t.lineitem.where("l_quantity > 45"), F.col("p_partkey") == F.col("l_partkey"), "left_anti").groupBy(F.col("p_type").alias("prefix")).agg(F.count("*").alias("n_uncited"))


@query("""WITH c AS (SELECT DISTINCT p_brand AS source, upper(p_brand) AS translated FROM part WHERE p_size > 25) SELECT p_partkey, coalesce(translated, p_brand) AS shown, translated IS NOT NULL AS hit FROM part LEFT JOIN c ON p_brand = source""")
def translation_join(t: Tables) -> DataFrame:
    cache = t.part.where("p_size > 25").select("p_brand").distinct().select(values.text_key(F.col("p_brand"), "en").alias("key"), F.upper("p_brand").alias("translated"))
    j = t.part.withColumn("key", values.text_key(F.col("p_brand"), "en")).join(cache, "key", "left")
    return j.select("p_partkey", F.coalesce("translated", "p_brand").alias("shown"), F.col("translated").isNotNull().alias("hit"))


@query("""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 4 <> 0 THEN lang END AS lang, CASE WHEN doc_id % 5 <> 0 THEN source END AS source, NULL AS nothing FROM documents)
SELECT doc_id, 'core' AS kind, 'lang' AS field FROM d WHERE lang IS NULL UNION ALL SELECT doc_id, 'other', 'source' FROM d WHERE source IS NULL""")
def gaps_report(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", F.when(F.col("doc_id") % 4 != 0, F.col("lang")).alias("lang"), F.when(F.col("doc_id") % 5 != 0, F.col("source")).alias("source"), F.lit(None).cast("string").alias("nothing"))
    return sinks.gaps_report(d, "doc_id", ["lang"], ["source", "nothing"])


@query("""SELECT s_name AS "Park", CASE WHEN s_suppkey % 3 = 0 THEN 'tbd' ELSE s_nationkey::VARCHAR END AS "Country" FROM supplier""")
def flat_export(t: Tables) -> DataFrame:
    rows = t.supplier.select("s_suppkey", F.col("s_name").alias("park"), F.when(F.col("s_suppkey") % 3 == 0, "n/a").otherwise(F.col("s_nationkey").cast("string")).alias("country"))
    return sinks.flat_export(rows, {"park": "Park", "country": "Country"}, [F.col("s_suppkey")])


@query("""SELECT n_regionkey, count(*) AS n, min(n_name) AS first_item FROM nation GROUP BY 1""")
def payload_document(t: Tables) -> DataFrame:
    """The document's own count and first item, read back from its JSON."""
    doc = sinks.payload(t.nation, "n_regionkey", ["n_name"])
    x = F.from_json("document", "n bigint, items array<struct<n_name:string>>")
    return doc.select("n_regionkey", x.alias("x")).select("n_regionkey", "x.n", F.col("x.items")[0]["n_name"].alias("first_item"))


@query("""WITH r AS (SELECT l_shipdate::DATE AS day, l_returnflag, count(*) FILTER (WHERE l_quantity < 25) AS bare, count(*) FILTER (WHERE l_quantity >= 25) AS measured, count(*) FILTER (WHERE l_quantity >= 25 AND l_linestatus = 'O') AS o, count(*) FILTER (WHERE l_quantity >= 25 AND l_linestatus = 'F') AS f FROM lineitem GROUP BY 1, 2)
SELECT day, l_returnflag, bare, measured, bare > 0 AND measured >= 3 AND 2 * greatest(o, f) >= measured AS flagged FROM r""")
def value_format_gate(t: Tables) -> DataFrame:
    """Bare values among measured ones of which most have one unit."""
    m = F.col("l_quantity") >= 25
    r = t.lineitem.groupBy(F.to_date("l_shipdate").alias("day"), "l_returnflag").agg(F.count_if(~m).alias("bare"), F.count_if(m).alias("measured"), F.count_if(m & (F.col("l_linestatus") == "O")).alias("o"), F.count_if(m & (F.col("l_linestatus") == "F")).alias("f"))
    return r.select("day", "l_returnflag", "bare", "measured", ((F.col("bare") > 0) & (F.col("measured") >= 3) & (2 * F.greatest("o", "f") >= F.col("measured"))).alias("flagged"))


@query("""WITH u AS (SELECT source, count(*) FILTER (WHERE lang = 'en') AS ft, count(*) FILTER (WHERE lang <> 'en') AS sm FROM documents GROUP BY 1) SELECT source, least(ft, sm) >= 2 AND least(ft, sm)::DOUBLE / (ft + sm) >= 0.15 AS ask FROM u""")
def unit_questions(t: Tables) -> DataFrame:
    u = t.documents.groupBy("source").agg(F.count_if(F.col("lang") == "en").alias("ft"), F.count_if(F.col("lang") != "en").alias("sm"))
    few = F.least("ft", "sm")
    return u.select("source", ((few >= 2) & (few / (F.col("ft") + F.col("sm")) >= 0.15)).alias("ask"))


@query("""WITH d AS (SELECT doc_id, n_chars, CASE WHEN doc_id % 3 <> 0 THEN lang END AS lang, source FROM documents), n AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) AS n FROM d) SELECT doc_id FROM n WHERE n = 1 OR lang IS NULL""")
def dedup_with_whole_keys(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", "n_chars", F.when(F.col("doc_id") % 3 != 0, F.col("lang")).alias("lang"), "source")
    return merge.keep_first(d, ["lang", "source"], [F.col("n_chars").desc(), F.col("doc_id")], null_keys_pass=True).select("doc_id")


@query("""WITH g AS (SELECT url, min(page_id) AS seq, string_agg(lpad(page_id::VARCHAR, 6, '0'), '+' ORDER BY page_id) AS prefix FROM pages GROUP BY 1),
n AS (SELECT *, regexp_extract(url, '([^/?]*)/?[^/]*$', 1) AS base FROM g), s AS (SELECT *, row_number() OVER (PARTITION BY lower(base) ORDER BY seq) AS n FROM n)
SELECT url, prefix, CASE WHEN n = 1 THEN lower(base) ELSE lower(base) || '-' || n END AS target FROM s""")
def downloads(t: Tables) -> DataFrame:
    """One download for each address, named after all its rows, with a target name of its own."""
    g = t.pages.groupBy("url").agg(F.min("page_id").alias("seq"), F.array_join(F.transform(F.array_sort(F.collect_list("page_id")), lambda x: F.lpad(x.cast("string"), 6, "0")), "+").alias("prefix"))
    named = g.withColumn("base", F.lower(F.regexp_extract("url", r"([^/?]*)/?[^/]*$", 1)))
    return merge.with_suffixes(named, "base", "seq", "target").select("url", "prefix", "target")


@query("""SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')""")
def settled_clusters(t: Tables) -> DataFrame:
    return t.customer.join(t.orders.where("o_orderstatus = 'O'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_nationkey")


@query("""SELECT source, bool_and(lang = 'en') AS skip FROM documents GROUP BY 1""")
def lang_skip(t: Tables) -> DataFrame:
    return t.documents.groupBy("source").agg(F.bool_and(F.col("lang") == "en").alias("skip"))


@query("""SELECT name, n FROM (SELECT p_type AS name, count(DISTINCT p_brand) AS n FROM part GROUP BY 1) WHERE n > 1""")
def ambiguous_names(t: Tables) -> DataFrame:
    return t.part.groupBy(F.col("p_type").alias("name")).agg(F.count_distinct("p_brand").alias("n")).where("n > 1")


@query("""SELECT p_partkey, p_brand || CASE WHEN count(*) OVER (PARTITION BY p_brand, p_size) > 1 THEN '-' || substr(sha256(p_name || p_partkey), 1, 6) ELSE '' END AS output FROM part""")
def stable_names(t: Tables) -> DataFrame:
    """A hash is added only where the label is shared."""
    shared = F.count("*").over(Window.partitionBy("p_brand", "p_size")) > 1
    return t.part.select("p_partkey", F.concat("p_brand", F.when(shared, F.concat(F.lit("-"), F.substring(F.sha2(F.concat("p_name", "p_partkey").cast("binary"), 256), 1, 6))).otherwise("")).alias("output"))


_NAMES = ["Tracker.xlsx", "Brochure A.PDF", "mail.eml", "photo.jpeg", "notes.txt"]


@query(f"SELECT s_suppkey, ['tracker', 'brochure', 'mail', 'image', 'other'][(1 + s_suppkey % 5)::INT] AS family, {_sql(['xlsx', 'pdf', 'eml', 'jpeg', 'txt'])}[(1 + s_suppkey % 5)::INT] AS ext FROM supplier")
def record_family(t: Tables) -> DataFrame:
    name = _pick(_NAMES, "s_suppkey")
    return t.supplier.select("s_suppkey", values.record_family(name).alias("family"), F.lower(F.regexp_extract(name, r"\.(\w+)$", 1)).alias("ext"))


@query("""SELECT n_nationkey, list_sort(list_distinct([trim(n_name), 'Bozen', 'Bolzano'])) = list_sort(['Bozen', 'Bolzano', n_name]) AS same, 3 AS n FROM nation""")
def name_variants(t: Tables) -> DataFrame:
    v = text.name_variants(F.concat(F.col("n_name"), F.lit(" / Bozen (Bolzano) - "), F.col("n_name")))
    return t.nation.select("n_nationkey", (v == F.array_sort(F.array(F.lit("Bozen"), F.lit("Bolzano"), F.col("n_name")))).alias("same"), F.size(v).alias("n"))


@query("""SELECT user_id, arg_max(event_id, struct_pack(ts := ts, id := event_id)) AS event_id FROM events GROUP BY 1""")
def stream_newest(t: Tables) -> DataFrame:
    """newest_by_key as a stream that is run until its input is used up; its last state is the table."""
    schema = t.events.schema
    feed = feeds.newest_by_key(feeds.read_feed(t.spark, f"{t.sf_dir}/events.parquet*", schema), "user_id", ["ts", "event_id"], "event_id")
    at = f"{shared_dir(t.spark)}/stream-{uuid.uuid4().hex}"
    q = feed.writeStream.outputMode("complete").option("checkpointLocation", f"{at}/state").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{at}/table")).trigger(availableNow=True).start()
    q.awaitTermination()
    return t.spark.read.parquet(f"{at}/table").select("user_id", "event_id")


def _parts(t: Tables) -> DataFrame:
    """Parts as records. Every fourth has no place; neighbours by number stand 0.1 or 1.1 km apart."""
    k = F.col("p_partkey")
    pair = F.floor(k / 2)
    lat = 40 + (pair % 1009) / 100 + F.when(k % 2 == 0, 0.0).when(pair % 2 == 0, 0.001).otherwise(0.01)
    placed = lambda c: F.when(k % 4 != 0, c)
    return t.part.select(
        k.alias("seq"), F.concat(F.lit("s"), k % 3).alias("source"), F.col("p_name").alias("park"), F.col("p_brand").alias("developer"), F.col("p_type").alias("city"),
        F.col("p_size").cast("string").alias("area"), F.lit("sq m").alias("unit"), placed(lat).alias("lat"), placed(10 + (pair * 7 % 640) / 100).alias("lng"),
    )


_GENERIC = "['" + "', '".join(resolve.GENERIC) + "']"


@query(f"""WITH p AS (SELECT p_partkey AS a, p_partkey % 3 AS source, p_name AS park, lower(p_type) AS city, p_size AS area, list_sort(list_distinct(list_filter(string_split(p_name, ' '), lambda x: x <> '' AND NOT list_contains({_GENERIC}, x)))) AS tokens,
  CASE WHEN p_partkey % 4 <> 0 THEN 40 + (p_partkey // 2 % 1009) / 100.0::DOUBLE + CASE WHEN p_partkey % 2 = 0 THEN 0 WHEN p_partkey // 2 % 2 = 0 THEN 0.001::DOUBLE ELSE 0.01::DOUBLE END END AS lat, CASE WHEN p_partkey % 4 <> 0 THEN 10 + (p_partkey // 2 * 7 % 640) / 100.0::DOUBLE END AS lng FROM part),
j AS (SELECT l.a, r.a AS b, l.source = r.source AS alike, l.city = r.city AS cities, l.park = r.park AS parks, abs(l.area - r.area) / greatest(l.area, r.area)::DOUBLE AS gap, l.tokens AS lt, r.tokens AS rt, string_split(l.city || ' ' || r.city, ' ') AS places,
  12742 * asin(least(1, sqrt(power(sin(radians(r.lat - l.lat) / 2), 2) + cos(radians(l.lat)) * cos(radians(r.lat)) * power(sin(radians(r.lng - l.lng) / 2), 2)))) AS km FROM p l JOIN p r ON l.a < r.a WHERE l.city = r.city OR list_has_any(l.tokens, r.tokens) OR (abs(l.lat - r.lat) < 0.02 AND abs(l.lng - r.lng) < 0.03)),
m AS (SELECT * FROM j WHERE cities OR list_has_any(lt, rt) OR km <= 2)
SELECT a, b, CASE WHEN alike THEN CASE WHEN cities AND parks AND gap <= 0.01 THEN 'auto' ELSE 'forbidden' END WHEN coalesce(km <= 0.3, FALSE) AND gap <= 0.15 THEN 'auto'
  WHEN len(lt) > 0 AND len(rt) > 0 AND (list_has_all(rt, lt) OR list_has_all(lt, rt)) AND cities AND gap <= 0.05 THEN 'auto' END AS easy,
  gap > 0.15 AS veto, coalesce(km <= 2, FALSE) AS near, len(list_filter(list_intersect(lt, rt), lambda x: NOT list_contains(places, x))) > 0 AS token FROM m""")
def pair_rules(t: Tables) -> DataFrame:
    """What the rules without a ratio of texts say of the pairs of parts that meet by key, token, place or party."""
    return resolve.judge_pairs(resolve.prepare(_parts(t))).select("a", "b", "easy", "veto", "near", "token")


@query()
def pair_classes(t: Tables) -> DataFrame:
    """Classes of the pairs of parts that meet by key, token, place or party; ratios of texts have no SQL form."""
    return resolve.classify_pairs(resolve.prepare(_parts(t)))
