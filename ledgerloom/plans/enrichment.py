"""Enrichment on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import text
from ledgerloom.operators import enrich

from .registry import Tables, query


@query("""WITH a AS (SELECT c_custkey AS k, 'A' || c_nationkey AS v FROM customer WHERE c_custkey % 4 = 0), b AS (SELECT c_custkey AS k, 'B' || c_nationkey AS v FROM customer WHERE c_custkey % 3 = 0)
SELECT c_custkey, coalesce(a.v, b.v) AS region, CASE WHEN a.v IS NOT NULL THEN 'polygon' WHEN b.v IS NOT NULL THEN 'label' END AS region_by FROM customer LEFT JOIN a ON a.k = c_custkey LEFT JOIN b ON b.k = c_custkey""")
def region_cascade(t: Tables) -> DataFrame:
    c = t.customer
    step = lambda p, n: c.where(f"c_custkey % {n} = 0").select(F.col("c_custkey").alias("k"), F.concat(F.lit(p), "c_nationkey").alias("v"))
    return enrich.cascade(c.select("c_custkey"), "c_custkey", [("polygon", step("A", 4)), ("label", step("B", 3))], "region")


_GAZ = "g AS (SELECT n_name AS name, 'XA' AS cc, 45 + n_nationkey / 10.0::DOUBLE AS lat, 5 + n_regionkey / 10.0::DOUBLE AS lng FROM nation UNION ALL SELECT n_name, 'XB', -45, 100 FROM nation WHERE n_nationkey % 2 = 0)"


@query(f"""WITH {_GAZ}, p AS (SELECT c_custkey AS seq, n_name AS city, CASE WHEN c_custkey % 4 = 0 THEN 'XB' END AS country FROM customer JOIN nation ON c_nationkey = n_nationkey),
s AS (SELECT *, count(*) OVER (PARTITION BY name) AS same FROM g)
SELECT p.seq, coalesce(x.lat, CASE WHEN p.country IS NULL THEN y.lat END) AS lat, coalesce(x.lng, CASE WHEN p.country IS NULL THEN y.lng END) AS lng, CASE WHEN x.lat IS NOT NULL THEN 'exact' WHEN p.country IS NULL THEN 'dominant' ELSE 'none' END AS how
FROM p LEFT JOIN s x ON x.name = p.city AND (x.cc = p.country OR (p.country IS NULL AND x.same = 1)) JOIN s y ON y.name = p.city AND y.cc = (SELECT cc FROM p JOIN s ON name = city AND same = 1 WHERE country IS NULL OR country = cc GROUP BY cc ORDER BY count(*) DESC, cc LIMIT 1)""")
def two_pass_places(t: Tables) -> DataFrame:
    """Most places lie in XA, so names of both countries go there unless the record says otherwise."""
    n = t.nation
    xa = n.select(F.col("n_name").alias("name"), F.lit("XA").alias("cc"), (45 + F.col("n_nationkey") / 10.0).alias("lat"), (5 + F.col("n_regionkey") / 10.0).alias("lng"))
    xb = n.where("n_nationkey % 2 = 0").select(F.col("n_name").alias("name"), F.lit("XB").alias("cc"), F.lit(-45.0).alias("lat"), F.lit(100.0).alias("lng"))
    records = t.customer.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("seq"), F.col("n_name").alias("city"), F.when(F.col("c_custkey") % 4 == 0, "XB").alias("country"))
    return enrich.two_pass_places(records, "seq", "city", "country", xa.unionByName(xb)).select("seq", "lat", "lng", "how")


@query("""WITH d AS (SELECT s_suppkey, s_nationkey AS code, CASE WHEN s_suppkey % 3 = 0 THEN 'Old name' WHEN s_suppkey % 3 = 1 THEN n_name END AS label, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey), l AS (SELECT *, (SELECT count(DISTINCT label) FROM d x WHERE x.code = d.code) AS labels FROM d)
SELECT s_suppkey, code, CASE WHEN labels >= 2 THEN n_name ELSE label END AS label, CASE WHEN labels >= 2 AND label IS DISTINCT FROM n_name THEN label END AS label_stated FROM l""")
def harmonise_regions(t: Tables) -> DataFrame:
    k = F.col("s_suppkey") % 3
    d = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("s_nationkey").alias("code"), F.when(k == 0, "Old name").when(k == 1, F.col("n_name")).alias("label"))
    return enrich.harmonise(d, "label", "code", t.nation.select("n_nationkey", "n_name"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE l_partkey % 4 WHEN 0 THEN l_quantity WHEN 1 THEN round(l_quantity * 10.7639::DOUBLE, 4) WHEN 3 THEN l_quantity END AS aligned, CASE l_partkey % 4 WHEN 0 THEN 'kept' WHEN 1 THEN 'converted' WHEN 2 THEN 'withheld' ELSE 'assumed' END AS state FROM lineitem""")
def unit_alignment(t: Tables) -> DataFrame:
    k = F.col("l_partkey") % 4
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", F.when(k == 0, "sq ft").when(k == 1, "sq m").when(k == 2, "mystery").alias("unit"))
    return enrich.align_areas(rows, "l_quantity", "unit", F.lit("sq ft")).select("l_orderkey", "l_linenumber", "l_partkey", "aligned", "state")


@query("""SELECT l_orderkey, l_linenumber, round(q * d + coalesce(CASE WHEN l_returnflag = 'A' THEN t END, 0) * coalesce(CASE WHEN l_linestatus = 'O' THEN 2.0::DECIMAL(9, 4) END, d), 2)::DOUBLE AS total
FROM (SELECT *, l_quantity::DECIMAL(9, 4) AS q, l_discount::DECIMAL(9, 4) AS d, l_tax::DECIMAL(9, 4) AS t FROM lineitem)""")
def total_rent(t: Tables) -> DataFrame:
    x = enrich.total_rent(F.col("l_quantity"), F.col("l_discount"), F.when(F.col("l_returnflag") == "A", F.col("l_tax")), F.when(F.col("l_linestatus") == "O", 2.0))
    return t.lineitem.select("l_orderkey", "l_linenumber", x.alias("total"))


@query("""SELECT s_suppkey, t AS target, (s_suppkey % 50 + t)::BIGINT AS minutes, (s_suppkey % 90 + t * 10)::DOUBLE AS km FROM supplier, range(3) r(t) WHERE s_suppkey % 5 <> 0""")
def ingest_routes(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    num = lambda c: c.cast("double").cast("string")
    secs = F.concat_ws(",", F.lit("0"), *[num((k % 50 + i) * 60) for i in range(3)])
    metres = F.concat_ws(",", F.lit("0"), *[num((k % 90 + i * 10) * 1000) for i in range(3)])
    body = F.when(k % 5 == 0, F.lit('{"error": "quota"}')).otherwise(F.concat(F.lit('{"durations": [['), secs, F.lit(']], "distances": [['), metres, F.lit("]]}")))
    return enrich.ingest_routes(t.supplier.select("s_suppkey", body.alias("body")), "s_suppkey", "body", 1)


@query("""WITH m AS (SELECT o_custkey, min(o_orderkey) AS seq, count(*) AS n_members, list_sort(list(DISTINCT o_orderstatus)) AS v, list_sort(list(DISTINCT CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END) FILTER (WHERE o_orderpriority <> '5-LOW')) AS p, count(DISTINCT o_orderkey % 7) AS n_sources FROM orders GROUP BY 1)
SELECT o_custkey, seq, n_members, CASE len(v) WHEN 1 THEN v[1] ELSE 'tbd' END AS status, CASE WHEN len(p) = 1 THEN p[1] WHEN len(p) > 1 THEN 'tbd' END AS priority, CASE WHEN len(p) > 1 THEN array_to_string(p, ',') END AS priority_conflict, n_sources FROM m""")
def merge_members(t: Tables) -> DataFrame:
    rows = t.orders.select("o_custkey", F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("status"), F.when(F.col("o_orderpriority") == "5-LOW", "TBD").otherwise(F.col("o_orderpriority")).alias("priority"), F.array(F.struct((F.col("o_orderkey") % 7).cast("string").alias("url"), F.lit(1).alias("tier"))).alias("sources"))
    m = enrich.merge_members(rows, "o_custkey", "seq", ["status", "priority"])
    return m.select("o_custkey", "seq", "n_members", "status", "priority", F.array_join("priority_conflict", ",").alias("priority_conflict"), F.size("sources").cast("long").alias("n_sources"))


@query("SELECT l_partkey, l_linenumber, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_suppkey) = 1")
def sole_claims(t: Tables) -> DataFrame:
    return enrich.sole_claims(t.lineitem, ["l_partkey", "l_linenumber"], "l_suppkey")


@query("SELECT sha256(text) AS sig, min(doc_id) AS page, max(n_chars) AS score FROM documents GROUP BY 1")
def best_by_signature(t: Tables) -> DataFrame:
    rows = t.documents.select(F.sha2(F.col("text").cast("binary"), 256).alias("sig"), F.col("doc_id").alias("page"), F.col("n_chars").alias("score"))
    return enrich.best_by_signature(rows, "sig", "page", "score")


@query("""SELECT c_custkey, 'body of ' || c_name AS why, c_nationkey::VARCHAR AS owner, (SELECT string_agg(n::VARCHAR, ',' ORDER BY n) FROM (SELECT unnest(string_split('a' || chr(10) || 'b — ' || c_name || chr(10) || 'd-e' || chr(10) || CASE WHEN c_custkey % 2 = 0 THEN 'f – g' ELSE 'f g' END, chr(10))) AS l, generate_subscripts(string_split('a' || chr(10) || 'b' || chr(10) || 'c' || chr(10) || 'd', chr(10)), 1) AS n) WHERE contains(l, '—') OR contains(l, '–')) AS dashes FROM customer""")
def document_sections(t: Tables) -> DataFrame:
    doc = F.concat(F.lit("# Sheet\n## Why\nbody of "), "c_name", F.lit("\n## Facts\n- Owner: "), F.col("c_nationkey").cast("string"), F.lit(" \n## Why\nsecond"))
    s = text.sections(doc)
    dashes = text.dash_lines(F.concat(F.lit("a\nb — "), "c_name", F.lit("\nd-e\n"), F.when(F.col("c_custkey") % 2 == 0, "f – g").otherwise("f g")))
    return t.customer.select("c_custkey", s["Why"].alias("why"), text.field_value(s["Facts"], "owner").alias("owner"), F.array_join(dashes.cast("array<string>"), ",").alias("dashes"))


@query("""SELECT o_orderkey, 'M' || (1 + o_orderkey % 60) || ' J' || (1 + o_orderkey % 30) || CASE WHEN o_orderkey % 2 = 0 THEN ' 2 miles' ELSE '' END AS motorway FROM orders""")
def short_motorway(t: Tables) -> DataFrame:
    road, j = F.concat(F.lit("M"), 1 + F.col("o_orderkey") % 60), 1 + F.col("o_orderkey") % 30
    said = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("about 2 miles from Junction "), j, F.lit(" of the "), road)).otherwise(F.concat(F.lit("on the "), road, F.lit(", J"), j))
    return t.orders.select("o_orderkey", text.short_motorway(said).alias("motorway"))


@query("""SELECT p_partkey, array_to_string(list_sort(list_distinct([1000 + p_partkey, 2500000])), ',') AS figures FROM part""")
def page_figures(t: Tables) -> DataFrame:
    said = F.concat(F.lit("hall of "), F.format_number(1000 + F.col("p_partkey"), 0), F.lit(" sq m, plot 2.500.000; 12 docks, 999"))
    return t.part.select("p_partkey", F.array_join(text.figures(said).cast("array<string>"), ",").alias("figures"))
