"""Gates and side inputs on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import gates

from .registry import Tables, query


@query("""WITH g AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity = 10 + l_orderkey % 30 AS gross FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, gross, gross AND bool_or(gross) OVER (PARTITION BY l_orderkey) AND NOT bool_and(gross) OVER (PARTITION BY l_orderkey) AS demoted FROM g""")
def gross_split(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", (10 + F.col("l_orderkey") % 30).cast("double").alias("stated"))
    return gates.gross_split(rows, "l_orderkey", "l_quantity", "stated").select("l_orderkey", "l_linenumber", "l_partkey", "gross", "demoted")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE n_name END || CASE WHEN c_custkey % 2 = 0 THEN ', ' || n_name ELSE '' END AS label FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def cluster_label(t: Tables) -> DataFrame:
    j = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.select("c_custkey", gates.label(F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")), F.col("n_name"), town=F.col("n_name")).alias("label"))


@query("""SELECT p_brand, regexp_replace(printf('%.1f', min(p_size) / 10.0), '\\.0$', '') || CASE WHEN min(p_size) = max(p_size) THEN 'k' ELSE ' - ' || regexp_replace(printf('%.1f', max(p_size) / 10.0), '\\.0$', '') || 'k' END AS shown FROM part GROUP BY 1""")
def size_range(t: Tables) -> DataFrame:
    g = t.part.groupBy("p_brand").agg((F.min("p_size") * 100).alias("lo"), (F.max("p_size") * 100).alias("hi"))
    return g.select("p_brand", gates.thousands(F.col("lo"), F.col("hi")).alias("shown"))


@query("""WITH e AS (SELECT c_custkey AS seq, 'land' || c_custkey % 5 AS searched, unnest([0, 1]) AS pos, unnest(['Land' || c_nationkey % 5, 'land' || c_custkey % 5]) AS country, unnest(['Site' || c_custkey % 50, 'site' || c_nationkey]) AS place FROM customer),
k AS (SELECT *, lower(country) || '|' || lower(place) AS key FROM e)
SELECT key, arg_min(country, struct_pack(s := seq, p := pos)) AS country, arg_min(place, struct_pack(s := seq, p := pos)) AS place, array_to_string(list_sort(list(DISTINCT searched)), ',') AS mentioned_by, bool_or(lower(searched) <> lower(country)) AS cross_border FROM k GROUP BY 1""")
def absorb_leads(t: Tables) -> DataFrame:
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    lead = lambda c, p: F.struct(c.alias("country"), p.alias("place"))
    blocks = t.customer.select(k.alias("seq"), F.concat(F.lit("land"), k % 5).alias("searched"), F.array(lead(F.concat(F.lit("Land"), n % 5), F.concat(F.lit("Site"), k % 50)), lead(F.concat(F.lit("land"), k % 5), F.concat(F.lit("site"), n))).alias("leads"))
    return gates.absorb_leads(blocks, "searched", "leads", "seq").withColumn("mentioned_by", F.array_join("mentioned_by", ","))


@query("""WITH d AS (SELECT doc_id, source, n_chars, CASE WHEN doc_id % 2 = 0 THEN lang END AS lang, CASE WHEN doc_id % 3 = 0 THEN n_chars END AS size FROM documents), s AS (SELECT *, count(*) OVER (PARTITION BY source, n_chars) > 1 AS same FROM d)
SELECT doc_id, 'duplicate' AS problem FROM s WHERE same UNION ALL SELECT doc_id, 'thin' FROM s WHERE ((lang IS NOT NULL)::INT + (size IS NOT NULL)::INT) / 2.0 < 0.5""")
def coverage_gate(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", "source", "n_chars", F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("lang"), F.when(F.col("doc_id") % 3 == 0, F.col("n_chars")).alias("size"))
    return gates.coverage(d, "doc_id", ["source", "n_chars"], ["lang", "size"], 0.5)


@query("""WITH a AS (SELECT l_partkey % 50 AS k FROM lineitem WHERE l_orderkey % 7 <> 0), b AS (SELECT l_partkey % 50 AS k FROM lineitem WHERE l_orderkey % 5 <> 0) SELECT k, 'left' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT k, 'right' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def reconcile_rows(t: Tables) -> DataFrame:
    part = lambda n: t.lineitem.where(f"l_orderkey % {n} <> 0").select((F.col("l_partkey") % 50).alias("k"))
    return gates.reconcile(part(7), part(5))


@query("""WITH c AS (SELECT item_id, item_id + 1 AS doc, CASE WHEN item_id % 2 = 0 THEN substr(text, 1, 40) ELSE 'zzzzq ' || substr(text, 1, 20) END AS said, text FROM benchmark)
SELECT item_id, item_id % 2 = 0 AS found FROM c""")
def provenance_containment(t: Tables) -> DataFrame:
    """Half of the claims are cut from their page, the others hold a word that no page has; cut words count as they stand."""
    page = t.benchmark.select("item_id", "text")
    claims = page.select("item_id", F.when(F.col("item_id") % 2 == 0, F.substring("text", 1, 40)).otherwise(F.concat(F.lit("zzzzq "), F.substring("text", 1, 20))).alias("said"))
    return gates.contained(claims, page, ["item_id"], "said", "text").select("item_id", "found")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'N' AND l_quantity > 10 THEN CASE WHEN l_suppkey % 2 = 0 THEN 'sq ft' END WHEN l_returnflag <> 'N' THEN 'sq m' END AS unit FROM lineitem""")
def apply_answers(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(F.col("l_quantity") > 10, F.col("l_quantity")).alias("value"), F.when(F.col("l_returnflag") != "N", "sq m").alias("unit"))
    answers = t.supplier.where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("l_suppkey"), F.lit("sq ft").alias("unit"))
    return gates.apply_answers(rows, answers, "l_suppkey", "value", "unit").select("l_orderkey", "l_linenumber", "l_partkey", "unit")


@query("""WITH c AS (SELECT o_orderkey // 4 AS park, count(DISTINCT o_orderpriority) AS n, min(o_orderpriority) AS family FROM orders GROUP BY 1) SELECT family, count(*) AS clusters FROM c WHERE n = 1 GROUP BY 1""")
def authority_extras(t: Tables) -> DataFrame:
    return gates.only_family(t.orders.select(F.floor(F.col("o_orderkey") / 4).alias("park"), F.col("o_orderpriority").alias("family")), "park", "family")


@query("""SELECT run, array_to_string(list_sort(list(DISTINCT k)), ',') AS keys FROM (SELECT user_id % 9 AS run, event_type AS k FROM events WHERE event_id % 2 = 0 UNION ALL SELECT user_id % 9, event_type FROM events WHERE event_id % 2 <> 0 OR event_id % 3 = 0) GROUP BY 1""")
def merge_acks(t: Tables) -> DataFrame:
    part = lambda rows: t.events.where(rows).select((F.col("user_id") % 9).alias("run"), F.array("event_type").alias("keys"))
    return gates.merge_acks(part("event_id % 2 = 0"), part("event_id % 2 <> 0 or event_id % 3 = 0"), "run", "keys").withColumn("keys", F.array_join("keys", ","))


@query("""WITH r AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN s_nationkey END AS a, s_suppkey % 3 AS b, s_name AS nm, s_nationkey AS c FROM supplier), l AS (SELECT c_custkey, c_nationkey AS a, c_custkey % 3 AS b, c_nationkey AS c FROM customer),
p AS (SELECT a, b, max(id) AS id FROM r WHERE a IS NOT NULL GROUP BY 1, 2), n AS (SELECT c, max(id) AS id FROM r GROUP BY 1)
SELECT c_custkey, coalesce(p.id, n.id) AS id, CASE WHEN p.id IS NOT NULL THEN 'place' ELSE 'name' END AS "by" FROM l LEFT JOIN p USING (a, b) LEFT JOIN n USING (c) WHERE coalesce(p.id, n.id) IS NOT NULL""")
def match_by_place_or_name(t: Tables) -> DataFrame:
    r = t.supplier.select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_nationkey")).alias("a"), (F.col("s_suppkey") % 3).alias("b"), F.col("s_nationkey").alias("c"))
    rows = t.customer.select("c_custkey", F.col("c_nationkey").alias("a"), (F.col("c_custkey") % 3).alias("b"), F.col("c_nationkey").alias("c"))
    return gates.match_by_place_or_name(rows, r, "c_custkey", ["a", "b"], ["c"], F.col("id"))


@query("""WITH g AS (SELECT n_name AS name, n_nationkey AS ord FROM nation), p AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN n_name WHEN 1 THEN substr(n_name, 1, 6) ELSE 'x ' || n_name END AS city FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT c_custkey, city, coalesce((SELECT name FROM g WHERE name = city), (SELECT arg_min(name, ord) FROM g WHERE contains(name, city) OR contains(city, name))) AS matched FROM p""")
def contains_lookup(t: Tables) -> DataFrame:
    k = F.col("c_custkey") % 3
    places = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.when(k == 0, F.col("n_name")).when(k == 1, F.substring("n_name", 1, 6)).otherwise(F.concat(F.lit("x "), "n_name")).alias("city"))
    return gates.contains_lookup(places, "city", t.nation.select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("ord")), "name", "ord")


@query("""SELECT source, count(*) AS parsed, count(*) FILTER (WHERE n_chars > 1000) AS attachments, sum(n_chars)::BIGINT AS bytes FROM documents GROUP BY 1""")
def batch_counters(t: Tables) -> DataFrame:
    return t.documents.groupBy("source").agg(F.count("*").alias("parsed"), F.count_if(F.col("n_chars") > 1000).alias("attachments"), F.sum("n_chars").alias("bytes"))


@query("""SELECT DISTINCT k.field FROM (SELECT unnest(json_keys(props)) AS field FROM events) k""")
def field_union(t: Tables) -> DataFrame:
    keys = F.map_keys(F.from_json("props", "map<string,string>"))
    return t.events.select(F.explode(keys).alias("field")).distinct()
