"""Windows, sorts, filters, pivots and graphs on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators import graph

from .registry import Tables, query


@query("""SELECT event_id, v FROM (SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN value END AS v FROM events) ORDER BY v DESC NULLS LAST, event_id LIMIT 100""")
def nulls_sink_topk(t: Tables) -> DataFrame:
    """The top 100, unknown values last whatever the direction."""
    rows = t.events.select("event_id", F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("v"))
    return rows.orderBy(F.col("v").desc_nulls_last(), "event_id").limit(100)


@query("""WITH a AS (SELECT p_partkey, p_name, CASE WHEN p_partkey % 7 <> 0 THEN p_size END AS area FROM part), f AS (SELECT min(area) AS low FROM a)
SELECT p_partkey, 20 AS floor_size FROM a WHERE area >= 20 UNION ALL SELECT p_partkey, low FROM a, f WHERE area IS NULL OR area >= low""")
def size_filter(t: Tables) -> DataFrame:
    """Unknown areas pass only while the floor is the smallest area there is."""
    a = t.part.select("p_partkey", F.when(F.col("p_partkey") % 7 != 0, F.col("p_size")).alias("area"))
    low = a.agg(F.min("area").alias("low"))  # one row
    floors = a.crossJoin(F.broadcast(low)).select("*", F.explode(F.array(F.lit(20), F.col("low"))).alias("floor_size"))
    return floors.where(F.when(F.col("area").isNull(), F.col("floor_size") == F.col("low")).otherwise(F.col("area") >= F.col("floor_size"))).select("p_partkey", "floor_size")


@query("""SELECT c_custkey, c_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE (c_name || ' ' || n_name) ILIKE '%1%' AND n_regionkey IN (1, 3) AND c_acctbal >= 1000""")
def filter_toolbar(t: Tables) -> DataFrame:
    j = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.where(F.concat_ws(" ", "c_name", "n_name").ilike("%1%") & F.col("n_regionkey").isin(1, 3) & (F.col("c_acctbal") >= 1000)).select("c_custkey", "c_name")


@query("""SELECT n_regionkey, arg_max(c_custkey, struct_pack(b := c_acctbal, k := -c_custkey)) AS largest, arg_min(c_custkey, struct_pack(b := c_acctbal, k := c_custkey)) AS cheapest FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal IS NOT NULL GROUP BY 1""")
def compare_highlight(t: Tables) -> DataFrame:
    j = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).where("c_acctbal is not null")
    return j.groupBy("n_regionkey").agg(F.max_by("c_custkey", F.struct("c_acctbal", -F.col("c_custkey"))).alias("largest"), F.min_by("c_custkey", F.struct("c_acctbal", "c_custkey")).alias("cheapest"))


@query("""WITH w AS (SELECT l_orderkey, l_linenumber, l_quantity, lag(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS before FROM lineitem) SELECT l_orderkey, min(l_linenumber) AS first_inversion FROM w WHERE l_quantity > before GROUP BY 1""")
def rank_order_check(t: Tables) -> DataFrame:
    """Where a sequence that must not rise first does."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return t.lineitem.withColumn("before", F.lag("l_quantity").over(w)).where("l_quantity > before").groupBy("l_orderkey").agg(F.min("l_linenumber").alias("first_inversion"))


@query("""SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn, text) AS following FROM conversations""")
def line_pairs(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", "text", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn", "text")).alias("following"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'N' THEN sum(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS UNBOUNDED PRECEDING)::BIGINT END AS ordinal FROM lineitem""")
def ordinal_numbering(t: Tables) -> DataFrame:
    """Rows with data are numbered on; others have no number."""
    on = F.col("l_returnflag") == "N"
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").rowsBetween(Window.unboundedPreceding, 0)
    return t.lineitem.select("l_orderkey", "l_linenumber", F.when(on, F.sum(on.cast("long")).over(w)).alias("ordinal"))


@query("""WITH s AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) SELECT user_id, count(*) FILTER (WHERE event_type = before) AS repeats, count(DISTINCT event_type) AS shapes, count(*) AS n FROM s GROUP BY 1""")
def scene_repeats(t: Tables) -> DataFrame:
    s = t.events.withColumn("before", F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return s.groupBy("user_id").agg(F.count_if(F.col("event_type") == F.col("before")).alias("repeats"), F.count_distinct("event_type").alias("shapes"), F.count("*").alias("n"))


@query("""SELECT user_id, arg_max(event_id, struct_pack(ts := ts, id := event_id)) AS event_id, max(ts) AS ts FROM events GROUP BY 1""")
def newest_by_key(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.max("ts").alias("ts"))


@query("""SELECT ts::DATE AS day, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'view') AS view, count(*) FILTER (WHERE event_type = 'purchase') AS purchase FROM events GROUP BY 1""")
def pivot_indicators(t: Tables) -> DataFrame:
    p = t.events.groupBy(F.to_date("ts").alias("day")).pivot("event_type", ["click", "view", "purchase"]).count()
    return p.na.fill(0, ["click", "view", "purchase"])


@query("""SELECT lower(trim(lang)) AS lang, count(*) AS n_records FROM documents GROUP BY 1""")
def source_languages(t: Tables) -> DataFrame:
    return t.documents.groupBy(F.lower(F.trim("lang")).alias("lang")).agg(F.count("*").alias("n_records"))


@query("""WITH h AS (SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, page_id FROM pages), g AS (SELECT host, min(page_id) AS first_seen, count(*) AS n_pages FROM h GROUP BY 1) SELECT host, first_seen, n_pages, row_number() OVER (ORDER BY first_seen) AS number FROM g""")
def reference_rows(t: Tables) -> DataFrame:
    """Hosts numbered by first appearance; hosts are few, so one ordered window numbers them."""
    g = t.pages.groupBy(F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("host")).agg(F.min("page_id").alias("first_seen"), F.count("*").alias("n_pages"))
    return g.withColumn("number", F.row_number().over(Window.orderBy("first_seen")))


@query("""SELECT event_type, count(DISTINCT user_id) AS n_runs, count(*) AS n, arg_max(event_id, struct_pack(t := ts, i := event_id)) AS latest, count(DISTINCT user_id) >= 2 AS candidate FROM events GROUP BY 1""")
def finding_classes(t: Tables) -> DataFrame:
    runs = F.count_distinct("user_id")
    return t.events.groupBy("event_type").agg(runs.alias("n_runs"), F.count("*").alias("n"), F.max_by("event_id", F.struct("ts", "event_id")).alias("latest"), (runs >= 2).alias("candidate"))


@query("""WITH RECURSIVE k AS (SELECT doc_id, sha256(text) AS a, source || ':' || n_chars AS b FROM documents),
e AS (SELECT x.doc_id AS u, y.doc_id AS v FROM k x JOIN k y ON (x.a = y.a OR x.b = y.b) AND x.doc_id <> y.doc_id),
r(doc_id, site) AS (SELECT doc_id, doc_id FROM k UNION SELECT e.u, r.site FROM r JOIN e ON e.v = r.doc_id WHERE r.site < e.u)
SELECT doc_id, min(site) AS site FROM r GROUP BY 1""")
def union_find_sites(t: Tables) -> DataFrame:
    """Documents that share a digest or (source, length), transitively; the smallest id names the site."""
    keys = t.documents.select("doc_id", F.explode(F.array(F.sha2(F.col("text").cast("binary"), 256), F.concat_ws(":", "source", "n_chars"))).alias("key"))
    return graph.sites(keys, "doc_id", "key", "site")
