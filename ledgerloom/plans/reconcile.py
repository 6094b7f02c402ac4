"""Merging, ledgers and rules on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import ledger, merge

from .registry import Tables, query

RANK = "CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 ELSE 4 END"
FIELDS = ["o_orderstatus", "o_orderpriority"]
_LONG = f"""l AS (
  SELECT o_custkey, 'o_orderstatus' AS field, o_orderstatus AS value, {RANK} AS rank, o_orderdate, o_orderkey FROM orders
  UNION ALL SELECT o_custkey, 'o_orderpriority', o_orderpriority, {RANK}, o_orderdate, o_orderkey FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, field ORDER BY rank, o_orderdate DESC, o_orderkey) AS p FROM l WHERE value IS NOT NULL)"""


def _order() -> list:
    return [F.expr(RANK.replace("o_orderpriority", "_priority")), F.col("o_orderdate").desc(), F.col("o_orderkey")]


def _records(t: Tables) -> DataFrame:
    return t.orders.withColumn("_priority", F.col("o_orderpriority"))


@query(f"WITH {_LONG} SELECT o_custkey, field, arg_min(value, p) AS value, count(*) AS n_records, count(DISTINCT value) - 1 AS n_discarded FROM r GROUP BY 1, 2")
def precedence_merge(t: Tables) -> DataFrame:
    return merge.precedence_merge(_records(t), "o_custkey", FIELDS, _order(), ["_priority", "o_orderdate", "o_orderkey"])


@query(f"""WITH {_LONG}, f AS (SELECT o_custkey, field, value, min(p) AS p FROM r GROUP BY 1, 2, 3),
g AS (SELECT *, count(*) OVER (PARTITION BY o_custkey, field) AS n, row_number() OVER (PARTITION BY o_custkey, field ORDER BY p) AS rk FROM f)
SELECT o_custkey, field, chr((96 + rk)::INT) AS label, value FROM g WHERE n > 1""")
def conflict_candidates(t: Tables) -> DataFrame:
    return merge.conflict_candidates(_records(t), "o_custkey", FIELDS, _order(), ["_priority", "o_orderdate", "o_orderkey"])


@query("""WITH c AS (SELECT l_returnflag AS unit, count(*) AS n, min(l_orderkey * 10 + l_linenumber) AS s FROM lineitem GROUP BY 1)
SELECT unit, n FROM c ORDER BY n DESC, s LIMIT 1""")
def dominant_unit(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.col("l_returnflag").alias("unit"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return merge.mode_first_seen(rows, "unit", "seq")


@query("""WITH c AS (SELECT l_returnflag AS unit, count(*) AS n, min(l_orderkey * 10 + l_linenumber) AS s FROM lineitem GROUP BY 1), d AS (SELECT unit FROM c ORDER BY n DESC, s LIMIT 1)
SELECT count(*) AS n_records, count(DISTINCT l_suppkey) AS n_suppliers, min(l_quantity) AS least_area, max(l_quantity) AS most_area,
  min(l_extendedprice) FILTER (WHERE l_returnflag = (SELECT unit FROM d)) AS least_rent, max(l_extendedprice) FILTER (WHERE l_returnflag = (SELECT unit FROM d)) AS most_rent FROM lineitem""")
def kpi_strip(t: Tables) -> DataFrame:
    """Counts and ranges; rents only in the dominant unit. The mode comes with the ranges by unit, in one pass of sums."""
    by = t.lineitem.groupBy(F.col("l_returnflag").alias("unit")).agg(
        F.count("*").alias("n"), F.min(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.min("l_quantity").alias("a0"), F.max("l_quantity").alias("a1"),
        F.min("l_extendedprice").alias("r0"), F.max("l_extendedprice").alias("r1"),
    )
    top = F.struct("n", -F.col("seq"))
    ranges = by.agg(F.sum("n").alias("n_records"), F.min("a0").alias("least_area"), F.max("a1").alias("most_area"), F.max_by("r0", top).alias("least_rent"), F.max_by("r1", top).alias("most_rent"))
    return ranges.crossJoin(t.lineitem.agg(F.count_distinct("l_suppkey").alias("n_suppliers")))  # one row each


@query("SELECT source, count(*) AS n_records, round(avg(CASE WHEN n_chars < 400 THEN 1.0 ELSE 0.0 END), 6) AS poor_share, avg(CASE WHEN n_chars < 400 THEN 1.0 ELSE 0.0 END) > 0.5 AS unreliable FROM documents GROUP BY 1")
def file_quality(t: Tables) -> DataFrame:
    poor = F.avg(F.when(F.col("n_chars") < 400, 1.0).otherwise(0.0))
    return t.documents.groupBy("source").agg(F.count("*").alias("n_records"), F.round(poor, 6).alias("poor_share"), (poor > 0.5).alias("unreliable"))


@query("SELECT doc_id, sha256(text) AS digest FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def exact_dup_drop(t: Tables) -> DataFrame:
    """The hash and the id travel, not the text; sums by task come before the shuffle."""
    return t.documents.groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("digest")).agg(F.min("doc_id").alias("doc_id"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN c_nationkey + 100 ELSE c_nationkey END AS c_nationkey, CASE WHEN c_custkey % 5 = 0 THEN 'replaced' ELSE 'kept' END AS action FROM customer
UNION ALL SELECT -1 - s_suppkey, s_nationkey, 'added' FROM supplier""")
def ledger_upsert(t: Tables) -> DataFrame:
    old = t.customer.select("c_custkey", "c_nationkey")
    changed = old.where("c_custkey % 5 = 0").withColumn("c_nationkey", F.col("c_nationkey") + 100)
    new = changed.unionByName(t.supplier.select((-1 - F.col("s_suppkey")).alias("c_custkey"), F.col("s_nationkey").alias("c_nationkey")))
    return ledger.upsert(old, new, ["c_custkey"], ["c_nationkey"])


@query("""SELECT p_partkey, p_brand, 'old' AS writer FROM part WHERE p_size > 10 UNION ALL SELECT p_partkey, p_brand, 'new' FROM part WHERE p_size <= 10 AND p_size % 2 = 0""")
def ledger_replace_managed(t: Tables) -> DataFrame:
    rows = t.part.select("p_partkey", "p_brand", "p_size").withColumn("writer", F.lit("old"))
    new = rows.where("p_size <= 10 and p_size % 2 = 0").withColumn("writer", F.lit("new"))
    return ledger.replace_managed(rows, new, F.col("p_size") <= 10).drop("p_size")


@query("""WITH l AS (SELECT doc_id, 'lang' AS field, lang AS value FROM documents UNION ALL SELECT doc_id, 'source', source FROM documents)
SELECT doc_id, field FROM l WHERE value IS NOT NULL AND NOT EXISTS (SELECT 1 FROM labels b WHERE b.doc_id = l.doc_id AND CASE WHEN b.quality = 1 THEN 'lang' ELSE 'source' END = l.field)""")
def trace_anti_join(t: Tables) -> DataFrame:
    traced = t.labels.select("doc_id", F.when(F.col("quality") == 1, "lang").otherwise("source").alias("field"))
    return ledger.untraced(t.documents, traced, "doc_id", ["lang", "source"])


@query("""SELECT d.doc_id, CASE WHEN d.doc_id IN (SELECT doc_id FROM labels) THEN 'labelled' WHEN d.doc_id IN (SELECT doc_id FROM documents WHERE n_chars < 300) THEN 'short' ELSE 'unaccounted' END AS bucket FROM documents d""")
def input_accounting(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", "n_chars")
    return ledger.account(docs.select("doc_id"), "doc_id", [("labelled", t.labels), ("short", docs.where("n_chars < 300"))])


@query("""WITH a AS (SELECT * FROM supplier WHERE s_suppkey % 7 <> 0), b AS (SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 3 = 0 THEN s_nationkey + 1 ELSE s_nationkey END AS s_nationkey FROM supplier WHERE s_suppkey % 11 <> 0)
SELECT coalesce(a.s_suppkey, b.s_suppkey) AS s_suppkey, CASE WHEN a.s_suppkey IS NULL THEN 'ADDED' WHEN b.s_suppkey IS NULL THEN 'REMOVED' ELSE 'CHANGED' END AS change,
 CASE WHEN a.s_suppkey IS NOT NULL AND b.s_suppkey IS NOT NULL THEN 's_nationkey' END AS field, CASE WHEN b.s_suppkey IS NOT NULL THEN a.s_nationkey::VARCHAR END AS old, CASE WHEN a.s_suppkey IS NOT NULL THEN b.s_nationkey::VARCHAR END AS new
FROM a FULL OUTER JOIN b ON a.s_suppkey = b.s_suppkey WHERE a.s_suppkey IS NULL OR b.s_suppkey IS NULL OR a.s_nationkey <> b.s_nationkey""")
def snapshot_diff(t: Tables) -> DataFrame:
    after = t.supplier.where("s_suppkey % 11 <> 0").withColumn("s_nationkey", F.when(F.col("s_suppkey") % 3 == 0, F.col("s_nationkey") + 1).otherwise(F.col("s_nationkey")))
    return ledger.snapshot_diff(t.supplier.where("s_suppkey % 7 <> 0"), after, "s_suppkey", ["s_name", "s_nationkey"])


@query("""WITH f AS (SELECT source, CASE WHEN source IN ('src1', 'src2') THEN NULL ELSE lang END AS lang, CASE WHEN source = 'src3' THEN NULL ELSE n_chars END AS n_chars FROM documents),
c AS (SELECT source, count(*) AS n, count(lang) AS lang, count(n_chars) AS n_chars FROM f GROUP BY 1),
l AS (SELECT source, n, 'lang' AS field, lang AS held FROM c UNION ALL SELECT source, n, 'n_chars', n_chars FROM c)
SELECT field, count(*) FILTER (WHERE held = 0) AS sources_without, count(*) FILTER (WHERE held > 0) AS sources_with, (sum(n) FILTER (WHERE held = 0))::BIGINT AS affected, sum(held)::BIGINT AS present,
 (field = 'lang' OR (sum(n) FILTER (WHERE held = 0) >= 5 AND sum(held) >= 3)) AS signal, least(sum(n) FILTER (WHERE held = 0), sum(held))::BIGINT AS weight
FROM l GROUP BY 1 HAVING count(*) FILTER (WHERE held = 0) > 0 AND count(*) FILTER (WHERE held > 0) > 0""")
def capture_symmetry(t: Tables) -> DataFrame:
    docs = t.documents.select("source", F.when(~F.col("source").isin("src1", "src2"), F.col("lang")).alias("lang"), F.when(F.col("source") != "src3", F.col("n_chars")).alias("n_chars"))
    return ledger.capture_symmetry(docs, "source", ["lang", "n_chars"], ["lang"])


@query("""SELECT o_orderkey, rule, severity FROM (
  SELECT o_orderkey, 'price-high' AS rule, 'warn' AS severity FROM orders WHERE o_totalprice > 300000
  UNION ALL SELECT o_orderkey, 'urgent-open', 'block' FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'O')""")
def rule_violations(t: Tables) -> DataFrame:
    return ledger.violations(t.orders, "o_orderkey", [("price-high", "warn", F.col("o_totalprice") > 300000), ("urgent-open", "block", (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "O"))])


@query("SELECT c_custkey, side FROM (SELECT c_custkey, 'left' AS side FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT DISTINCT o_custkey, 'right' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer))")
def id_mismatch(t: Tables) -> DataFrame:
    return ledger.id_mismatch(t.customer, t.orders.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey")


@query("SELECT p_name, (SELECT count(*) FROM part WHERE p_size > 40) AS n_total, greatest((SELECT count(*) FROM part WHERE p_size > 40) - 20, 0) AS n_cut FROM (SELECT p_name, p_partkey FROM part WHERE p_size > 40 ORDER BY p_partkey LIMIT 20)")
def capped_diff(t: Tables) -> DataFrame:
    return ledger.capped(t.part.where("p_size > 40"), [F.col("p_partkey")], 20, "p_name")


@query("""SELECT source, lang, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id) AS n FROM documents) WHERE n = 1""")
def longest_by_key(t: Tables) -> DataFrame:
    return merge.keep_first(t.documents.drop("text"), ["source", "lang"], [F.col("n_chars").desc(), F.col("doc_id")]).select("source", "lang", "doc_id")


@query("""SELECT event_type || '-' || user_id AS base, event_id, CASE WHEN n = 1 THEN event_type || '-' || user_id ELSE event_type || '-' || user_id || '-' || n END AS claim_id
FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS n FROM events)""")
def id_suffix(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", F.concat_ws("-", "event_type", "user_id").alias("base"))
    return merge.with_suffixes(rows, "base", "event_id", "claim_id")


@query("""WITH f AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS family FROM orders),
w AS (SELECT *, max(CASE WHEN family = '1-URGENT' THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey) AS v, count(family) OVER (PARTITION BY o_custkey) AS c FROM f)
SELECT o_custkey, o_orderkey FROM w WHERE v = 1 OR c = 0""")
def source_authority(t: Tables) -> DataFrame:
    rows = t.orders.select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).alias("family"))
    return merge.authority(rows, "o_custkey", "family", "1-URGENT").drop("family")


@query("""WITH r AS (SELECT event_type AS claim, user_id AS item, event_id, 1 + event_id % 6 AS tier FROM events WHERE event_id % 10 <> 3),
k AS (SELECT *, row_number() OVER (PARTITION BY claim, item ORDER BY tier, event_id) AS n FROM r) SELECT claim, item, event_id, tier FROM k WHERE n = 1""")
def claim_merge(t: Tables) -> DataFrame:
    """Claims without a source fall out; of one claim the best tier stays, the first of several."""
    rows = t.events.where("event_id % 10 <> 3").select(F.col("event_type").alias("claim"), F.col("user_id").alias("item"), "event_id", (1 + F.col("event_id") % 6).alias("tier"))
    return merge.keep_first(rows, ["claim", "item"], [F.col("tier"), F.col("event_id")])


@query("""WITH g AS (SELECT l_orderkey, sum(l_quantity) AS warehouse, sum(CASE WHEN l_linenumber % 2 = 0 THEN l_quantity ELSE 0 END) AS office FROM lineitem GROUP BY 1),
s AS (SELECT *, warehouse + office AS gla, warehouse AS stated FROM g)
SELECT l_orderkey, gla, stated, CASE WHEN office <= 0 THEN 'skip' WHEN gla - stated > greatest(50, 0.005 * stated) THEN 'block' WHEN stated - gla > greatest(50, 0.005 * stated) THEN 'note' ELSE 'ok' END AS verdict FROM s""")
def arithmetic_gate(t: Tables) -> DataFrame:
    g = t.lineitem.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("stated"), F.sum(F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity")).otherwise(0)).alias("office"))
    g = g.withColumn("gla", F.col("stated") + F.col("office"))
    most = F.greatest(F.lit(50.0), 0.005 * F.col("stated"))
    verdict = F.when(F.col("office") <= 0, "skip").when(F.col("gla") - F.col("stated") > most, "block").when(F.col("stated") - F.col("gla") > most, "note").otherwise("ok")
    return g.select("l_orderkey", "gla", "stated", verdict.alias("verdict"))
