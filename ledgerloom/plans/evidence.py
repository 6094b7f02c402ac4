"""Frozen tables, remembered figures, implied rows and reach over pages, on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import evidence
from ledgerloom.session import materialize

from .registry import Tables, query


def _row_sql(columns: list[str]) -> str:
    return " || ',' || ".join(f"coalesce(length({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in columns)


_PRINT = "count(*) AS n, coalesce(sum(('0x' || substr(h, 1, 15))::HUGEINT), 0)::VARCHAR AS low, coalesce(sum(('0x' || substr(h, 16, 15))::HUGEINT), 0)::VARCHAR AS high"


@query(f"""SELECT l_returnflag, {_PRINT} FROM (SELECT l_returnflag, md5({_row_sql(["l_orderkey", "l_linenumber", "l_returnflag", "l_suppkey"])}) AS h FROM lineitem) GROUP BY 1""")
def table_fingerprint(t: Tables) -> DataFrame:
    """Fingerprints by return flag, made by month and merged: the sums don't depend on how rows are dealt."""
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag", "l_suppkey")
    by_line = evidence.fingerprint(rows, ["l_returnflag", "l_linenumber"])
    return evidence.merge_fingerprints(by_line, ["l_returnflag"])


_AFTER = """a AS (SELECT user_id, event_id, event_type FROM events WHERE user_id % 7 <> 0 OR event_id % 3 <> 0
  UNION ALL SELECT user_id, event_id, event_type FROM events WHERE user_id % 11 = 0 AND event_id % 5 = 0
  UNION ALL SELECT -user_id - 1, event_id, event_type FROM events WHERE user_id % 13 = 0)"""


@query(f"""WITH {_AFTER}, l AS (SELECT user_id, string_agg(event_id || event_type, ',' ORDER BY event_id, event_type) AS was FROM events GROUP BY 1), r AS (SELECT user_id, string_agg(event_id || event_type, ',' ORDER BY event_id, event_type) AS now FROM a GROUP BY 1)
SELECT user_id, CASE WHEN now IS NULL THEN 'missing' WHEN was IS NULL THEN 'new' WHEN was = now THEN 'same' ELSE 'changed' END AS state FROM l FULL JOIN r USING (user_id)""")
def freeze_check(t: Tables) -> DataFrame:
    """Users whose events changed since they were frozen: rows dropped, doubled or added."""
    rows = t.events.select("user_id", "event_id", "event_type")
    u, e = F.col("user_id"), F.col("event_id")
    now = rows.where((u % 7 != 0) | (e % 3 != 0)).unionByName(rows.where((u % 11 == 0) & (e % 5 == 0))).unionByName(rows.where(u % 13 == 0).withColumn("user_id", -u - 1))
    return evidence.frozen_state(evidence.fingerprint(rows, ["user_id"]), evidence.fingerprint(now.repartition(7), ["user_id"]), ["user_id"])


@query(r"""WITH f AS (SELECT doc_id, list_transform(regexp_extract_all(text, '\d[\d,. ]*'), lambda x: regexp_replace(regexp_replace(x, '[, ]', '', 'g'), '\.+$', '')) AS f FROM documents)
SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(list_filter(f, lambda x: regexp_full_match(x, '\d{4,18}')), lambda x: x::BIGINT), lambda x: x >= 1000))), ',') AS figures FROM f""")
def page_area_figures(t: Tables) -> DataFrame:
    """The figures of all documents, of which a first run has read a half: equal texts are read once, known ones not at all."""
    docs = t.documents.select("doc_id", "text")
    nothing = t.spark.createDataFrame([], "digest string, value array<bigint>")
    _, first = evidence.remembered(docs.where("doc_id % 2 = 0"), "text", nothing, evidence.schedule_figures, "figures")
    rows, _ = evidence.remembered(docs, "text", materialize(first, "figures"), evidence.schedule_figures, "figures")
    return rows.select("doc_id", F.array_join(F.col("figures").cast("array<string>"), ",").alias("figures"))


_IMPLIED = """v AS (SELECT c_custkey AS id, f AS field, CASE f WHEN 'a' THEN 'city ' || c_nationkey WHEN 'b' THEN c_mktsegment END AS value FROM customer, (VALUES ('a'), ('b')) t(f)),
b AS (SELECT c_custkey AS id, 'a' AS field, 'baked ' || c_custkey AS original FROM customer WHERE c_custkey % 4 = 0),
r AS (SELECT c_custkey AS id, 'b' AS field, 'was ' || c_custkey AS original, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE 'old' END AS translated FROM customer WHERE c_custkey % 2 = 0),
c AS (SELECT 'city ' || n_nationkey AS translated, min('ville ' || n_regionkey || k) AS source FROM nation, (VALUES ('x'), ('y')) t(k) WHERE n_nationkey % 3 <> 0 GROUP BY 1),
i AS (SELECT v.id, v.field, CASE WHEN b.id IS NOT NULL THEN b.original WHEN r.translated = value THEN r.original ELSE c.source END AS original, value AS translated, b.id IS NULL AND r.translated IS DISTINCT FROM value AS reconstructed
  FROM v LEFT JOIN b USING (id, field) LEFT JOIN r USING (id, field) LEFT JOIN c ON c.translated = value WHERE b.id IS NOT NULL OR r.translated = value OR c.source IS NOT NULL)"""


def _translated(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    k = F.col("c_custkey")
    fields = F.array(F.struct(F.lit("a").alias("field"), F.concat(F.lit("city "), F.col("c_nationkey").cast("string")).alias("value")), F.struct(F.lit("b").alias("field"), F.col("c_mktsegment").alias("value")))
    values = t.customer.select(k.alias("property_id"), F.explode(fields).alias("x")).select("property_id", "x.*")
    baked = t.customer.where("c_custkey % 4 = 0").select(k.alias("property_id"), F.lit("a").alias("field"), F.concat(F.lit("baked "), k.cast("string")).alias("original"), F.concat(F.lit("city "), F.col("c_nationkey").cast("string")).alias("translated"))
    recorded = t.customer.where("c_custkey % 2 = 0").select(k.alias("property_id"), F.lit("b").alias("field"), F.concat(F.lit("was "), k.cast("string")).alias("original"), F.when(k % 3 == 0, F.col("c_mktsegment")).otherwise("old").alias("translated"))
    cache = t.nation.where("n_nationkey % 3 <> 0").select(F.explode(F.array(F.lit("x"), F.lit("y"))).alias("k"), "n_nationkey", "n_regionkey").select(F.concat(F.lit("ville "), F.col("n_regionkey").cast("string"), F.col("k")).alias("source"), F.concat(F.lit("city "), F.col("n_nationkey").cast("string")).alias("translated"))
    return values, baked, recorded, cache


@query(f"WITH {_IMPLIED} SELECT id AS property_id, field, original, translated, reconstructed FROM i")
def implied_rows(t: Tables) -> DataFrame:
    """Audit rows of translated values: baked in this pass, recorded before, or read back from the cache."""
    return evidence.implied_rows(*_translated(t))


@query(f"""WITH {_IMPLIED}, h AS (SELECT id, field, CASE WHEN id % 5 = 0 THEN 'stale' ELSE original END AS original, translated, reconstructed FROM i WHERE id % 9 <> 0 UNION ALL SELECT c_custkey, 'gone', 'x', 'y', FALSE FROM customer WHERE c_custkey % 10 = 0)
SELECT 'keep' AS change, id AS property_id, field, original FROM (SELECT * FROM h INTERSECT SELECT * FROM i) UNION ALL SELECT 'add', id, field, original FROM (SELECT * FROM i EXCEPT SELECT * FROM h) UNION ALL SELECT 'retract', id, field, original FROM (SELECT * FROM h EXCEPT SELECT * FROM i)""")
def implied_row_changes(t: Tables) -> DataFrame:
    """A ledger of an earlier pass against the rows implied now, as rows to add, to retract and to keep."""
    now = evidence.implied_rows(*_translated(t))
    k = F.col("property_id")
    held = now.where(k % 9 != 0).withColumn("original", F.when(k % 5 == 0, "stale").otherwise(F.col("original")))
    gone = t.customer.where("c_custkey % 10 = 0").select(F.col("c_custkey").alias("property_id"), F.lit("gone").alias("field"), F.lit("x").alias("original"), F.lit("y").alias("translated"), F.lit(False).alias("reconstructed"))
    return evidence.row_changes(held.unionByName(gone), now, ["property_id", "field"]).select("change", "property_id", "field", "original")


_DECKS = """p AS (SELECT DISTINCT l_suppkey % 400 AS deck, l_orderkey % 12 AS page, l_partkey AS figure FROM lineitem),
t AS (SELECT DISTINCT ps AS deck, c AS claimant FROM (SELECT s_suppkey % 400 AS ps, s_suppkey AS c FROM supplier UNION ALL SELECT (s_suppkey * 7) % 400, s_suppkey FROM supplier WHERE s_suppkey % 3 = 0)),
s AS (SELECT DISTINCT l_suppkey % 400 AS deck, l_orderkey % 12 AS page FROM lineitem WHERE l_linenumber = 1 AND l_quantity > 25),
f AS (SELECT DISTINCT l_suppkey AS claimant, l_partkey AS figure FROM lineitem WHERE l_suppkey % 5 <> 0 AND l_linenumber < 3)"""


@query(f"""WITH {_DECKS}, n AS (SELECT deck, count(*) AS owners FROM t GROUP BY 1), g AS (SELECT DISTINCT deck, page FROM p EXCEPT SELECT deck, page FROM s),
x AS (SELECT t.deck, t.claimant, f.figure FROM t JOIN f USING (claimant)), d AS (SELECT * FROM x a WHERE NOT EXISTS (SELECT 1 FROM x b WHERE b.deck = a.deck AND b.figure = a.figure AND b.claimant <> a.claimant)),
m AS (SELECT deck FROM d JOIN n USING (deck) WHERE owners > 1 GROUP BY 1 HAVING count(DISTINCT claimant) > 1),
h AS (SELECT DISTINCT d.claimant, p.deck, p.page FROM d JOIN p USING (deck, figure) JOIN m USING (deck) JOIN g ON g.deck = p.deck AND g.page = p.page)
SELECT claimant, deck, page, 'alone' AS reason FROM t JOIN n USING (deck) JOIN g USING (deck) WHERE owners = 1 AND claimant NOT IN (SELECT claimant FROM f)
UNION ALL SELECT DISTINCT x.claimant, x.deck, page, 'own figure' FROM x JOIN n USING (deck) JOIN p USING (deck, figure) JOIN g USING (deck, page) WHERE owners = 1
UNION ALL SELECT min(claimant), deck, page, 'only figure' FROM h GROUP BY deck, page HAVING count(*) = 1""")
def reach_pages(t: Tables) -> DataFrame:
    """Unclaimed pages of decks by the claimant that alone can have them: suppliers claim decks, parts are figures."""
    deck, page, s = (F.col("l_suppkey") % 400).alias("deck"), (F.col("l_orderkey") % 12).alias("page"), F.col("s_suppkey")
    pages = t.lineitem.select(deck, page, F.col("l_partkey").alias("figure")).groupBy("deck", "page").agg(F.collect_set("figure").alias("figures"))
    touched = t.supplier.select(s.alias("claimant"), (s % 400).alias("deck")).unionByName(t.supplier.where("s_suppkey % 3 = 0").select(s.alias("claimant"), ((s * 7) % 400).alias("deck")))
    spoken = t.lineitem.where("l_linenumber = 1 and l_quantity > 25").select(deck, page)
    figures = t.lineitem.where("l_suppkey % 5 <> 0 and l_linenumber < 3").select(F.col("l_suppkey").alias("claimant"), F.col("l_partkey").alias("figure"))
    return evidence.reach_pages(touched, spoken, figures, pages)


@query("""WITH c AS (SELECT l_suppkey AS deck, l_partkey AS claimant, l_orderkey % 200 AS first, l_orderkey % 200 + l_linenumber AS last FROM lineitem),
p AS (SELECT deck, page, count(DISTINCT claimant) AS n FROM (SELECT deck, claimant, unnest(range(first, last + 1)) AS page FROM c) GROUP BY 1, 2), q AS (SELECT *, page - row_number() OVER (PARTITION BY deck ORDER BY page) AS run FROM p WHERE n > 1)
SELECT deck, min(page) AS first, max(page) AS last, max(n) AS claimants FROM q GROUP BY deck, run""")
def contested_pages(t: Tables) -> DataFrame:
    """Stretches of pages that several claimants' ranges cover, by a sweep; the SQL counts page by page."""
    first = F.col("l_orderkey") % 200
    return evidence.contested_pages(t.lineitem.select(F.col("l_suppkey").alias("deck"), F.col("l_partkey").alias("claimant"), first.alias("first"), (first + F.col("l_linenumber")).alias("last")))
