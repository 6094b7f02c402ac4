"""Clusters in the order of records, and overrides that people decided, on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import resolve

from .registry import Tables, query


@query("""WITH RECURSIVE p AS (SELECT p_partkey AS k, p_size AS size, p_brand AS brand FROM part), lo AS (SELECT min(k) AS lo FROM p),
j AS MATERIALIZED (SELECT b.k AS b, a.k AS a, abs(a.size - b.size) <= 9 AS link, a.brand = b.brand OR (a.size + b.size) % 11 = 0 AS veto FROM p b JOIN p a ON a.k BETWEEN b.k - 8 AND b.k - 1),
e AS MATERIALIZED (SELECT p.k AS b, coalesce(list(a) FILTER (WHERE link), []) AS links, coalesce(list(a) FILTER (WHERE veto), []) AS vetoes FROM p LEFT JOIN j ON j.b = p.k GROUP BY 1),
g(n, lo, labels) AS (SELECT lo, lo, []::BIGINT[] FROM lo UNION ALL
  SELECT n + 1, lo, list_append(labels, coalesce(list_min(list_filter(list_transform(links, lambda x: labels[x - lo + 1]), lambda c: NOT list_contains(list_transform(vetoes, lambda x: labels[x - lo + 1]), c))), n)) FROM g JOIN e ON e.b = g.n)
SELECT lo + i - 1 AS seq, labels[i] AS cluster FROM (SELECT lo, labels, unnest(range(1, len(labels) + 1)) AS i FROM (SELECT * FROM g ORDER BY n DESC LIMIT 1))""")
def first_fit_clusters(t: Tables) -> DataFrame:
    """Parts in order: eight neighbours by number are linked if of one size class, and vetoed by brand or size."""
    p = t.part.select("p_partkey", "p_size", "p_brand")
    side = lambda s: p.select(*[F.col(f"p_{c}").alias(f"{s}_{c}") for c in ("partkey", "size", "brand")])
    met = side("b").withColumn("back", F.explode(F.sequence(F.lit(1), F.lit(8)))).withColumn("a_partkey", F.col("b_partkey") - F.col("back")).join(side("a"), "a_partkey")
    link = F.abs(F.col("a_size") - F.col("b_size")) <= 9
    veto = (F.col("a_brand") == F.col("b_brand")) | ((F.col("a_size") + F.col("b_size")) % 11 == 0)
    kinds = F.explode(F.array_compact(F.array(F.when(link, F.lit(False)), F.when(veto, F.lit(True)))))
    edges = met.select(F.col("a_partkey").alias("a"), F.col("b_partkey").alias("b"), kinds.alias("veto"))
    return resolve.first_fit(p.select(F.col("p_partkey").alias("seq")), edges)


_UNSET = "('', 'tbd', 'tbc', '—', '-', 'n/a', 'none', '??')"


@query(f"""WITH r AS (SELECT p_partkey AS seq, 'deck ' || (p_partkey % 200) AS source, p_partkey // 200 AS page, p_type AS city, CASE WHEN p_partkey % 3 <> 0 THEN p_size::VARCHAR END AS area FROM part),
s AS (SELECT s_suppkey AS id, 'deck ' || (s_suppkey % 300) AS source, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey % 4 END AS page, s_suppkey % 5 <> 0 AS multi FROM supplier),
o AS (SELECT *, 'city' AS field, 'X' || id AS value, CASE id % 7 WHEN 0 THEN 'another' END AS expect FROM s UNION ALL SELECT *, 'area', (id * 10)::VARCHAR, CASE id % 4 WHEN 0 THEN 'TBD' WHEN 1 THEN '0' || (SELECT p_size FROM part WHERE p_partkey = id) || '.0' END FROM s WHERE id % 3 <> 2),
h AS (SELECT o.*, r.seq, CASE field WHEN 'city' THEN r.city ELSE r.area END AS held FROM o JOIN r ON o.source = r.source AND (o.page IS NULL OR o.page = r.page)),
n AS (SELECT id, count(DISTINCT seq) AS n, bool_and(expect IS NULL OR coalesce(held = expect, FALSE) OR coalesce(try_cast(held AS DOUBLE) = try_cast(expect AS DOUBLE), FALSE) OR (coalesce(lower(trim(held)) IN {_UNSET}, TRUE) AND lower(trim(expect)) IN {_UNSET})) AS ok, bool_or(multi) AS multi FROM h GROUP BY 1),
w AS (SELECT h.seq, field, arg_max(value, h.id) AS value FROM h JOIN n ON h.id = n.id WHERE ok AND (n = 1 OR n.multi) GROUP BY 1, 2)
SELECT r.seq, coalesce(c.value, city) AS city, coalesce(a.value, area) AS area FROM r LEFT JOIN w c ON c.seq = r.seq AND c.field = 'city' LEFT JOIN w a ON a.seq = r.seq AND a.field = 'area'""")
def overridden_records(t: Tables) -> DataFrame:
    """Parts as records after overrides of one or two fields; an unset field meets an expected placeholder."""
    k, s = F.col("p_partkey"), F.col("s_suppkey")
    records = t.part.select(k.alias("seq"), F.concat(F.lit("deck "), (k % 200).cast("string")).alias("source"), F.floor(k / 200).alias("page"), F.col("p_type").alias("city"), F.when(k % 3 != 0, F.col("p_size").cast("string")).alias("area"))
    said = t.supplier.join(t.part.select(k.alias("s_suppkey"), "p_size"), "s_suppkey", "left")
    heads = said.select(s.alias("id"), F.concat(F.lit("deck "), (s % 300).cast("string")).alias("source"), F.when(s % 2 == 0, s % 4).alias("page"), (s % 5 != 0).alias("multi"), "p_size")
    city = F.struct(F.lit("city").alias("field"), F.concat(F.lit("X"), F.col("id").cast("string")).alias("value"), F.when(F.col("id") % 7 == 0, "another").alias("expect"))
    number = F.concat(F.lit("0"), F.col("p_size").cast("string"), F.lit(".0"))
    area = F.struct(F.lit("area").alias("field"), (F.col("id") * 10).cast("string").alias("value"), F.when(F.col("id") % 4 == 0, "TBD").when(F.col("id") % 4 == 1, number).alias("expect"))
    overrides = heads.select("*", F.explode(F.array_compact(F.array(city, F.when(F.col("id") % 3 != 2, area)))).alias("x")).select("id", "source", "page", "multi", "x.*")
    return resolve.apply_overrides(records, overrides, ["city", "area"])[0].select("seq", "city", "area")


_FIELDS = ["areaUnit", "regionCode", "city", "colour", "size", "city"]


@query("""WITH o AS (SELECT CASE WHEN c_custkey % 13 = 0 THEN '' WHEN c_custkey % 11 = 0 THEN 'twice ' || (c_custkey % 5) ELSE c_custkey::VARCHAR END AS id, CASE WHEN c_custkey % 5 = 0 THEN ' ' ELSE c_name END AS source, CASE WHEN c_custkey % 7 <> 0 THEN 'seen' END AS why,
  ['areaUnit', 'regionCode', 'city', 'colour', 'size', 'city'][(1 + c_custkey % 6)::INT] AS field, CASE WHEN c_custkey % 9 <> 0 THEN 'new' END AS value FROM customer),
h AS (SELECT id, count(*) AS heads FROM (SELECT DISTINCT id, source, why FROM o) GROUP BY 1)
SELECT o.id, field, CASE WHEN o.id = '' THEN 'no id' WHEN heads > 1 THEN 'repeated id' WHEN trim(source) = '' THEN 'no source' WHEN why IS NULL THEN 'no reason given' WHEN field = 'areaUnit' THEN 'unit' WHEN field = 'regionCode' THEN 'derived' WHEN field = 'colour' THEN 'unknown field' WHEN value IS NULL THEN 'no value' END AS reason
FROM o JOIN h USING (id) WHERE reason IS NOT NULL""")
def refused_overrides(t: Tables) -> DataFrame:
    """What overrides may not set: units, derived and unknown fields, and overrides that lack a part."""
    k = F.col("c_custkey")
    number = F.when(k % 13 == 0, "").when(k % 11 == 0, F.concat(F.lit("twice "), (k % 5).cast("string"))).otherwise(k.cast("string"))
    field = F.element_at(F.array(*map(F.lit, _FIELDS)), (1 + k % 6).cast("int"))
    o = t.customer.select(number.alias("id"), F.when(k % 5 == 0, " ").otherwise(F.col("c_name")).alias("source"), F.when(k % 7 != 0, "seen").alias("why"), field.alias("field"), F.when(k % 9 != 0, "new").alias("value"))
    return resolve.refused_overrides(o, ["city", "size"])
