"""Places: points are made from keys, as the driver tables have none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.geo import CAPS, haversine_km
from ledgerloom.operators import selection, spatial

from .registry import Tables, query

KINDS = list(CAPS)
_P = "p AS (SELECT c_custkey AS id, c_name AS name, 40 + (c_custkey * 37 % 1500) / 100.0 AS lat, -5 + (c_custkey * 91 % 3000) / 100.0 AS lng, c_nationkey FROM customer)"
_Q = "q AS (SELECT s_suppkey AS seq, s_name AS poi, ['air', 'port', 'rail', 'border', 'city'][(1 + s_suppkey % 5)::INT] AS kind, 40 + (s_suppkey * 53 % 1500) / 100.0 AS lat, -5 + (s_suppkey * 71 % 3000) / 100.0 AS lng FROM supplier)"
_KM = "2 * 6371.0 * asin(least(1.0, sqrt(pow(sin((radians(q.lat) - radians(p.lat)) / 2), 2) + cos(radians(p.lat)) * cos(radians(q.lat)) * pow(sin((radians(q.lng) - radians(p.lng)) / 2), 2))))"


def _points(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    return t.customer.select(k.alias("id"), F.col("c_name").alias("name"), (40 + k * 37 % 1500 / 100.0).alias("lat"), (-5 + k * 91 % 3000 / 100.0).alias("lng"), "c_nationkey")


def _pois(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    return t.supplier.select(k.alias("seq"), F.col("s_name").alias("poi"), F.element_at(F.array(*map(F.lit, KINDS)), (1 + k % 5).cast("int")).alias("kind"), (40 + k * 53 % 1500 / 100.0).alias("lat"), (-5 + k * 71 % 3000 / 100.0).alias("lng"))


@query(f"WITH {_P}, {_Q} SELECT p.id, q.seq, round({_KM}, 4) AS km FROM p JOIN q ON {_KM} <= 40")
def radius_join(t: Tables) -> DataFrame:
    return spatial.within_km(_points(t), _pois(t), 40, {"seq": "seq"}).select("id", "seq", F.round("km", 4).alias("km"))


@query(f"""WITH {_P}, {_Q}, j AS (SELECT p.id, q.kind, q.poi, q.seq, {_KM} AS km, CASE q.kind WHEN 'air' THEN 600 WHEN 'port' THEN 800 WHEN 'rail' THEN 300 WHEN 'border' THEN 400 ELSE 300 END AS cap FROM p, q)
SELECT id, kind, poi, round(km, 1) AS km FROM (SELECT *, row_number() OVER (PARTITION BY id, kind ORDER BY km, seq) AS n FROM j WHERE km <= cap) WHERE n = 1""")
def nearest_poi(t: Tables) -> DataFrame:
    return spatial.nearest(_points(t), "id", _pois(t), "kind", "poi", "seq", CAPS)


@query(f"WITH {_P}, {_Q} SELECT id, name FROM p WHERE NOT EXISTS (SELECT 1 FROM q WHERE {_KM} <= 60)")
def far_from_all(t: Tables) -> DataFrame:
    return spatial.anti_within(_points(t), _pois(t), 60).select("id", "name")


@query(f"WITH {_P}, {_Q} SELECT id FROM p WHERE EXISTS (SELECT 1 FROM q WHERE {_KM} <= 60 AND q.seq % 25 <> p.c_nationkey)")
def near_foreign_city(t: Tables) -> DataFrame:
    return spatial.semi_within(_points(t), _pois(t), 60, F.col("code") != F.col("c_nationkey"), ["c_nationkey"], {"code": F.col("seq") % 25}).select("id")


@query(f"""WITH {_P}, g AS (SELECT c_nationkey AS kind, round_even(lat / (50 / 111.0), 0) AS a, round_even(lng / (50 / 111.0), 0) AS b, name, lat, lng, id FROM p),
n AS (SELECT *, row_number() OVER (PARTITION BY kind, a, b ORDER BY length(name) DESC, id) AS n, count(*) OVER (PARTITION BY kind, a, b) AS n_points FROM g)
SELECT kind, name, round(lat, 6) AS lat, round(lng, 6) AS lng, id, n_points FROM n WHERE n = 1""")
def grid_dedup(t: Tables) -> DataFrame:
    out = spatial.grid_dedup(_points(t).withColumnRenamed("c_nationkey", "kind"), "kind", "name", "id", 50)
    return out.withColumns({"lat": F.round("lat", 6), "lng": F.round("lng", 6)})


_RINGS = [("north", [(-5, 48), (10, 56), (26, 48), (10, 50)]), ("west", [(-6, 39), (-6, 50), (8, 50), (8, 39)]), ("east", [(8.005, 39), (8.005, 47.5), (30, 47.5), (30, 39)])]


def _in_sql(ring: list[tuple[float, float]]) -> str:
    edges = zip(ring, ring[1:] + ring[:1])
    return " + ".join(f"(CASE WHEN ({a[1]} > lat) <> ({b[1]} > lat) AND lng < ({b[0]} - {a[0]}) * (lat - {a[1]}) / ({b[1]} - {a[1]})::DOUBLE + {a[0]} THEN 1 ELSE 0 END)" for a, b in edges if a[1] != b[1])


@query(f"WITH {_P} SELECT id, CASE " + " ".join(f"WHEN ({_in_sql(r)}) % 2 = 1 THEN '{c}'" for c, r in _RINGS) + f" END AS code FROM p WHERE ({') % 2 = 1 OR ('.join(_in_sql(r) for _, r in _RINGS)}) % 2 = 1")
def pip_region(t: Tables) -> DataFrame:
    areas = t.spark.createDataFrame([(n, c, [{"x": float(x), "y": float(y)} for x, y in r]) for n, (c, r) in enumerate(_RINGS)], "ord int, code string, ring array<struct<x:double,y:double>>")
    return spatial.locate(_points(t), "id", areas, "code", "ord")


@query("""SELECT substring(p_brand, 1, 7) AS prefix, sum(p_size)::BIGINT AS p_size, round(sum(p_retailprice * p_size) / sum(p_size), 6) AS p_retailprice, count(*) AS n_areas FROM part GROUP BY 1""")
def prefix_rollup(t: Tables) -> DataFrame:
    return spatial.roll_up(t.part, F.substring("p_brand", 1, 7), ["p_size"], "p_retailprice", "p_size")


@query("""WITH g AS (SELECT n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'XA' ELSE 'XB' END AS cc, n_nationkey::DOUBLE AS lat, n_regionkey::DOUBLE AS lng FROM nation UNION ALL SELECT n_name, 'XC', (0 - n_nationkey)::DOUBLE, 0 FROM nation WHERE n_nationkey < 5),
p AS (SELECT c_custkey, n_name AS city, CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'XA' ELSE 'XC' END AS country FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT p.*, g.lat, g.lng FROM p LEFT JOIN (SELECT *, count(*) OVER (PARTITION BY name) AS s FROM g) g ON p.city = g.name AND (p.country = g.cc OR (p.country IS NULL AND g.s = 1))""")
def gazetteer_lookup(t: Tables) -> DataFrame:
    n = t.nation
    g = n.select(F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 2 == 0, "XA").otherwise("XB").alias("cc"), F.col("n_nationkey").cast("double").alias("lat"), F.col("n_regionkey").cast("double").alias("lng"))
    g = g.unionByName(n.where("n_nationkey < 5").select(F.col("n_name").alias("name"), F.lit("XC").alias("cc"), (0 - F.col("n_nationkey")).cast("double").alias("lat"), F.lit(0.0).alias("lng")))
    k = F.col("c_custkey") % 3
    places = t.customer.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("city"), F.when(k == 1, "XA").when(k == 2, "XC").alias("country"))
    return spatial.gazetteer_lookup(places, "city", "country", g)


@query(f"""WITH {_P}, m AS (SELECT median(lat) AS lat, median(lng) AS lng FROM p), k AS (SELECT p.id, {_KM.replace('q.', 'm.')} AS km FROM p, m) SELECT id, round(km, 4) AS km FROM k WHERE km > 900""")
def outlier_recheck(t: Tables) -> DataFrame:
    p = _points(t)
    lat, lng = (F.lit(m).cast("double") for m in selection.medians(p, ["lat", "lng"]))
    return p.withColumn("km", haversine_km(F.col("lat"), F.col("lng"), lat, lng)).where("km > 900").select("id", F.round("km", 4).alias("km"))
