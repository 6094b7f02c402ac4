from pyspark.sql import functions as F

from ledgerloom import catalog
from ledgerloom.operators import evidence, resolve, spatial

N = 200_000


def crowds(spark):
    """Two places with N points each on either side: pairs of points would be 80 billion."""
    return [spark.range(2 * N).select(F.col("id").alias(key), (50 + F.col("id") % 2).cast("double").alias("lat"), F.lit(9.0).alias("lng"), (F.col("id") % 2 * 2).alias("code"), F.lit("air").alias("kind"), F.concat(F.lit("n"), "id").alias("name")) for key in ("id", "seq")]


def test_crowded_places_meet_once(spark):
    left, right = crowds(spark)
    found = spatial.nearest(left, "id", right, "kind", "name", "seq", {"air": 600.0})
    assert {tuple(r) for r in found.select((F.col("id") % 2).alias("half"), "name", "km").distinct().collect()} == {(0, "n0", 0.0), (1, "n1", 0.0)} and found.count() == 2 * N
    assert spatial.anti_within(left, right.where("code = 0"), 60).groupBy("lat").count().collect() == [(51.0, N)]
    near = spatial.semi_within(left, right, 60, F.col("other") != F.col("code"), ["code"], {"other": F.col("code") * F.col("lat") - 50})
    assert near.groupBy("lat").count().orderBy("lat").collect() == [(50.0, N), (51.0, N)]
    assert spatial.semi_within(left, right, 60, F.col("other") != F.col("code"), ["code"], {"other": F.col("code")}).isEmpty()
    assert spatial.within_km(left, right.where("seq < 4"), 60, {"seq": "seq"}).groupBy("seq", "km").count().orderBy("seq").collect() == [(n, 0.0, N) for n in range(4)]


def test_crowded_sources_are_judged_by_sums(spark):
    k = F.col("id")
    records = spark.range(N).select(k.alias("seq"), F.lit("a").alias("source"), (k % 2).alias("page"), F.when(k == 7, "odd").otherwise("1.0").alias("area"))
    o = spark.range(N).select(k, F.lit("a").alias("source"), F.when(k % 2 == 0, k % 4).alias("page"), F.lit("area").alias("field"), k.cast("string").alias("value"), F.when(k % 3 == 0, "01").alias("expect"), (k % 5 != 0).alias("multi"))
    changed, status = resolve.apply_overrides(records, o, ["area"])
    want = o.groupBy(F.when(F.col("page") == 2, "stale").when(~F.col("multi"), "ambiguous").when(F.col("page").isNull() & F.col("expect").isNotNull(), "superseded").otherwise("applied").alias("status")).count()
    assert dict(status.groupBy("status").count().collect()) == dict(want.collect())
    assert {tuple(r) for r in changed.select("page", "area").distinct().collect()} == {(0, "199999"), (1, "199999")}


def test_pages_of_one_override_count_once(spark):
    records = spark.createDataFrame([(1, "a", 0, "x"), (2, "a", 1, "x"), (3, "b", 0, " TBD ")], "seq long, source string, page long, city string")
    o = [("1", "a", 0, "y", None, False), ("1", "a", None, "z", "x", False), ("2", "a", 1, "q", "x", False), ("3", "b", None, "w", "n/a", False), ("4", "b", 0, "v", "w", False)]
    changed, status = resolve.apply_overrides(records, spark.createDataFrame(o, "id string, source string, page long, value string, expect string, multi boolean").withColumn("field", F.lit("city")), ["city"])
    assert dict(status.collect()) == {"1": "ambiguous", "2": "applied", "3": "applied", "4": "superseded"}
    assert {r.seq: r.city for r in changed.collect()} == {1: "x", 2: "q", 3: "w"}


def test_one_hot_id_needs_no_window(spark):
    o = spark.range(4).select(F.when(F.col("id") < 3, "a").alias("id"), F.when(F.col("id") > 0, "s").alias("source"), F.lit("w").alias("why"), F.lit("city").alias("field"), F.lit("v").alias("value"))
    refused = resolve.refused_overrides(o, ["city"])
    assert sorted(r.reason for r in refused.collect()) == ["no id", "repeated id", "repeated id", "repeated id"]
    assert "Window" not in refused._jdf.queryExecution().toString()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_heavy_rows_are_dealt_by_number(spark, tmp_path):
    claims = spark.createDataFrame([(1, 1, 0, 5), (1, 2, 4, 9), (1, 3, 9, 9)], "deck long, claimant long, first long, last long")
    found = evidence.contested_pages(claims)
    assert sorted(tuple(r) for r in found.collect()) == [(1, 4, 5, 2), (1, 9, 9, 2)] and "REPARTITION_BY_NUM" in plan(found)
    assert plan(catalog.queries()["closest_names"](spark, "/root/testdata/sf0.001")).count("REPARTITION_BY_NUM") >= 2


def test_each_quote_is_read_once(spark, tmp_path):
    spark.createDataFrame([(k, s) for k in range(40) for s in (7, None)], "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    rents = catalog.queries()["canonical_rents"](spark, str(tmp_path))
    got = rents.collect()
    assert len(got) == 80 and {r.said for r in got if r.p_partkey % 5 == 3} == {"TBD"} and {r.office for r in got if r.p_partkey % 2 == 0} == {1007.0, None}
    assert "regexp" not in plan(rents).lower()
