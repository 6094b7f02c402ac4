from pyspark.sql import functions as F

from ledgerloom.streaming import feeds

SF = "/root/testdata/sf0.001"


def run(df, name, mode):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_newest_by_key_follows_the_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(str(tmp_path / "feed"))
    feed = feeds.read_feed(spark, str(tmp_path / "feed"), events.schema)
    got = {r.user_id: (r.event_id, r.ts) for r in run(feeds.newest_by_key(feed, "user_id", ["ts", "event_id"], "event_id"), "newest", "complete").collect()}
    want = {r.user_id: (r.e, r.t) for r in events.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("e"), F.max("ts").alias("t")).collect()}
    assert got == want


def test_windows_and_repeats(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.write.parquet(str(tmp_path / "feed"))
    events.limit(50).write.mode("append").parquet(str(tmp_path / "feed"))
    feed = feeds.read_feed(spark, str(tmp_path / "feed"), events.schema)
    counted = run(feeds.windowed_counts(feed, "ts", "event_type", "1 day", "400 days"), "counted", "complete")
    assert counted.agg(F.sum("n")).first()[0] == events.count() + 50
    assert run(feeds.distinct_events(feed, ["event_id"], "ts", "400 days"), "once", "append").count() == events.count()


def test_what_is_left_to_do(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "2")], "path string, digest string")
    assert [r.path for r in feeds.stale(a, a.where("path = 'x'").unionByName(spark.createDataFrame([("y", "old")], a.schema)), "path", "digest").collect()] == ["y"]
    assert [r.path for r in feeds.unanswered(a, a.where("path = 'x'"), "path").collect()] == ["y"]
    f = spark.createDataFrame([("[rent-band] p1.warehouseRent out of band",)], "t string")
    assert f.select(feeds.finding_class(F.col("t"))).first()[0] == "rent-band|warehouseRent"
