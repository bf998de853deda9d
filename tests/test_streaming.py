from datetime import datetime, timedelta


from strataforge.streaming import ingest

SCHEMA = "branch string, hash string, size bigint, recorded_at timestamp"
T0 = datetime(2024, 1, 1)


def test_new_blocks_reach_the_store_once(spark, tmp_path):
    source, store = str(tmp_path / "in"), str(tmp_path / "store")

    def deliver(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        schema = spark.read.parquet(source).schema
        q = ingest.new_blocks(ingest.read(spark, source, schema)).writeStream.foreachBatch(ingest.append_missing(store, ["hash"])).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()

    deliver([("b", "H1", 1, T0), ("b", " h1", 1, T0), ("b", None, 1, T0), ("c", "h2", 1, T0)])
    deliver([("b", "h1", 1, T0 + timedelta(days=3)), ("c", "h3", 1, T0 + timedelta(days=3))])
    assert sorted(r["hash"] for r in spark.read.parquet(store).collect()) == ["h1", "h2", "h3"]


def test_counts_per_window(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = [("b", "h", 5, T0 + timedelta(hours=h)) for h in (0, 1, 30)] + [("c", "h", 7, T0), ("z", "h", 1, T0 + timedelta(days=9))]
    spark.createDataFrame(rows, SCHEMA).write.parquet(source)
    q = ingest.counts(ingest.read(spark, source, spark.read.parquet(source).schema)).writeStream.format("memory").queryName("counted").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r["from_time"], r["branch"], r["n_refs"], r["n_bytes"]) for r in spark.table("counted").collect())
    assert got == [(T0, "b", 2, 10), (T0, "c", 1, 7), (T0 + timedelta(days=1), "b", 1, 5)]
