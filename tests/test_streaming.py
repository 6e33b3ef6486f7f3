"""Streaming results equal the batch results; replays change nothing."""

import datetime as dt

from pyspark.sql import functions as F

from tickvault.operators import series
from tickvault.session import scratch_path
from tickvault.streaming import streams

SF = "/root/testdata/sf0.001"


def test_stream_latest_equals_batch(spark):
    from tickvault.sources import driver
    base = scratch_path(spark, "t-stream-latest")
    rows = driver.series(spark, SF).select(*streams.SERIES_ROW.fieldNames())
    rows.repartition(3).write.parquet(f"{base}/in")
    q = streams.stream_latest_price(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt",
                                      max_files_per_trigger=1)
    q.awaitTermination()
    got = streams.current_latest(spark, f"{base}/out").select(
        "instrumentId", "dataSourceId", "seriesId", "close")
    want = series.latest_price(rows, columns=("seriesId", "close"))
    assert sorted(got.collect()) == sorted(want.collect())
    batches = spark.read.parquet(f"{base}/out").select("batch_id").distinct().count()
    assert batches >= 2
    # restarting on the same checkpoint finds nothing new and writes nothing
    q2 = streams.stream_latest_price(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt")
    q2.awaitTermination()
    assert spark.read.parquet(f"{base}/out").select("batch_id").distinct().count() == batches


def test_batch_rewrite_is_idempotent(spark):
    base = scratch_path(spark, "t-replay")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    streams._write_batch(df, base, 0)
    streams._write_batch(df, base, 0)
    streams._write_batch(df.limit(1), base, 1)
    out = spark.read.parquet(base)
    assert out.count() == 3 and out.filter("batch_id = 0").count() == 2


def test_stream_ingest_writes_valid_rejects_and_lineage(spark):
    base = scratch_path(spark, "t-stream-ingest")
    recs = spark.createDataFrame(
        [("I1", "S1", "2024-01-01T00:00:00+01:00", {"close": 1.0}, 1),
         (None, "S1", "2024-01-01T00:00:00", {"close": 1.0}, 2),
         ("I1", "S1", "nope", {"close": 2.0}, 3)],
        "instrumentId string, dataSourceId string, dataTimestamp string, "
        "indicators map<string,double>, event_id long")
    recs.coalesce(1).write.json(f"{base}/in")
    q = streams.stream_ingest_series(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt",
                                       batch_ts="2024-02-01 00:00:00", key_cols=["event_id"])
    q.awaitTermination()
    valid = {r.event_id: r for r in spark.read.parquet(f"{base}/out/valid").collect()}
    assert valid[1].dataTimestamp == dt.datetime(2023, 12, 31, 23, 0)
    assert valid[3].ts_defaulted and valid[3].dataTimestamp == dt.datetime(2024, 2, 1)
    assert spark.read.parquet(f"{base}/out/rejects").count() == 1
    lin = spark.read.parquet(f"{base}/out/lineage")
    assert lin.count() == 2 and lin.select(F.countDistinct("rawDataHash")).first()[0] == 2


def test_compacted_latest_equals_batch(spark):
    from tickvault.sources import driver
    base = scratch_path(spark, "t-stream-compact")
    rows = driver.series(spark, SF).select(*streams.SERIES_ROW.fieldNames())
    first, second = rows.filter("dataTimestamp < '2024-01-15'"), rows.filter("dataTimestamp >= '2024-01-15'")
    first.repartition(2).write.parquet(f"{base}/in")
    streams.stream_latest_price(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt",
                                max_files_per_trigger=1).awaitTermination()
    snap = streams.compact_latest(spark, f"{base}/out", f"{base}/snap1")
    second.repartition(2).write.mode("append").parquet(f"{base}/in")
    streams.stream_latest_price(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt",
                                max_files_per_trigger=1).awaitTermination()
    got = streams.current_latest(spark, f"{base}/out", snap).select(
        "instrumentId", "dataSourceId", "seriesId", "close")
    want = series.latest_price(rows, columns=("seriesId", "close"))
    assert sorted(got.collect()) == sorted(want.collect())
