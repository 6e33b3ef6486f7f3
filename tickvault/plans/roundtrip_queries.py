"""Registered queries that go through files: CSV scan (O01), append (O07),
export (O15), and the two streams (O08, O40).

Each writes its input (derived from the driver tables by Spark) under a
fresh folder inside the shared checkpoint folder, runs the operator, and
returns the re-read result. The oracles are the batch answers.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickvault.operators import ingest as ops
from tickvault.operators import series as series_ops
from tickvault.plans import ingest_queries as iq
from tickvault.plans import series_queries as sq  # noqa: F401  (oracle shared below)
from tickvault.plans.oracle import with_tables
from tickvault.plans.registry import ORACLES, query
from tickvault.plans.temporal_queries import VERSIONS_SQL, versions
from tickvault.session import scratch_path
from tickvault.sources import driver, vendor
from tickvault.streaming import streams

# ---------------------------------------------------------------- O01 --------

VENDOR_FEED_MAP = (("open", "open"), ("close", "close"), ("volume", "volume"),
                   ("adj. close", "close"))


def _write_vendor_files(spark, sf_dir, base):
    """The CSV files of each (vendor, instrument), header and all: 'VENDOR-<n>.csv' files are
    mapped to symbols, 'OTHER-<n>.csv' files are not. They are stored in bundles, each record
    after its file's name, as one stored file per name would cost more than its few rows."""
    ev = driver.read_table(spark, sf_dir, "events")
    rows = iq._vendor_rows(spark, sf_dir)
    named = rows.join(ev.select("event_id", "user_id", "event_type"), "event_id")
    fname = F.concat(F.when(F.col("event_type") == "view", "OTHER-").otherwise("VENDOR-"),
                     F.col("user_id").cast("string"), F.lit(".csv"))
    records = named.select(fname.alias("file"), F.col("event_id").cast("string").alias("Seq"), "Date", "Open",
                           "Close", "Volume", F.col("` Adj. Close `"))
    headers = records.select("file").distinct().select("file", *[F.lit(c).alias(c) for c in records.columns[1:]])
    headers.unionByName(records).write.csv(base)


@query("scan_vendor_csv", with_tables("instruments") + """
, v AS (
  SELECT event_id, user_id, event_type,
         CASE WHEN event_id % 23 = 0 THEN NULL ELSE date_trunc('day', ts) END AS d,
         CASE WHEN event_id % 3 = 0 THEN round(value + 1, 4)
              WHEN event_id % 7 = 0 THEN NULL ELSE value END AS close,
         CASE WHEN event_id % 2 = 0 THEN round(value - 0.5, 4) END AS open,
         CAST(json_extract(props, '$.k') AS DOUBLE) AS volume
  FROM events)
SELECT i.symbol, i.instrumentId, 'VENDOR-' || CAST(user_id AS VARCHAR) || '.csv' AS file_name,
       CAST(event_id AS VARCHAR) AS Seq, d AS dataTimestamp, coalesce(open, close) AS open,
       close AS high, close AS low, close, volume
FROM v JOIN instruments i ON i.instrumentId = 'INST_' || CAST(v.user_id AS VARCHAR)
WHERE d IS NOT NULL AND close IS NOT NULL AND event_type <> 'view' AND i.isActive""")
def q_scan_vendor_csv(spark, sf_dir):
    base = scratch_path(spark, "vendor-csv")
    _write_vendor_files(spark, sf_dir, base)
    inst = driver.instruments(spark, sf_dir)
    files = inst.select(
        F.concat(F.lit("VENDOR-"), F.substring_index("instrumentId", "_", -1), F.lit(".csv"))
        .alias("file_name"), "symbol")
    feed = vendor.Feed("vendor", base, VENDOR_FEED_MAP, bundled=True)
    rows = vendor.scan_vendor_csv(spark, [feed], files, inst.filter("isActive"), keep=["Seq"])
    return rows.select("symbol", "instrumentId", "file_name", "Seq", "dataTimestamp", "open",
                       "high", "low", "close", "volume")


@query("scan_vendor_feeds", """
SELECT 'S' || CAST(user_id % 9 AS VARCHAR) AS symbol,
       CASE WHEN user_id % 9 IN (0, 1, 2) THEN 'crypto' WHEN user_id % 9 IN (3, 4) THEN 'gold'
            WHEN user_id % 9 IN (5, 6) THEN 'silver' ELSE 'yield' END AS feed,
       CAST(event_id AS VARCHAR) AS Seq, date_trunc('day', ts) AS dataTimestamp,
       CASE WHEN user_id % 9 < 3 THEN round(value - 1, 4) WHEN user_id % 9 < 5 THEN round(value - 2, 4) ELSE value END AS open,
       CASE WHEN user_id % 9 < 3 THEN round(value + 3, 4) WHEN user_id % 9 < 5 THEN round(value + 4, 4) ELSE value END AS high,
       value AS close,
       CASE WHEN user_id % 9 < 3 THEN CAST(event_id % 1000 AS DOUBLE) ELSE 0 END AS volume
FROM events""")
def q_scan_vendor_feeds(spark, sf_dir):
    """Four feeds; the files of the crypto feed order their columns in three ways."""
    base = scratch_path(spark, "vendor-feeds")
    ev = driver.read_table(spark, sf_dir, "events").withColumn("_s", F.col("user_id") % 9)
    v = F.col("value")
    text = lambda c: F.bround(c, 4).cast("string")
    date, seq = F.date_format("ts", "yyyy-MM-dd").alias("Date"), F.col("event_id").alias("Seq")
    file = F.concat(F.lit("S"), F.col("_s").cast("string"), F.lit(".csv")).alias("file")
    bid, last = text(v - 1).alias("Bid"), text(v).alias("Last")
    high, vol = text(v + 3).alias(" HIGH "), (F.col("event_id") % 1000).cast("string").alias("Volume")
    layouts = {
        "crypto": [([0], [seq, date, bid, last, high, vol]), ([1], [vol, last, date, seq, high, bid]),
                   ([2], [last.alias("Last"), F.lit("x").alias("Mid"), bid, high, date, vol, seq])],
        "gold": [([3, 4], [date, text(v).alias("USDM"), text(v - 2).alias("USDPM"),
                           text(v + 4).alias("USDPM - PM High"), seq])],
        "silver": [([5, 6], [seq, text(v).alias("USDM"), date])],
        "yield": [([7, 8], [date.alias("DATE"), text(v).alias("VALUE"), seq])],
    }
    for feed, files in layouts.items():
        for ids, cols in files:
            (ev.filter(F.col("_s").isin(*ids)).select(file, *cols).write.mode("append")
             .partitionBy("file").option("header", "true").csv(f"{base}/{feed}"))
    maps = {"crypto": vendor.CRYPTO_COLUMNS, "gold": vendor.GOLD_COLUMNS,
            "silver": vendor.SILVER_COLUMNS, "yield": vendor.YIELD_COLUMNS}
    feeds = [vendor.Feed(f, f"{base}/{f}", m) for f, m in maps.items()]
    symbols = ev.select(F.concat(F.lit("S"), F.col("_s").cast("string")).alias("symbol")).distinct()
    rows = vendor.scan_vendor_csv(
        spark, feeds, symbols.select(F.concat("symbol", F.lit(".csv")).alias("file_name"), "symbol"),
        symbols.withColumn("instrumentId", F.col("symbol")), file_name_col="file", keep=["Seq"])
    return rows.select("symbol", "feed", "Seq", "dataTimestamp", "open", "high", "close", "volume")


# ---------------------------------------------------------------- O07 --------

@query("append_series", ORACLES["validate_series"])
def q_append_series(spark, sf_dir):
    valid, _ = iq._validated(spark, sf_dir)
    path = scratch_path(spark, "series-append")
    ops.append_series(valid, path)
    back = spark.read.parquet(path)
    return back.select("seriesId", "instrumentId", "dataSourceId", "dataTimestamp", "close",
                       F.col("extras")["k"].alias("k"), "dataQuality", "ts_defaulted",
                       "event_id")


@query("append_series_twice", ORACLES["validate_series"])
def q_append_series_twice(spark, sf_dir):
    """Two loads, each appended twice as by a retried job: every row is there once."""
    valid, _ = iq._validated(spark, sf_dir)
    path = scratch_path(spark, "series-loads")
    half = F.col("event_id") % 2 == 0
    for name, rows in [("even", valid.filter(half)), ("odd", valid.filter(~half))] * 2:
        ops.append_series(rows, path, load_id=name)
    return ops.read_series(spark, path).select(
        "seriesId", "instrumentId", "dataSourceId", "dataTimestamp", "close",
        F.col("extras")["k"].alias("k"), "dataQuality", "ts_defaulted", "event_id")


# ---------------------------------------------------------------- O06 / O14 --

def _copies(df, n):
    """Rows repeated up to ``n`` times, written as a vendor's files."""
    path = scratch_path(df.sparkSession, "copies")
    times = F.sequence(F.lit(0), (F.col("event_id") % n).cast("int"))
    df.withColumn("_copy", F.explode(times)).drop("_copy", "event_id").write.parquet(path)
    return path


@query("validate_series_copies", """
SELECT 'INST_' || CAST(user_id AS VARCHAR) AS instrumentId, count(*) AS rows, count(*) AS ids, count(*) AS same
FROM events, range(4) r(i) WHERE i <= event_id % 4 GROUP BY user_id""")
def q_validate_series_copies(spark, sf_dir):
    """Equal records in files: ids by instrument, and those that a second reading gives again."""
    ev = driver.read_table(spark, sf_dir, "events")
    path = _copies(ev.select(
        "event_id", F.concat(F.lit("INST_"), F.col("user_id").cast("string")).alias("instrumentId"),
        F.lit("DS_1").alias("dataSourceId"), F.date_format("ts", iq.ISO_FRAC).alias("dataTimestamp"),
        F.create_map(F.lit("close"), F.col("value")).alias("indicators")), 4)

    def ids(name):
        raw = ops.with_row_identity(spark.read.parquet(path))
        return ops.validate_series(raw, iq.BATCH_TS, row_id="rowId")[0].select("instrumentId", F.col("seriesId").alias(name))

    once, again = ids("first"), ids("second").drop("instrumentId")
    both = once.join(again, F.col("first") == F.col("second"), "left")
    return both.groupBy("instrumentId").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("first").alias("ids"), F.count("second").alias("same"))


@query("add_holdings_rows", """
SELECT 'PORT_' || CAST(l_suppkey AS VARCHAR) AS portfolioId, count(*) AS holdings, count(*) AS ids
FROM lineitem, range(3) r(i) WHERE i <= l_linenumber % 3 GROUP BY l_suppkey""")
def q_add_holdings_rows(spark, sf_dir):
    """Holdings read from files with repeated rows, told apart by file and row number."""
    li = driver.read_table(spark, sf_dir, "lineitem")
    path = _copies(li.select(
        F.col("l_linenumber").alias("event_id"), F.concat(F.lit("PORT_"), F.col("l_suppkey").cast("string")).alias("portfolioId"),
        F.concat(F.lit("INST_"), F.col("l_partkey").cast("string")).alias("instrumentId"), F.col("l_quantity").alias("quantity"),
        F.lit(None).cast("double").alias("averageCost"), F.col("l_shipdate").alias("acquiredDate")), 3)
    out = ops.add_holdings(ops.with_row_identity(spark.read.parquet(path)), row_id="rowId")
    return out.groupBy("portfolioId").agg(F.count(F.lit(1)).alias("holdings"), F.countDistinct("holdingId").alias("ids"))


# ---------------------------------------------------------------- O15 --------

def _iso_sql(c: str) -> str:
    return (f"strftime({c}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN strftime({c}, '%f') <> '000000' "
            f"THEN '.' || strftime({c}, '%f') ELSE '' END")


EXPORT_SCHEMA = T.StructType([
    T.StructField("instrumentId", T.StringType()), T.StructField("validFrom", T.StringType()),
    T.StructField("validTo", T.StringType()), T.StructField("isActive", T.BooleanType()),
    T.StructField("deletionMarker", T.StringType()), T.StructField("op", T.StringType()),
    T.StructField("event_id", T.LongType()), T.StructField("transactionStart", T.StringType()),
    T.StructField("validToRecordedAt", T.StringType()),
])


@query("export_documents", VERSIONS_SQL + f"""
SELECT instrumentId, {_iso_sql('validFrom')} AS validFrom, {_iso_sql('validTo')} AS validTo,
       isActive, deletionMarker, op, event_id, {_iso_sql('transactionStart')} AS transactionStart,
       {_iso_sql('validToRecordedAt')} AS validToRecordedAt
FROM versions""")
def q_export_documents(spark, sf_dir):
    path = scratch_path(spark, "export")
    ops.export_documents(versions(spark, sf_dir), path)
    return spark.read.schema(EXPORT_SCHEMA).json(path)


# ---------------------------------------------------------------- O08 --------

@query("stream_ingest_series", ORACLES["validate_series"])
def q_stream_ingest_series(spark, sf_dir):
    base = scratch_path(spark, "stream-ingest")
    raw = iq._raw_records(spark, sf_dir)
    raw.repartition(2).write.json(f"{base}/in")
    q = streams.stream_ingest_series(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt",
                                       batch_ts=iq.BATCH_TS, key_cols=["event_id"],
                                       max_files_per_trigger=1)
    q.awaitTermination()
    valid = spark.read.parquet(f"{base}/out/valid")
    return valid.select("seriesId", "instrumentId", "dataSourceId", "dataTimestamp", "close",
                        F.col("extras")["k"].alias("k"), "dataQuality", "ts_defaulted",
                        "event_id")


# ---------------------------------------------------------------- O40 --------

@query("stream_latest_price", ORACLES["latest_price"])
def q_stream_latest_price(spark, sf_dir):
    base = scratch_path(spark, "stream-latest")
    rows = driver.series(spark, sf_dir).select(*streams.SERIES_ROW.fieldNames())
    rows.repartition(4).write.parquet(f"{base}/in")
    q = streams.stream_latest_price(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt",
                                      max_files_per_trigger=1)
    q.awaitTermination()
    cur = streams.current_latest(spark, f"{base}/out")
    return cur.select(*series_ops.PAIR, "seriesId", "dataTimestamp", "close", "dataQuality")


@query("stream_latest_compacted", ORACLES["latest_price"])
def q_stream_latest_compacted(spark, sf_dir):
    """The same through two snapshots, with batches that land after the list of batches was
    taken and before the data is read."""
    base = scratch_path(spark, "stream-compacted")
    rows = driver.series(spark, sf_dir).select(*streams.SERIES_ROW.fieldNames())

    def arrive(part):
        rows.filter(F.pmod(F.xxhash64("seriesId"), F.lit(3)) == part).coalesce(2).write.mode("append").parquet(f"{base}/in")
        streams.stream_latest_price(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt", max_files_per_trigger=1).awaitTermination()

    arrive(0)
    first = streams.compact_latest(spark, f"{base}/out", f"{base}/snap-1")
    arrive(1)
    upto = streams.published_upto(spark, f"{base}/out")
    arrive(2)
    second = streams.compact_latest(spark, f"{base}/out", f"{base}/snap-2", previous=first, upto=upto)
    cur = streams.current_latest(spark, f"{base}/out", snapshot=second)
    return cur.select(*series_ops.PAIR, "seriesId", "dataTimestamp", "close", "dataQuality")
