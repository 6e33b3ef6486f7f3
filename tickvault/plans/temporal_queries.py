"""Registered temporal queries (O18 over versions, O37-O39)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickvault.operators import bitemporal
from tickvault.operators import temporal as ops
from tickvault.operators import version_store
from tickvault.plans.oracle import with_tables
from tickvault.plans.registry import query
from tickvault.session import scratch_path
from tickvault.sources import driver

TX_TIME = "2024-01-15 00:00:00"

ISO = ("strftime(ts, '%Y-%m-%dT%H:%M:%S') || "
       "CASE WHEN strftime(ts, '%f') <> '000000' THEN '.' || strftime(ts, '%f') ELSE '' END")

VERSIONS_SQL = with_tables("change_feed") + f"""
, reg AS (
  SELECT instrumentId, ts AS rts, event_id AS reid FROM (
    SELECT *, row_number() OVER (PARTITION BY instrumentId ORDER BY ts, event_id) AS rn
    FROM change_feed WHERE op = 'register') WHERE rn = 1),
elig AS (
  SELECT f.* FROM change_feed f JOIN reg r USING (instrumentId)
  WHERE (f.ts > r.rts OR (f.ts = r.rts AND f.event_id >= r.reid))
    AND (f.op <> 'register' OR (f.ts = r.rts AND f.event_id = r.reid))),
lagged AS (
  SELECT *, lag(op <> 'delete') OVER (PARTITION BY instrumentId ORDER BY ts, event_id) AS prev
  FROM elig),
kept AS (SELECT * FROM lagged WHERE prev IS NULL OR prev <> (op <> 'delete')),
versions AS (
  SELECT instrumentId, ts AS validFrom,
         lead(ts) OVER (PARTITION BY instrumentId ORDER BY ts, event_id) AS validTo,
         op <> 'delete' AS isActive,
         CASE WHEN op = 'delete' THEN 'DELETED_' || {ISO} || '_user_requested' END AS deletionMarker,
         op, event_id, ts AS transactionStart,
         lead(ts) OVER (PARTITION BY instrumentId ORDER BY ts, event_id) AS validToRecordedAt
  FROM kept)
"""


def versions(spark, sf_dir):
    return ops.apply_changes(driver.change_feed(spark, sf_dir))


def stored_versions(spark, sf_dir):
    """The version table as the warehouse keeps it: folded once, written to
    the shared folder and read back (as-of queries read it twice, and this
    also cuts the fold's lineage)."""
    path = scratch_path(spark, "versions")
    versions(spark, sf_dir).write.parquet(path)
    return spark.read.parquet(path)


@query("apply_changes", VERSIONS_SQL + "SELECT * FROM versions")
def q_apply_changes(spark, sf_dir):
    return versions(spark, sf_dir)


@query("current_instruments", VERSIONS_SQL + "SELECT * FROM versions WHERE validTo IS NULL")
def q_current_instruments(spark, sf_dir):
    return ops.current_versions(versions(spark, sf_dir))


@query("inactive_current", VERSIONS_SQL +
       "SELECT * FROM versions WHERE validTo IS NULL AND NOT isActive")
def q_inactive_current(spark, sf_dir):
    return ops.inactive_current(versions(spark, sf_dir))


_AS_OF_SQL = """
, pts AS (SELECT instrumentId, seriesId, dataTimestamp FROM series)
SELECT p.instrumentId, p.seriesId, p.dataTimestamp, v.validFrom, v.validTo, v.isActive,
       v.deletionMarker, v.op, v.event_id, v.transactionStart, v.validToRecordedAt
FROM pts p JOIN {vers} v ON v.instrumentId = p.instrumentId
 AND v.validFrom <= p.dataTimestamp AND (v.validTo IS NULL OR p.dataTimestamp < v.validTo)"""

def _with_series(sql: str) -> str:
    # prepend the series table to the versions CTE chain
    series_cte = with_tables("series")[len("WITH "):].rstrip()
    return sql.replace("WITH ", "WITH " + series_cte + ",\n", 1)


@query("as_of", _with_series(VERSIONS_SQL) + _AS_OF_SQL.format(vers="versions"))
def q_as_of(spark, sf_dir):
    pts = driver.series(spark, sf_dir).select("instrumentId", "seriesId", "dataTimestamp")
    return ops.as_of(stored_versions(spark, sf_dir), pts)


# Changes are recorded up to four days after they take effect.
_LATE = "ts + to_days(CAST(event_id % 5 AS INTEGER))"
_KNOWN_SQL = VERSIONS_SQL.replace(
    "FROM events WHERE event_type IN ('signup', 'error', 'purchase')",
    f"FROM events WHERE event_type IN ('signup', 'error', 'purchase') AND {_LATE} <= TIMESTAMP '{TX_TIME}'")
_KNOWN_SELECT = _AS_OF_SQL.format(vers="versions").replace(
    "v.transactionStart, v.validToRecordedAt",
    "v.validFrom + to_days(CAST(v.event_id % 5 AS INTEGER)) AS transactionStart")


@query("as_of_bitemporal", _with_series(_KNOWN_SQL) + _KNOWN_SELECT)
def q_as_of_bitemporal(spark, sf_dir):
    """Late records: only what was recorded by the transaction time is folded."""
    pts = driver.series(spark, sf_dir).select("instrumentId", "seriesId", "dataTimestamp")
    late = F.expr("ts + make_dt_interval(cast(event_id % 5 as int))")
    feed = driver.change_feed(spark, sf_dir).withColumn("recordedAt", late)
    path = scratch_path(spark, "known")
    ops.known_versions(feed, TX_TIME).write.parquet(path)
    return ops.as_of(spark.read.parquet(path), pts).drop("validToRecordedAt")


# A third of all changes on one key, all within one second: the hot branch of the fold and of
# the as-of join, with buckets of a few rows.
_HOT_ID = "CASE WHEN event_id % 3 = 0 THEN 'INST_0' ELSE 'INST_' || CAST(user_id AS VARCHAR) END"
_HOT_TS = "CASE WHEN event_id % 3 = 0 THEN TIMESTAMP '2024-01-10' + to_microseconds(event_id) ELSE ts END"
_HOT_SQL = VERSIONS_SQL.replace(
    "SELECT 'INST_' || CAST(user_id AS VARCHAR) AS instrumentId, ts, event_id",
    f"SELECT {_HOT_ID} AS instrumentId, {_HOT_TS} AS ts, event_id")
HOT_ROWS = 20


def _burst(df, id_col="instrumentId", ts="ts"):
    in_burst = F.col("event_id") % 3 == 0
    moment = F.lit("2024-01-10").cast("timestamp_ntz") + F.expr("make_dt_interval(0, 0, 0, event_id / 1e6)")
    return (df.withColumn(id_col, F.when(in_burst, "INST_0").otherwise(F.col(id_col)))
            .withColumn(ts, F.when(in_burst, moment).otherwise(F.col(ts))))


@query("apply_changes_hot", _HOT_SQL + "SELECT * FROM versions")
def q_apply_changes_hot(spark, sf_dir):
    return ops.apply_changes(_burst(driver.change_feed(spark, sf_dir)), rows_per_bucket=HOT_ROWS)


@query("as_of_hot", _HOT_SQL + f"""
, pts AS (SELECT {_HOT_ID} AS instrumentId, event_id AS pointId, {_HOT_TS} AS at FROM events)
SELECT p.instrumentId, p.pointId, p.at, v.validFrom, v.validTo, v.isActive, v.op, v.event_id
FROM pts p LEFT JOIN versions v ON v.instrumentId = p.instrumentId
 AND v.validFrom <= p.at AND (v.validTo IS NULL OR p.at < v.validTo)""")
def q_as_of_hot(spark, sf_dir):
    """Every event as a point, those without a valid version kept (``how="left"``)."""
    path = scratch_path(spark, "versions-hot")
    q_apply_changes_hot(spark, sf_dir).write.parquet(path)
    events = driver.read_table(spark, sf_dir, "events").select(
        F.concat(F.lit("INST_"), F.col("user_id").cast("string")).alias("instrumentId"),
        "event_id", F.col("ts").cast("timestamp_ntz").alias("at"))
    pts = _burst(events, ts="at").withColumnRenamed("event_id", "pointId")
    found = ops.as_of(spark.read.parquet(path), pts, at="at", how="left", rows_per_bucket=HOT_ROWS)
    return found.select("instrumentId", "pointId", "at", "validFrom", "validTo", "isActive", "op", "event_id")


# A third of all changes on one key at one single instant, told apart by event_id alone.
_INSTANT_SQL = VERSIONS_SQL.replace(
    "SELECT 'INST_' || CAST(user_id AS VARCHAR) AS instrumentId, ts, event_id",
    f"SELECT {_HOT_ID} AS instrumentId, CASE WHEN event_id % 3 = 0 THEN TIMESTAMP '2024-01-10' ELSE ts END AS ts, event_id")


def _instant(df, ts="ts"):
    at_once = F.col("event_id") % 3 == 0
    return (df.withColumn("instrumentId", F.when(at_once, "INST_0").otherwise(F.col("instrumentId")))
            .withColumn(ts, F.when(at_once, F.lit("2024-01-10").cast("timestamp_ntz")).otherwise(F.col(ts))))


@query("apply_changes_instant", _INSTANT_SQL + "SELECT * FROM versions")
def q_apply_changes_instant(spark, sf_dir):
    return ops.apply_changes(_instant(driver.change_feed(spark, sf_dir)), rows_per_bucket=HOT_ROWS)


@query("as_of_instant", _INSTANT_SQL + f"""
, pts AS (SELECT {_HOT_ID} AS instrumentId, event_id AS pointId,
                 CASE WHEN event_id % 3 = 0 THEN TIMESTAMP '2024-01-10' ELSE ts END AS at FROM events)
SELECT p.instrumentId, p.pointId, p.at, v.validFrom, v.validTo, v.isActive, v.op, v.event_id
FROM pts p LEFT JOIN versions v ON v.instrumentId = p.instrumentId
 AND v.validFrom <= p.at AND (v.validTo IS NULL OR p.at < v.validTo)""")
def q_as_of_instant(spark, sf_dir):
    """Points and versions of one key at one instant; points before any version kept."""
    path = scratch_path(spark, "versions-instant")
    q_apply_changes_instant(spark, sf_dir).write.parquet(path)
    events = driver.read_table(spark, sf_dir, "events").select(
        F.concat(F.lit("INST_"), F.col("user_id").cast("string")).alias("instrumentId"),
        "event_id", F.col("ts").cast("timestamp_ntz").alias("at"))
    pts = _instant(events, ts="at").withColumnRenamed("event_id", "pointId")
    found = ops.as_of(spark.read.parquet(path), pts, at="at", how="left", rows_per_bucket=HOT_ROWS)
    return found.select("instrumentId", "pointId", "at", "validFrom", "validTo", "isActive", "op", "event_id")


@query("apply_changes_incremental", VERSIONS_SQL + "SELECT * FROM versions")
def q_apply_changes_incremental(spark, sf_dir):
    """Three batches merged into a stored version table, the later ones full of late changes; the
    second is merged twice, as by a retried job."""
    feed, root = driver.change_feed(spark, sf_dir), scratch_path(spark, "version-store")
    for name, part in (("a", 1), ("b", 0), ("b", 0), ("c", 2)):
        version_store.merge_changes(feed.filter(F.col("event_id") % 3 == part), root, name, buckets=8)
    return version_store.read_versions(spark, root)


# Every event asks for its own valid and transaction time; the fold is repeated for each point.
_POINT_LATE = "to_days(CAST(event_id % 5 AS INTEGER))"


def _bitemporal_sql(id_sql: str) -> str:
    return f"""
WITH change_feed AS (
  SELECT {id_sql} AS instrumentId, ts, event_id, ts + {_POINT_LATE} AS rec,
         CASE event_type WHEN 'signup' THEN 'register' WHEN 'error' THEN 'delete' ELSE 'restore' END AS op
  FROM events WHERE event_type IN ('signup', 'error', 'purchase')),
pts AS (
  SELECT {id_sql} AS instrumentId, event_id AS pointId, ts AS validAt,
         ts + to_days(CAST(event_id % 11 AS INTEGER) - 3) AS knownAt FROM events),
f AS (
  SELECT p.pointId, p.validAt, p.knownAt, c.* FROM pts p JOIN change_feed c
  ON c.instrumentId = p.instrumentId AND c.rec <= p.knownAt),
reg AS (
  SELECT *, min(CASE WHEN op = 'register' THEN (ts, event_id) END) OVER (PARTITION BY pointId) AS r FROM f),
lagged AS (
  SELECT *, lag(op <> 'delete') OVER (PARTITION BY pointId ORDER BY ts, event_id) AS prev FROM reg
  WHERE r IS NOT NULL AND (ts, event_id) >= r AND (op <> 'register' OR (ts, event_id) = r)),
v AS (
  SELECT *, lead(ts) OVER w AS validTo, lead(rec) OVER w AS validToRecordedAt FROM lagged
  WHERE prev IS NULL OR prev <> (op <> 'delete')
  WINDOW w AS (PARTITION BY pointId ORDER BY ts, event_id))
SELECT instrumentId, pointId, validAt, knownAt, ts AS validFrom, validTo, op <> 'delete' AS isActive,
       CASE WHEN op = 'delete' THEN 'DELETED_' || {ISO} || '_user_requested' END AS deletionMarker,
       op, event_id, rec AS transactionStart, validToRecordedAt
FROM v WHERE ts <= validAt AND (validTo IS NULL OR validAt < validTo)"""


def _bitemporal_points(spark, sf_dir, **kw):
    feed = driver.change_feed(spark, sf_dir).withColumn("recordedAt", F.expr("ts + make_dt_interval(cast(event_id % 5 as int))"))
    points = driver.read_table(spark, sf_dir, "events").select(
        F.concat(F.lit("INST_"), F.col("user_id").cast("string")).alias("instrumentId"),
        "event_id", F.col("ts").cast("timestamp_ntz").alias("validAt"))
    if kw:
        key = F.when(F.col("event_id") % 3 == 0, "INST_0").otherwise(F.col("instrumentId"))
        feed, points = feed.withColumn("instrumentId", key), points.withColumn("instrumentId", key)
    points = points.withColumn("knownAt", F.expr("validAt + make_dt_interval(cast(event_id % 11 as int) - 3)"))
    return bitemporal.as_of_bitemporal_points(feed, points.withColumnRenamed("event_id", "pointId"),
                                              at="validAt", **kw)


@query("as_of_bitemporal_points", _bitemporal_sql("'INST_' || CAST(user_id AS VARCHAR)"))
def q_as_of_bitemporal_points(spark, sf_dir):
    """Changes recorded up to four days late, points that ask for three days before to seven after."""
    return _bitemporal_points(spark, sf_dir)


@query("as_of_bitemporal_points_hot", _bitemporal_sql(_HOT_ID))
def q_as_of_bitemporal_points_hot(spark, sf_dir):
    """The same with a third of all changes and points on one key, split into small buckets."""
    return _bitemporal_points(spark, sf_dir, rows_per_bucket=500)
