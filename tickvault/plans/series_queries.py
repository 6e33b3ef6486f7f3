"""Registered series queries (O23, O32-O35) over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickvault.operators import clustered, rollup
from tickvault.operators import series as ops
from tickvault.plans.oracle import EXACT_AVG, NEWEST, capped, exact_sum, with_tables
from tickvault.plans.registry import ORACLES, query
from tickvault.session import scratch_path
from tickvault.sources import driver

RANGE_START, RANGE_END = "2024-01-05 00:00:00", "2024-01-25 23:59:59"


_RANGE_SQL = with_tables("series") + f"""
SELECT seriesId, instrumentId, dataSourceId, dataTimestamp, close,
       CAST(json_extract(props, '$.k') AS DOUBLE) AS k
FROM (SELECT *, row_number() OVER ({NEWEST}) AS rowNumber FROM series
      WHERE dataTimestamp >= TIMESTAMP '{RANGE_START}' AND dataTimestamp <= TIMESTAMP '{RANGE_END}')"""


def _range(spark, sf_dir, **kw):
    rows = ops.series_range(driver.series(spark, sf_dir), RANGE_START, RANGE_END, **kw)
    return rows.select("seriesId", "instrumentId", "dataSourceId", "dataTimestamp", "close",
                       F.col("extras")["k"].alias("k"))


@query("series_range", _RANGE_SQL)
def q_series_range(spark, sf_dir):
    return _range(spark, sf_dir)


@query("series_range_capped", _RANGE_SQL + " WHERE rowNumber <= 2")
def q_series_range_capped(spark, sf_dir):
    return _range(spark, sf_dir, limit=2)


def scaled(factor: str):
    """The series with every price times ``factor`` and few pairs, so that each has
    hundreds of rows (three instruments)."""
    def table(spark, sf_dir):
        s = driver.series(spark, sf_dir)
        key = F.substring_index("instrumentId", "_", -1).cast("bigint")
        return (s.withColumn("instrumentId", F.concat(F.lit("INST_"), (key % 3).cast("string")))
                .withColumn("close", F.col("close") * F.lit(float(factor))))
    return table


def scaled_sql(factor: str) -> str:
    return f"""
, scaled AS (
  SELECT * REPLACE ('INST_' || CAST(CAST(split_part(instrumentId, '_', 2) AS BIGINT) % 3 AS VARCHAR) AS instrumentId,
                    close * CAST({factor} AS DOUBLE) AS close) FROM series)"""


@query("latest_price", with_tables("series") + f"""
SELECT instrumentId, dataSourceId, seriesId, dataTimestamp, close, 'verified' AS dataQuality
FROM (SELECT *, row_number() OVER ({NEWEST}) AS _rn FROM series) WHERE _rn = 1""")
def q_latest_price(spark, sf_dir):
    return ops.latest_price(driver.series(spark, sf_dir),
                            columns=("seriesId", "dataTimestamp", "close", "dataQuality"))


_STATS_SELECT = f"""
SELECT instrumentId, dataSourceId, count(close) AS count, min(close) AS minPrice,
       max(close) AS maxPrice, {EXACT_AVG} AS avgPrice, median(close) AS medianPrice,
       {{first}} AS firstPrice, {{last}} AS lastPrice, {{last}} - {{first}} AS priceChange,
       CASE WHEN {{first}} <> 0 THEN ({{last}} - {{first}}) / {{first}} * 100 ELSE 0.0 END
         AS percentChange
FROM {{rows}} WHERE close IS NOT NULL
GROUP BY instrumentId, dataSourceId"""


@query("series_stats", with_tables("series") + _STATS_SELECT.format(
    first="min(close)", last="max(close)", rows="series"))
def q_series_stats(spark, sf_dir):
    return ops.series_stats(driver.series(spark, sf_dir))


@query("series_stats_capped", with_tables("series") + _STATS_SELECT.format(
    first="min(close)", last="max(close)", rows=capped("series", 3)))
def q_series_stats_capped(spark, sf_dir):
    return ops.series_stats(driver.series(spark, sf_dir), row_cap=3)


@query("series_stats_long_small", with_tables("series") + scaled_sql("1e-6") + _STATS_SELECT.format(
    first="min(close)", last="max(close)", rows="scaled"))
def q_series_stats_long_small(spark, sf_dir):
    return ops.series_stats(scaled("1e-6")(spark, sf_dir))


@query("series_stats_long_large", with_tables("series") + scaled_sql("1e12") + _STATS_SELECT.format(
    first="min(close)", last="max(close)", rows="scaled"))
def q_series_stats_long_large(spark, sf_dir):
    return ops.series_stats(scaled("1e12")(spark, sf_dir))


_TIME_ROWS = (f"(SELECT * FROM series WHERE dataTimestamp >= TIMESTAMP '{RANGE_START}' "
              f"AND dataTimestamp <= TIMESTAMP '{RANGE_END}')")


@query("series_stats_by_time", with_tables("series") + _STATS_SELECT.format(
    first="arg_min(close, row(dataTimestamp, seriesId))",
    last="arg_max(close, row(dataTimestamp, seriesId))", rows=_TIME_ROWS))
def q_series_stats_by_time(spark, sf_dir):
    return ops.series_stats(driver.series(spark, sf_dir), RANGE_START, RANGE_END, order="time")


_TOOL_SELECT = f"""
SELECT instrumentId, dataSourceId, count(close) AS count, min(close) AS minPrice,
       max(close) AS maxPrice, {EXACT_AVG} AS avgPrice,
       percentile_disc(0.5) WITHIN GROUP (ORDER BY close DESC) AS medianPrice,
       min(close) AS firstPrice, max(close) AS lastPrice,
       max(close) - min(close) AS priceChange, max(close) - min(close) AS volatility
FROM {{rows}} WHERE close IS NOT NULL
GROUP BY instrumentId, dataSourceId"""


@query("series_stats_tool", with_tables("series") + _TOOL_SELECT.format(rows="series"))
def q_series_stats_tool(spark, sf_dir):
    return ops.series_stats_tool(driver.series(spark, sf_dir))


@query("series_stats_tool_long", with_tables("series") + scaled_sql("1") + _TOOL_SELECT.format(rows="scaled"))
def q_series_stats_tool_long(spark, sf_dir):
    return ops.series_stats_tool(scaled("1")(spark, sf_dir))


def _trend_sql(days: int, rows: str, tables: str = "") -> str:
    return with_tables("series") + tables + f"""
, ranked AS (
  SELECT *, row_number() OVER ({NEWEST}) AS _pos FROM {rows} WHERE close IS NOT NULL),
agg AS (
  SELECT instrumentId, dataSourceId, count(close) AS n,
         {exact_sum(f"CASE WHEN _pos <= {days} THEN close END")} / least({days}, count(close)) AS recent,
         CASE WHEN count(close) > {days}
              THEN {exact_sum(f"CASE WHEN _pos > {days} THEN close END")} / (count(close) - {days})
              ELSE 0.0 END AS older,
         max(close) - min(close) AS vol
  FROM ranked GROUP BY instrumentId, dataSourceId)
SELECT instrumentId, dataSourceId, n AS count,
       CASE WHEN n < 2 THEN 'insufficient' WHEN recent > older THEN 'upward'
            WHEN recent < older THEN 'downward' ELSE 'stable' END AS trend,
       CASE WHEN n >= 2 THEN recent END AS recentAvg,
       CASE WHEN n >= 2 THEN older END AS olderAvg,
       CASE WHEN n >= 2 THEN (CASE WHEN older > 0 THEN (recent - older) / older * 100
                                   ELSE 0.0 END) END AS changePercent,
       CASE WHEN n >= 2 THEN vol END AS volatility
FROM agg"""


@query("trend", _trend_sql(30, "series"))
def q_trend(spark, sf_dir):
    return ops.trend(driver.series(spark, sf_dir), days=30)


@query("trend_long", _trend_sql(30, "scaled", scaled_sql("1e-6")))
def q_trend_long(spark, sf_dir):
    return ops.trend(scaled("1e-6")(spark, sf_dir), days=30)


@query("trend_short_window", _trend_sql(5, "series"))
def q_trend_short(spark, sf_dir):
    return ops.trend(driver.series(spark, sf_dir), days=5)


@query("trend_capped", _trend_sql(5, capped("series", 7)))
def q_trend_capped(spark, sf_dir):
    return ops.trend(driver.series(spark, sf_dir), days=5, row_cap=7)


@query("trend_uncapped", _trend_sql(5, "scaled", scaled_sql("1")))
def q_trend_uncapped(spark, sf_dir):
    """Pairs of hundreds of rows, all of them counted."""
    return ops.trend(scaled("1")(spark, sf_dir), days=5, row_cap=None)


def hot(spark, sf_dir):
    """The series with a third of all rows on one pair, every price of which is different."""
    s = driver.series(spark, sf_dir)
    third = F.col("event_id") % 3 == 0
    return (s.withColumn("instrumentId", F.when(third, "INST_HOT").otherwise(F.col("instrumentId")))
            .withColumn("dataSourceId", F.when(third, "DS_0").otherwise(F.col("dataSourceId")))
            .withColumn("close", F.when(third, (F.col("event_id") * 7919 % 1000003).cast("double") / 100).otherwise(F.col("close"))))


_HOT_SQL = """
, hot AS (
  SELECT * REPLACE (CASE WHEN event_id % 3 = 0 THEN 'INST_HOT' ELSE instrumentId END AS instrumentId,
                    CASE WHEN event_id % 3 = 0 THEN 'DS_0' ELSE dataSourceId END AS dataSourceId,
                    CASE WHEN event_id % 3 = 0 THEN CAST(event_id * 7919 % 1000003 AS DOUBLE) / 100 ELSE close END AS close)
  FROM series)"""
HOT_ROWS = 40


@query("series_stats_hot", with_tables("series") + _HOT_SQL + _STATS_SELECT.format(
    first="min(close)", last="max(close)", rows="hot"))
def q_series_stats_hot(spark, sf_dir):
    """Statistics by rank selection: the hot pair's ranges hold a few prices each."""
    return ops.series_stats(hot(spark, sf_dir), rows_per_range=HOT_ROWS)


@query("series_stats_tool_hot", with_tables("series") + _HOT_SQL + _TOOL_SELECT.format(rows="hot"))
def q_series_stats_tool_hot(spark, sf_dir):
    return ops.series_stats_tool(hot(spark, sf_dir), rows_per_range=HOT_ROWS)


@query("trend_repeats", _trend_sql(5, "repeats", """
, repeats AS (SELECT s.* FROM series s, range(4) r(i) WHERE i <= event_id % 4)"""))
def q_trend_repeats(spark, sf_dir):
    """Records that arrived up to four times: equal rows at the edge of the newest five."""
    copies = F.explode(F.sequence(F.lit(0), (F.col("event_id") % 4).cast("int")))
    return ops.trend(driver.series(spark, sf_dir).withColumn("_copy", copies).drop("_copy"), days=5)


ROLLUP_START, ROLLUP_END = "2024-01-05 07:30:00", "2024-01-25 18:00:00"


@query("series_stats_rollup", with_tables("series") + f"""
SELECT instrumentId, dataSourceId, count(close) AS count, min(close) AS minPrice, max(close) AS maxPrice,
       {EXACT_AVG} AS avgPrice
FROM series WHERE close IS NOT NULL
  AND dataTimestamp >= TIMESTAMP '{ROLLUP_START}' AND dataTimestamp <= TIMESTAMP '{ROLLUP_END}'
GROUP BY instrumentId, dataSourceId""")
def q_series_stats_rollup(spark, sf_dir):
    """The daily roll-up of all prices is stored, then a range that cuts two days is answered from it
    and from the prices of those two days; the sketch's quantile is left to the tests."""
    series, path = driver.series(spark, sf_dir), scratch_path(spark, "rollup")
    rollup.daily_rollup(series).write.partitionBy("day").parquet(path)
    return rollup.stats_from_rollup(spark.read.parquet(path), series, ROLLUP_START, ROLLUP_END).drop("quantiles")


def _stored(spark, sf_dir, table=driver.series, **kw):
    return clustered.store_clustered(table(spark, sf_dir), scratch_path(spark, "clustered"), **kw)


@query("series_range_clustered", _RANGE_SQL)
def q_series_range_clustered(spark, sf_dir):
    """The series is stored in buckets of its pairs, then a range is read from them."""
    rows = clustered.range_of(_stored(spark, sf_dir), RANGE_START, RANGE_END)
    return rows.select("seriesId", "instrumentId", "dataSourceId", "dataTimestamp", "close", F.col("extras")["k"].alias("k"))


@query("latest_price_clustered", ORACLES["latest_price"])
def q_latest_price_clustered(spark, sf_dir):
    return clustered.latest_of(_stored(spark, sf_dir), columns=("seriesId", "dataTimestamp", "close", "dataQuality"))


@query("series_stats_clustered", ORACLES["series_stats"])
def q_series_stats_clustered(spark, sf_dir):
    return clustered.stats_of(_stored(spark, sf_dir))


@query("series_stats_tool_clustered", ORACLES["series_stats_tool_hot"])
def q_series_stats_tool_clustered(spark, sf_dir):
    """The hot pair lies in the second part, in many range partitions, and takes rank selection."""
    return clustered.stats_of(_stored(spark, sf_dir, hot, rows_per_pair=HOT_ROWS), tool=True, rows_per_range=HOT_ROWS)


@query("trend_clustered", _trend_sql(5, "hot", _HOT_SQL))
def q_trend_clustered(spark, sf_dir):
    """Ordinary pairs from their buckets, the hot pair from the second part."""
    return clustered.trend_of(_stored(spark, sf_dir, hot, rows_per_pair=HOT_ROWS), days=5)
