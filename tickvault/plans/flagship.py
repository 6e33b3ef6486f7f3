"""Flagship query: one scorecard row per (instrument, source).

Statistics (O33) and trend (O35) for every pair, with the instrument's symbol
and name and the source's provider name, over every row of every pair. The dimension
joins are left to Catalyst/AQE, which broadcast the dimension sides only when their
measured size allows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickvault.operators import series as ops
from tickvault.plans.oracle import EXACT_AVG, exact_sum, with_tables
from tickvault.plans.registry import query
from tickvault.sources import driver


def instrument_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = driver.series(spark, sf_dir)
    card = ops.stats_and_trend(s, days=30)
    inst = driver.instruments(spark, sf_dir).select("instrumentId", "symbol", "name")
    src = driver.sources(spark, sf_dir).select("dataSourceId", "providerName")
    return (card.join(inst, "instrumentId", "left")
            .join(src, "dataSourceId", "left")
            .select("instrumentId", "symbol", "name", "dataSourceId", "providerName",
                    "count", "minPrice", "maxPrice", "avgPrice", "medianPrice",
                    "trend", "recentAvg", "olderAvg", "changePercent"))


_SQL = with_tables("series", "instruments", "sources") + f"""
, st AS (
  SELECT instrumentId, dataSourceId, count(close) AS count, min(close) AS minPrice,
         max(close) AS maxPrice, {EXACT_AVG} AS avgPrice, median(close) AS medianPrice
  FROM series WHERE close IS NOT NULL GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY instrumentId, dataSourceId
                               ORDER BY dataTimestamp DESC, seriesId DESC) AS _pos
  FROM series WHERE close IS NOT NULL),
ag AS (
  SELECT instrumentId, dataSourceId, count(close) AS n,
         {exact_sum("CASE WHEN _pos <= 30 THEN close END")} / least(30, count(close)) AS recent,
         CASE WHEN count(close) > 30
              THEN {exact_sum("CASE WHEN _pos > 30 THEN close END")} / (count(close) - 30)
              ELSE 0.0 END AS older
  FROM ranked GROUP BY ALL)
SELECT st.instrumentId, i.symbol, i.name, st.dataSourceId, s.providerName,
       st.count, st.minPrice, st.maxPrice, st.avgPrice, st.medianPrice,
       CASE WHEN n < 2 THEN 'insufficient' WHEN recent > older THEN 'upward'
            WHEN recent < older THEN 'downward' ELSE 'stable' END AS trend,
       CASE WHEN n >= 2 THEN recent END AS recentAvg,
       CASE WHEN n >= 2 THEN older END AS olderAvg,
       CASE WHEN n >= 2 THEN (CASE WHEN older > 0 THEN (recent - older) / older * 100
                                   ELSE 0.0 END) END AS changePercent
FROM st JOIN ag USING (instrumentId, dataSourceId)
LEFT JOIN instruments i ON i.instrumentId = st.instrumentId
LEFT JOIN sources s ON s.dataSourceId = st.dataSourceId"""

query("instrument_scorecard", _SQL)(instrument_scorecard)
