"""Composed queries: several operators in one plan.

reference at once: resolve free text to an instrument (O26), choose its
default source (O28), and compute the trend (O35) for that pair only.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tickvault.operators import catalog, reference_price, resolve
from tickvault.operators import series as series_ops
from tickvault.plans import catalog_queries as cq
from tickvault.plans import resolve_queries as rq
from tickvault.plans.oracle import NEWEST, with_tables
from tickvault.plans.registry import ORACLES, query
from tickvault.plans.series_queries import _trend_sql
from tickvault.sources import driver


@query("trend_by_reference", f"""
SELECT r.refId, r.ref, r.instrumentId, d.dataSourceId, t.count, t.trend, t.recentAvg,
       t.olderAvg, t.changePercent, t.volatility
FROM ({ORACLES['resolve_instruments']}) r
JOIN ({ORACLES['default_source']}) d ON d.instrumentId = r.instrumentId
JOIN ({_trend_sql(30, "series")}) t
  ON t.instrumentId = r.instrumentId AND t.dataSourceId = d.dataSourceId""")
def q_trend_by_reference(spark, sf_dir):
    inst = driver.instruments(spark, sf_dir)
    s = driver.series(spark, sf_dir)
    resolved = (resolve.resolve_instruments(rq._instrument_refs(spark, sf_dir), inst)
                .filter(F.col("instrumentId").isNotNull()))
    chosen = resolve.default_source(inst, s, driver.sources(spark, sf_dir),
                                    preferred=rq.PREFERRED).select("instrumentId", "dataSourceId")
    pairs = resolved.join(chosen, "instrumentId")
    # References here cover the whole instrument table, so the trend is computed
    # for every pair in one pass and joined once (narrowing with keys= would
    # consume `pairs` twice). For a handful of references, pass keys= instead.
    tr = series_ops.trend(s, days=30)
    return pairs.join(tr, ["instrumentId", "dataSourceId"]).select(
        "refId", "ref", "instrumentId", "dataSourceId", "count", "trend", "recentAvg",
        "olderAvg", "changePercent", "volatility")


@query("compare_instruments_api", ORACLES["compare_instruments"]
       .replace("LEFT JOIN act b ON b.symbol = ok.ref", "LEFT JOIN act b ON false"))
def q_compare_instruments_api(spark, sf_dir):
    """The API form: references are ids only (no symbol fallback)."""
    comparison, _ = catalog.compare_instruments(cq._compare_requests(spark, sf_dir),
                                                driver.instruments(spark, sf_dir),
                                                by_symbol=False)
    return comparison


@query("latest_price_by_reference", with_tables("instruments", "series", "sources") + f"""
, requests AS (
  SELECT p_partkey AS requestId,
         CASE p_partkey % 4 WHEN 0 THEN 'INST_' || CAST(p_partkey AS VARCHAR) WHEN 3 THEN p_name
              ELSE upper(replace(p_name, ' ', '-')) || '-' || CAST(p_partkey AS VARCHAR) END AS ref,
         CASE p_partkey % 5 WHEN 0 THEN 'DS_1' WHEN 1 THEN 'AsiA' WHEN 2 THEN '' WHEN 3 THEN 'nowhere' END AS sourceRef
  FROM part),
asked AS (
  SELECT r.*, CASE WHEN starts_with(ref, 'INST_') THEN ref ELSE i.instrumentId END AS instrumentId
  FROM requests r LEFT JOIN (SELECT symbol, instrumentId FROM instruments WHERE isActive) i ON i.symbol = r.ref),
usual AS (
  SELECT instrumentId, arg_min(dataSourceId, row(providerType <> '{rq.PREFERRED}', dataSourceId)) AS id
  FROM (SELECT DISTINCT instrumentId, dataSourceId FROM series) JOIN sources USING (dataSourceId) GROUP BY instrumentId),
pairs AS (
  SELECT a.requestId, a.ref, a.sourceRef, a.instrumentId,
         CASE WHEN a.instrumentId IS NULL THEN NULL WHEN coalesce(sourceRef, '') = '' THEN u.id
              ELSE coalesce((SELECT min(dataSourceId) FROM sources
                             WHERE lower(providerName) = lower(sourceRef) OR lower(providerType) = lower(sourceRef)),
                            sourceRef) END AS dataSourceId
  FROM asked a LEFT JOIN usual u USING (instrumentId)),
newest AS (SELECT * FROM (SELECT *, row_number() OVER ({NEWEST}) AS _rn FROM series) WHERE _rn = 1)
SELECT requestId, ref, sourceRef, p.instrumentId, p.dataSourceId,
       CASE WHEN p.instrumentId IS NULL THEN 'instrument not found' WHEN p.dataSourceId IS NULL THEN 'no data sources'
            WHEN n.dataTimestamp IS NULL THEN 'no price' ELSE 'ok' END AS status,
       n.dataTimestamp AS timestamp, n.close, CAST(json_extract(n.props, '$.k') AS DOUBLE) AS k,
       CASE WHEN n.dataTimestamp IS NOT NULL THEN 'verified' END AS dataQuality
FROM pairs p LEFT JOIN newest n ON n.instrumentId = p.instrumentId AND n.dataSourceId = p.dataSourceId""")
def q_latest_price_by_reference(spark, sf_dir):
    """Instruments by id, symbol or (not found) name; sources by id, name, an unknown name, or not given."""
    p = driver.read_table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    symbol = F.concat(F.upper(F.replace("p_name", F.lit(" "), F.lit("-"))), F.lit("-"), k.cast("string"))
    ref = F.when(k % 4 == 0, F.concat(F.lit("INST_"), k.cast("string"))).when(k % 4 == 3, F.col("p_name")).otherwise(symbol)
    source = F.when(k % 5 == 0, "DS_1").when(k % 5 == 1, "AsiA").when(k % 5 == 2, "").when(k % 5 == 3, "nowhere")
    found = reference_price.latest_price_by_reference(
        p.select(k.alias("requestId"), ref.alias("ref"), source.alias("sourceRef")), driver.instruments(spark, sf_dir),
        driver.series(spark, sf_dir), driver.sources(spark, sf_dir), preferred=rq.PREFERRED)
    return found.select("requestId", "ref", "sourceRef", "instrumentId", "dataSourceId", "status", "timestamp",
                        F.col("indicators")["close"].alias("close"), F.col("indicators")["k"].alias("k"), "dataQuality")
