"""Registered catalog queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickvault.operators import catalog as ops
from tickvault.operators import listing
from tickvault.plans.oracle import with_tables
from tickvault.plans.registry import query
from tickvault.session import scratch_path
from tickvault.sources import driver

INST_COLS = "instrumentId, symbol, name, description, instrumentClass, region, currency, isActive"


@query("list_instruments", with_tables("instruments") + """
SELECT instrumentId AS assetId, symbol, name, instrumentClass, region
FROM instruments WHERE isActive""")
def q_list_instruments(spark, sf_dir):
    return ops.list_instruments(driver.instruments(spark, sf_dir))


@query("list_instruments_page", with_tables("instruments") + """
SELECT instrumentId AS assetId, symbol, name, instrumentClass, region
FROM instruments WHERE isActive ORDER BY instrumentId LIMIT 100 OFFSET 100""")
def q_list_instruments_page(spark, sf_dir):
    # The listing's own feature: the second page of 100.
    return ops.list_instruments(driver.instruments(spark, sf_dir), offset=100, limit=100)


_LISTED_SQL = with_tables("instruments") + """
SELECT instrumentId AS assetId, symbol, name, instrumentClass, region FROM instruments WHERE isActive"""


@query("list_instruments_seek", _LISTED_SQL + " AND instrumentId > 'INST_15' ORDER BY instrumentId LIMIT 100")
def q_list_instruments_seek(spark, sf_dir):
    """The 100 instruments that follow a given one."""
    listed = ops.list_instruments(driver.instruments(spark, sf_dir))
    return listing.rows_after(listed, ["assetId"], ("INST_15",), 100)


@query("list_instruments_deep", _LISTED_SQL + """
ORDER BY instrumentId OFFSET (SELECT count(*) * 9 // 10 FROM instruments WHERE isActive) LIMIT 100""")
def q_list_instruments_deep(spark, sf_dir):
    """A page of 100 that starts nine tenths down the listing, from its stored order."""
    listed, path = ops.list_instruments(driver.instruments(spark, sf_dir)), scratch_path(spark, "listing")
    listing.store_order(listed, path, ["assetId"], 16)
    return listing.read_page(spark, path, ["assetId"], listed.count() * 9 // 10, 100)


@query("list_instruments_tool", with_tables("instruments") + """
SELECT instrumentId AS assetId, symbol, name, instrumentClass AS class, region, currency
FROM instruments WHERE isActive""")
def q_list_instruments_tool(spark, sf_dir):
    return ops.list_instruments(driver.instruments(spark, sf_dir), tool=True)


_BY_CLASS = with_tables("instruments") + f"""
SELECT {INST_COLS} FROM (
  SELECT *, row_number() OVER (PARTITION BY instrumentClass ORDER BY instrumentId) AS _rn
  FROM instruments WHERE isActive)"""


@query("instruments_by_class", _BY_CLASS)
def q_instruments_by_class(spark, sf_dir):
    return ops.instruments_by_class(driver.instruments(spark, sf_dir))


@query("instruments_by_class_capped", _BY_CLASS + " WHERE _rn <= 5")
def q_instruments_by_class_capped(spark, sf_dir):
    return ops.instruments_by_class(driver.instruments(spark, sf_dir), limit=5)


@query("inactive_instruments", with_tables("instruments") + f"""
SELECT {INST_COLS} FROM instruments WHERE NOT isActive""")
def q_inactive_instruments(spark, sf_dir):
    return ops.inactive_instruments(driver.instruments(spark, sf_dir))


def _refs(spark, sf_dir):
    """One reference per part: its id, its symbol, or its symbol in lower case."""
    inst = driver.instruments(spark, sf_dir)
    key = F.substring_index("instrumentId", "_", -1).cast("bigint")
    return inst.select(
        F.when(key % 3 == 0, F.col("instrumentId"))
        .when(key % 3 == 1, F.col("symbol"))
        .otherwise(F.lower("symbol")).alias("ref"))


_REFS_SQL = """
, refs AS (
  SELECT CASE CAST(split_part(instrumentId, '_', 2) AS BIGINT) % 3
              WHEN 0 THEN instrumentId WHEN 1 THEN symbol ELSE lower(symbol) END AS ref
  FROM instruments),
act AS (SELECT * FROM instruments WHERE isActive)
"""


def _pick(cols: str) -> str:
    return ", ".join(f"CASE WHEN a.instrumentId IS NOT NULL THEN a.{c} ELSE b.{c} END AS {c}"
                     for c in (x.strip() for x in cols.split(",")))


@query("lookup_instruments", with_tables("instruments") + _REFS_SQL + f"""
SELECT r.ref, {_pick(INST_COLS)}
FROM refs r LEFT JOIN act a ON a.instrumentId = r.ref LEFT JOIN act b ON b.symbol = r.ref""")
def q_lookup_instruments(spark, sf_dir):
    return ops.lookup_instruments(_refs(spark, sf_dir), driver.instruments(spark, sf_dir))


@query("list_sources", with_tables("sources") + """
SELECT dataSourceId, providerName, providerType, description FROM sources""")
def q_list_sources(spark, sf_dir):
    return ops.list_sources(driver.sources(spark, sf_dir))


@query("lookup_sources", with_tables("sources", "provenance") + """
SELECT dataSourceId, providerName, providerType, apiEndpoint, description FROM sources
WHERE dataSourceId IN (SELECT sourceId FROM provenance)""")
def q_lookup_sources(spark, sf_dir):
    refs = driver.provenance(spark, sf_dir).select("sourceId")
    return ops.lookup_sources(refs, driver.sources(spark, sf_dir), ref_col="sourceId", tool=True)


@query("instrument_attributes", with_tables("attributes", "series") + """
SELECT * FROM attributes WHERE instrumentId IN (SELECT instrumentId FROM series)""")
def q_instrument_attributes(spark, sf_dir):
    keys = driver.series(spark, sf_dir).select("instrumentId")
    return ops.instrument_attributes(driver.attributes(spark, sf_dir), keys)


@query("sources_for_instrument", with_tables("series", "sources") + """
SELECT p.instrumentId, s.* FROM (SELECT DISTINCT instrumentId, dataSourceId FROM series) p
JOIN sources s ON s.dataSourceId = p.dataSourceId""")
def q_sources_for_instrument(spark, sf_dir):
    return ops.sources_for_instrument(driver.series(spark, sf_dir), driver.sources(spark, sf_dir))


@query("instrument_details", with_tables("instruments", "attributes", "series", "sources") + f"""
, a AS (SELECT instrumentId, string_agg(attributeName || '=' || attributeValue || ':' ||
           attributeType, ';' ORDER BY attributeName, attributeValue, attributeType) AS s
        FROM attributes GROUP BY instrumentId),
d AS (SELECT p.instrumentId, string_agg(s.dataSourceId || '/' || s.providerName, ';'
           ORDER BY s.dataSourceId) AS s
      FROM (SELECT DISTINCT instrumentId, dataSourceId FROM series) p
      JOIN sources s ON s.dataSourceId = p.dataSourceId GROUP BY p.instrumentId)
SELECT i.*, coalesce(a.s, '') AS attributes, coalesce(d.s, '') AS dataSources
FROM instruments i LEFT JOIN a USING (instrumentId) LEFT JOIN d USING (instrumentId)
WHERE i.isActive""")
def q_instrument_details(spark, sf_dir):
    det = ops.instrument_details(driver.instruments(spark, sf_dir), driver.attributes(spark, sf_dir),
                                 driver.series(spark, sf_dir), driver.sources(spark, sf_dir))
    attrs = F.array_join(F.transform("attributes", lambda x: F.concat(
        x["attributeName"], F.lit("="), x["attributeValue"], F.lit(":"), x["attributeType"])), ";")
    srcs = F.array_join(F.transform("dataSources", lambda x: F.concat(
        x["dataSourceId"], F.lit("/"), x["providerName"])), ";")
    return det.withColumn("attributes", attrs).withColumn("dataSources", srcs)


def _compare_requests(spark, sf_dir):
    """Each order is a comparison request naming its line items' parts: by id,
    by symbol, or by an id that does not exist."""
    li = driver.read_table(spark, sf_dir, "lineitem")
    inst = driver.instruments(spark, sf_dir).select("instrumentId", "symbol")
    lines = li.select(F.col("l_orderkey").alias("requestId"),
                      F.col("l_linenumber").alias("position"),
                      F.concat(F.lit("INST_"), F.col("l_partkey").cast("string")).alias("_id"))
    named = lines.join(inst, lines["_id"] == inst["instrumentId"], "left")
    ref = (F.when(F.col("position") % 3 == 0, F.col("symbol"))
           .when(F.col("position") % 3 == 1, F.col("_id"))
           .otherwise(F.concat(F.lit("MISSING_"), F.col("_id"))))
    return named.select("requestId", "position", ref.alias("ref"))


@query("compare_instruments", with_tables("instruments") + """
, lines AS (
  SELECT l_orderkey AS requestId, l_linenumber AS position,
         'INST_' || CAST(l_partkey AS VARCHAR) AS _id FROM lineitem),
req AS (
  SELECT requestId, position,
         CASE position % 3 WHEN 0 THEN i.symbol WHEN 1 THEN _id ELSE 'MISSING_' || _id END AS ref
  FROM lines LEFT JOIN instruments i ON i.instrumentId = lines._id),
ok AS (SELECT * FROM req WHERE requestId IN
       (SELECT requestId FROM req GROUP BY requestId HAVING count(*) >= 2)),
act AS (SELECT * FROM instruments WHERE isActive),
hit AS (
  SELECT ok.requestId, ok.position, ok.ref,
         CASE WHEN a.instrumentId IS NOT NULL THEN a.instrumentId ELSE b.instrumentId END AS instrumentId,
         CASE WHEN a.instrumentId IS NOT NULL THEN a.symbol ELSE b.symbol END AS symbol,
         CASE WHEN a.instrumentId IS NOT NULL THEN a.name ELSE b.name END AS name,
         CASE WHEN a.instrumentId IS NOT NULL THEN a.instrumentClass ELSE b.instrumentClass END AS class,
         CASE WHEN a.instrumentId IS NOT NULL THEN a.region ELSE b.region END AS region
  FROM ok LEFT JOIN act a ON a.instrumentId = ok.ref LEFT JOIN act b ON b.symbol = ok.ref)
SELECT * FROM hit WHERE instrumentId IS NOT NULL""")
def q_compare_instruments(spark, sf_dir):
    comparison, _rejects = ops.compare_instruments(_compare_requests(spark, sf_dir),
                                                   driver.instruments(spark, sf_dir))
    return comparison


@query("portfolio_holdings", with_tables("holdings") + """
SELECT h.*, c.holdingCount FROM holdings h
JOIN (SELECT portfolioId, count(*) AS holdingCount FROM holdings GROUP BY portfolioId) c
USING (portfolioId)""")
def q_portfolio_holdings(spark, sf_dir):
    return ops.portfolio_holdings(driver.holdings(spark, sf_dir))


@query("source_status", with_tables("sources", "series") + """
SELECT dataSourceId, providerName, providerType,
       CASE WHEN dataSourceId IN (SELECT dataSourceId FROM series) THEN 'Active'
            ELSE 'No data' END AS status
FROM sources""")
def q_source_status(spark, sf_dir):
    return ops.source_status(driver.sources(spark, sf_dir), driver.series(spark, sf_dir))
