"""Registered resolver queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickvault.operators import resolve as ops
from tickvault.plans.oracle import with_tables
from tickvault.plans.registry import ORACLES, query
from tickvault.sources import driver

PREFERRED = "asia"


def _instrument_refs(spark, sf_dir):
    """One free-text reference per part, covering every tier and misses:
    its id, its symbol, the symbol in lower case, a word of its name in lower
    case, or text that matches nothing."""
    p = driver.read_table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    sym = F.concat(F.upper(F.replace(F.col("p_name"), F.lit(" "), F.lit("-"))), F.lit("-"),
                   k.cast("string"))
    ref = (F.when(k % 5 == 0, F.concat(F.lit("INST_"), k.cast("string")))
           .when(k % 5 == 1, sym).when(k % 5 == 2, F.lower(sym))
           .when(k % 5 == 3, F.lower(F.split("p_name", " ").getItem(1)))
           .otherwise(F.concat(F.lit("zz"), k.cast("string"))))
    return p.select(k.alias("refId"), ref.alias("ref"))


@query("resolve_instruments", with_tables("instruments") + """
, refs AS (
  SELECT p_partkey AS refId,
         CASE p_partkey % 5
           WHEN 0 THEN 'INST_' || CAST(p_partkey AS VARCHAR)
           WHEN 1 THEN upper(replace(p_name, ' ', '-')) || '-' || CAST(p_partkey AS VARCHAR)
           WHEN 2 THEN lower(upper(replace(p_name, ' ', '-')) || '-' || CAST(p_partkey AS VARCHAR))
           WHEN 3 THEN lower(split_part(p_name, ' ', 2))
           ELSE 'zz' || CAST(p_partkey AS VARCHAR) END AS ref
  FROM part),
act AS (SELECT * FROM instruments WHERE isActive),
d AS (SELECT DISTINCT ref FROM refs),
c AS (
  SELECT ref, 1 AS tier, ref AS instrumentId FROM d WHERE starts_with(ref, 'INST_')
  UNION ALL SELECT ref, 2, min(a.instrumentId) FROM d JOIN act a ON a.symbol = upper(d.ref) GROUP BY ref
  UNION ALL SELECT ref, 3, min(a.instrumentId) FROM d JOIN act a ON upper(a.symbol) = upper(d.ref)
            GROUP BY ref
  UNION ALL SELECT ref, 4, min(a.instrumentId) FROM d JOIN act a
            ON contains(upper(a.name), upper(d.ref)) GROUP BY ref),
w AS (SELECT ref, arg_min(instrumentId, tier) AS instrumentId, min(tier) AS tier
      FROM c GROUP BY ref)
SELECT refs.refId, refs.ref, w.instrumentId, w.tier FROM refs LEFT JOIN w USING (ref)""")
def q_resolve_instruments(spark, sf_dir):
    return ops.resolve_instruments(_instrument_refs(spark, sf_dir), driver.instruments(spark, sf_dir))


@query("resolve_instruments_exact", with_tables("instruments") + """
, refs AS (
  SELECT p_partkey AS refId,
         CASE p_partkey % 5
           WHEN 0 THEN 'INST_' || CAST(p_partkey AS VARCHAR)
           WHEN 1 THEN upper(replace(p_name, ' ', '-')) || '-' || CAST(p_partkey AS VARCHAR)
           WHEN 2 THEN lower(upper(replace(p_name, ' ', '-')) || '-' || CAST(p_partkey AS VARCHAR))
           WHEN 3 THEN lower(split_part(p_name, ' ', 2))
           ELSE 'zz' || CAST(p_partkey AS VARCHAR) END AS ref
  FROM part),
act AS (SELECT * FROM instruments WHERE isActive)
SELECT refId, ref,
       CASE WHEN starts_with(ref, 'INST_') THEN ref ELSE a.instrumentId END AS instrumentId,
       CASE WHEN starts_with(ref, 'INST_') THEN 1 WHEN a.instrumentId IS NOT NULL THEN 2 END AS tier
FROM refs LEFT JOIN act a ON a.symbol = refs.ref""")
def q_resolve_instruments_exact(spark, sf_dir):
    return ops.resolve_instruments(_instrument_refs(spark, sf_dir),
                                   driver.instruments(spark, sf_dir), mode="exact")


_STRASSE = "part.p_name || CASE WHEN p_partkey % 2 = 0 THEN ' STRASSE ' ELSE ' road ' END || p_partkey"


@query("resolve_instruments_long", f"""
WITH act AS (SELECT 'INST_' || CAST(p_partkey AS VARCHAR) AS instrumentId, {_STRASSE} AS name FROM part),
refs AS (
  SELECT p_partkey AS refId,
         CASE p_partkey % 3 WHEN 0 THEN 'straße ' || CAST(p_partkey AS VARCHAR)
              WHEN 1 THEN lower({_STRASSE}) ELSE substr(p_name, 2, 1 + p_partkey % 12) END AS ref
  FROM part),
found AS (
  SELECT d.ref, min(a.instrumentId) AS instrumentId
  FROM (SELECT DISTINCT ref FROM refs) d
  JOIN act a ON contains(upper(a.name), upper(replace(d.ref, 'ß', 'SS'))) GROUP BY d.ref)
SELECT refId, ref, instrumentId, CASE WHEN instrumentId IS NOT NULL THEN 4 END AS tier
FROM refs LEFT JOIN found USING (ref)""")
def q_resolve_instruments_long(spark, sf_dir):
    """Names matched by text that grows in upper case, by whole long names, and by pieces of
    one to twelve characters."""
    p = driver.read_table(spark, sf_dir, "part")
    k, key = F.col("p_partkey"), F.col("p_partkey").cast("string")
    name = F.concat("p_name", F.when(k % 2 == 0, " STRASSE ").otherwise(" road "), key)
    inst = p.select(F.concat(F.lit("INST_"), key).alias("instrumentId"),
                    F.lit(None).cast("string").alias("symbol"), name.alias("name"),
                    F.lit(True).alias("isActive"))
    ref = (F.when(k % 3 == 0, F.concat(F.lit("straße "), key)).when(k % 3 == 1, F.lower(name))
           .otherwise(F.substring("p_name", F.lit(2), (1 + k % 12).cast("int"))))
    return ops.resolve_instruments(p.select(k.alias("refId"), ref.alias("ref")), inst)


def _source_refs(spark, sf_dir):
    """One reference per nation: a source id, a provider type, part of a
    provider name, or the nation's own name (no match: passes through)."""
    n = driver.read_table(spark, sf_dir, "nation")
    r = driver.read_table(spark, sf_dir, "region")
    k = F.col("n_nationkey")
    ref = (F.when(k % 4 == 0, F.concat(F.lit("DS_"), F.col("n_regionkey").cast("string")))
           .when(k % 4 == 1, F.lower("r_name"))
           .when(k % 4 == 2, F.lower(F.substring("r_name", 2, 3)))
           .otherwise(F.col("n_name")))
    return n.join(r, n.n_regionkey == r.r_regionkey).select(k.alias("refId"), ref.alias("ref"))


@query("resolve_sources", with_tables("sources") + """
, refs AS (
  SELECT n_nationkey AS refId,
         CASE n_nationkey % 4 WHEN 0 THEN 'DS_' || CAST(n_regionkey AS VARCHAR)
              WHEN 1 THEN lower(r_name) WHEN 2 THEN lower(substr(r_name, 2, 3))
              ELSE n_name END AS ref
  FROM nation JOIN region ON n_regionkey = r_regionkey),
m AS (
  SELECT ref, min(s.dataSourceId) AS id FROM (SELECT DISTINCT ref FROM refs) d JOIN sources s
    ON lower(s.providerName) = lower(d.ref) OR lower(s.providerType) = lower(d.ref)
    OR contains(lower(s.providerName), lower(d.ref))
  GROUP BY ref)
SELECT refId, refs.ref,
       CASE WHEN starts_with(refs.ref, 'DS_') THEN refs.ref ELSE coalesce(m.id, refs.ref) END
         AS dataSourceId,
       starts_with(refs.ref, 'DS_') OR m.id IS NOT NULL AS resolved
FROM refs LEFT JOIN m USING (ref)""")
def q_resolve_sources(spark, sf_dir):
    return ops.resolve_sources(_source_refs(spark, sf_dir), driver.sources(spark, sf_dir))


@query("resolve_sources_exact", ORACLES["resolve_sources"].replace(
    "\n    OR contains(lower(s.providerName), lower(d.ref))", ""))
def q_resolve_sources_exact(spark, sf_dir):
    return ops.resolve_sources(_source_refs(spark, sf_dir), driver.sources(spark, sf_dir), mode="exact")


@query("default_source", with_tables("instruments", "series", "sources") + f"""
, pairs AS (SELECT DISTINCT p.instrumentId, s.dataSourceId, s.providerType
            FROM series p JOIN sources s ON s.dataSourceId = p.dataSourceId),
per AS (SELECT instrumentId,
               arg_min(dataSourceId, row(providerType <> '{PREFERRED}', dataSourceId)) AS id,
               arg_min(providerType, row(providerType <> '{PREFERRED}', dataSourceId)) AS ptype
        FROM pairs GROUP BY instrumentId),
fb AS (SELECT arg_min(dataSourceId, row(providerType <> '{PREFERRED}', dataSourceId)) AS id,
              arg_min(providerType, row(providerType <> '{PREFERRED}', dataSourceId)) AS ptype
       FROM sources)
SELECT i.instrumentId, coalesce(per.id, fb.id) AS dataSourceId,
       CASE WHEN per.id IS NULL THEN (CASE WHEN fb.ptype = '{PREFERRED}' THEN 'fallback_preferred'
                                           ELSE 'fallback_first' END)
            WHEN per.ptype = '{PREFERRED}' THEN 'preferred' ELSE 'first' END AS how
FROM (SELECT DISTINCT instrumentId FROM instruments) i LEFT JOIN per USING (instrumentId)
CROSS JOIN fb""")
def q_default_source(spark, sf_dir):
    return ops.default_source(driver.instruments(spark, sf_dir), driver.series(spark, sf_dir),
                              driver.sources(spark, sf_dir), preferred=PREFERRED)
