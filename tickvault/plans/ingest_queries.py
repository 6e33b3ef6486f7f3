"""Registered ingest and lineage queries.

Inputs are rendered from the driver tables inside each query (text
timestamps, CSV-like string columns, JSON payloads), with a share of rows
broken on purpose, so every rule is exercised over whole tables. The oracles
state the *expected* outcome of each rendering directly from the source
columns rather than re-parsing the text.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tickvault.operators import ingest as ops
from tickvault.operators import lineage
from tickvault.plans.oracle import with_tables
from tickvault.plans.registry import query
from tickvault.sources import driver, vendor

BATCH_TS = "2024-02-01 00:00:00"
ISO_FRAC = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
DUCK_ISO_FRAC = "'%Y-%m-%dT%H:%M:%S.%f'"


def _key_sql(prefix: str, col: str) -> str:
    """SQL for surrogate_key(prefix, col) over a bigint column."""
    return (f"'{prefix}' || upper(substr(sha256('{{\"{col}\":' || CAST({col} AS VARCHAR) "
            f"|| '}}'), 1, 12))")


# ---------------------------------------------------------------- O05 --------

def _timestamp_texts(spark, sf_dir):
    ev = driver.read_table(spark, sf_dir, "events")
    m = F.col("event_id") % 5
    text = (F.when(m == 0, F.concat(F.date_format(F.col("ts") + F.expr("INTERVAL 2 HOURS"),
                                                  ISO_FRAC), F.lit("+02:00")))
            .when(m == 1, F.concat(F.date_format("ts", ISO_FRAC), F.lit("Z")))
            .when(m == 2, F.date_format("ts", ISO_FRAC))
            .when(m == 3, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
            .when(F.col("event_id") % 10 == 4, F.lit("nope"))
            .otherwise(F.date_format("ts", "yyyy-MM-dd")))
    return ev.select("event_id", text.alias("text"))


@query("normalise_timestamp", f"""
SELECT event_id,
       CASE event_id % 5
         WHEN 0 THEN strftime(ts + INTERVAL 2 HOUR, {DUCK_ISO_FRAC}) || '+02:00'
         WHEN 1 THEN strftime(ts, {DUCK_ISO_FRAC}) || 'Z'
         WHEN 2 THEN strftime(ts, {DUCK_ISO_FRAC})
         WHEN 3 THEN strftime(ts, '%Y-%m-%d %H:%M:%S')
         ELSE CASE WHEN event_id % 10 = 4 THEN 'nope' ELSE strftime(ts, '%Y-%m-%d') END END AS text,
       CASE WHEN event_id % 5 IN (0, 1, 2) THEN ts
            WHEN event_id % 5 = 3 THEN date_trunc('second', ts)
            WHEN event_id % 10 = 4 THEN TIMESTAMP '{BATCH_TS}'
            ELSE date_trunc('day', ts) END AS dataTimestamp,
       event_id % 10 = 4 AS ts_defaulted
FROM events""")
def q_normalise_timestamp(spark, sf_dir):
    return ops.normalise_timestamps(_timestamp_texts(spark, sf_dir), "text", BATCH_TS)


# ---------------------------------------------------------------- O06 --------

def _raw_records(spark, sf_dir):
    ev = driver.read_table(spark, sf_dir, "events")
    e = F.col("event_id")
    close = F.when(e % 19 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    k = F.get_json_object("props", "$.k").cast("double")
    ind = F.when(e % 17 == 0, F.create_map().cast("map<string,double>")).otherwise(
        F.create_map(F.lit("close"), close, F.lit("k"), k))
    return ev.select(
        "event_id",
        F.when(e % 13 == 0, F.lit(None)).otherwise(
            F.concat(F.lit("INST_"), F.col("user_id").cast("string"))).alias("instrumentId"),
        F.concat(F.lit("DS_"), driver.source_index(F.col("event_type")).cast("string"))
        .alias("dataSourceId"),
        F.when(e % 11 == 0, F.lit("nope")).otherwise(F.date_format("ts", ISO_FRAC))
        .alias("dataTimestamp"),
        ind.alias("indicators"))


def _validated(spark, sf_dir):
    return ops.validate_series(_raw_records(spark, sf_dir), BATCH_TS, key_cols=["event_id"])


_RAW_SQL = with_tables("series") + """
, raw AS (
  SELECT event_id, instrumentId, dataSourceId, dataTimestamp AS ts, close,
         CAST(json_extract(props, '$.k') AS DOUBLE) AS k,
         CASE WHEN event_id % 13 = 0 THEN 'missing instrumentId'
              WHEN event_id % 17 = 0 THEN 'missing indicators'
              WHEN event_id % 19 = 0 THEN 'non-finite close' END AS reject_reason
  FROM series)
"""


@query("validate_series", _RAW_SQL + f"""
SELECT {_key_sql('TS_', 'event_id')} AS seriesId, instrumentId, dataSourceId,
       CASE WHEN event_id % 11 = 0 THEN TIMESTAMP '{BATCH_TS}' ELSE ts END AS dataTimestamp,
       close, k, 'verified' AS dataQuality, event_id % 11 = 0 AS ts_defaulted, event_id
FROM raw WHERE reject_reason IS NULL""")
def q_validate_series(spark, sf_dir):
    valid, _ = _validated(spark, sf_dir)
    return valid.select("seriesId", "instrumentId", "dataSourceId", "dataTimestamp", "close",
                        F.col("extras")["k"].alias("k"), "dataQuality", "ts_defaulted",
                        "event_id")


@query("validate_series_rejects", _RAW_SQL + """
SELECT event_id, reject_reason FROM raw WHERE reject_reason IS NOT NULL""")
def q_validate_series_rejects(spark, sf_dir):
    _, rejects = _validated(spark, sf_dir)
    return rejects.select("event_id", "reject_reason")


@query("ingest_summary", _RAW_SQL + """
SELECT dataSourceId, count(*) FILTER (WHERE reject_reason IS NULL) AS ingestedCount,
       count(*) AS totalAttempted, count(*) FILTER (WHERE reject_reason IS NOT NULL) AS errorCount,
       CASE WHEN count(*) FILTER (WHERE reject_reason IS NULL) > 0 THEN 'success'
            ELSE 'partial' END AS status
FROM raw GROUP BY dataSourceId""")
def q_ingest_summary(spark, sf_dir):
    valid, rejects = _validated(spark, sf_dir)
    return ops.ingest_summary(valid, rejects, by=["dataSourceId"])


@query("validate_series_open", f"""
SELECT {_key_sql('TS_', 'event_id')} AS seriesId, value AS close, CAST(event_id % 100 AS DOUBLE) AS lot,
       'R' || CAST(user_id % 5 AS VARCHAR) || '"d' AS rating,
       '{{"k":' || CAST(json_extract(props, '$.k') AS VARCHAR) || '}}' AS nested,
       CASE WHEN event_id % 2 = 0 THEN 'true' ELSE '[1,"x"]' END AS other,
       CAST(1 AS INTEGER) AS numbers, CAST(4 AS INTEGER) AS texts, 'verified' AS dataQuality
FROM events WHERE event_id % 13 <> 0""")
def q_validate_series_open(spark, sf_dir):
    """Indicators of any type as JSON text: numbers, text, nested values, null; one record in
    thirteen has none, in three ways."""
    ev = driver.read_table(spark, sf_dir, "events")
    e = F.col("event_id")
    some = F.concat(
        F.lit('{"close": '), F.col("value").cast("string"), F.lit(', "lot": "'), (e % 100).cast("string"),
        F.lit('", "rating": "R'), (F.col("user_id") % 5).cast("string"), F.lit('\\"d", "nested": {"k": '),
        F.get_json_object("props", "$.k"), F.lit('}, "none": null, "other": '),
        F.when(e % 2 == 0, "true").otherwise('[1, "x"]'), F.lit("}"))
    none = F.when(e % 3 == 0, "{}").when(e % 3 == 1, "no json").otherwise("5")
    raw = ev.select("event_id", F.concat(F.lit("INST_"), F.col("user_id").cast("string")).alias("instrumentId"),
                    F.lit("DS_1").alias("dataSourceId"), F.date_format("ts", ISO_FRAC).alias("dataTimestamp"),
                    F.when(e % 13 == 0, none).otherwise(some).alias("indicators"))
    valid, _ = ops.validate_series(raw, BATCH_TS, key_cols=["event_id"])
    return valid.select("seriesId", "close", F.col("extras")["lot"].alias("lot"),
                        F.col("texts")["rating"].alias("rating"), F.col("texts")["nested"].alias("nested"),
                        F.col("texts")["other"].alias("other"), F.size("extras").alias("numbers"),
                        F.size("texts").alias("texts"), "dataQuality")


# ---------------------------------------------------------------- O02 --------

def _vendor_rows(spark, sf_dir):
    ev = driver.read_table(spark, sf_dir, "events")
    e = F.col("event_id")
    return ev.select(
        "event_id",
        F.when(e % 23 == 0, F.lit("bad")).otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("Date"),
        F.when(e % 2 == 0, (F.col("value") - 0.5).cast("string")).otherwise(F.lit(""))
        .alias("Open"),
        F.when(e % 7 == 0, F.lit("None")).otherwise(F.col("value").cast("string")).alias("Close"),
        F.get_json_object("props", "$.k").alias("Volume"),
        F.when(e % 3 == 0, (F.col("value") + 1).cast("string")).otherwise(F.lit(""))
        .alias(" Adj. Close "))


@query("map_vendor_columns", """
WITH v AS (
  SELECT event_id, CASE WHEN event_id % 23 = 0 THEN NULL ELSE date_trunc('day', ts) END AS d,
         CASE WHEN event_id % 3 = 0 THEN round(value + 1, 4)
              WHEN event_id % 7 = 0 THEN NULL ELSE value END AS close,
         CASE WHEN event_id % 2 = 0 THEN round(value - 0.5, 4) END AS open,
         CAST(json_extract(props, '$.k') AS DOUBLE) AS volume
  FROM events)
SELECT event_id, d AS dataTimestamp, coalesce(open, close) AS open, close AS high, close AS low,
       close, volume
FROM v WHERE d IS NOT NULL AND close IS NOT NULL""")
def q_map_vendor_columns(spark, sf_dir):
    good, _ = vendor.map_vendor_columns(_vendor_rows(spark, sf_dir), vendor.EQUITIES_COLUMNS, keep=["event_id"])
    return good.select("event_id", "dataTimestamp", "open", "high", "low", "close", "volume")


# ---------------------------------------------------------------- O03 --------

def _history_frame(spark, sf_dir):
    li = driver.read_table(spark, sf_dir, "lineitem")
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    return li.select(
        "l_orderkey", "l_linenumber",
        F.col("l_shipdate").alias("Date"),
        unit.alias("Open"), (unit * (1 + F.col("l_tax"))).alias("High"),
        (unit * (1 - F.col("l_discount"))).alias("Low"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount")) / F.col("l_quantity")).alias("Close"),
        (F.col("l_quantity") * 1000 + 0.7).alias("Volume"),
        (F.col("l_tax") / 3).alias("Dividends"),
        F.col("l_discount").alias("Stock Splits"))


def _half_even(expr: str, places: int) -> str:
    return (f"CAST(round_even(CAST(CAST({expr} AS VARCHAR) AS DECIMAL(38,20)), {places}) "
            f"AS DOUBLE)")


@query("normalise_history_frame", f"""
WITH w AS (
  SELECT l_orderkey, l_linenumber, l_shipdate AS d, l_extendedprice / l_quantity AS o,
         l_extendedprice / l_quantity * (1 + l_tax) AS h,
         l_extendedprice / l_quantity * (1 - l_discount) AS lo,
         l_extendedprice * (1 - l_discount) / l_quantity AS c,
         l_quantity * 1000 + 0.7 AS vol, l_tax / 3 AS dv, l_discount AS sp
  FROM lineitem)
SELECT l_orderkey, l_linenumber, d AS dataTimestamp, {_half_even('o', 4)} AS open,
       {_half_even('h', 4)} AS high, {_half_even('lo', 4)} AS low, {_half_even('c', 4)} AS close,
       CAST(floor(vol) AS DOUBLE) AS volume, {_half_even('dv', 6)} AS dividends, sp AS stock_splits
FROM w""")
def q_normalise_history_frame(spark, sf_dir):
    rows = vendor.normalise_history_frame(_history_frame(spark, sf_dir))
    return rows.select("l_orderkey", "l_linenumber", "dataTimestamp", "open", "high", "low",
                       "close", "volume", F.col("extras")["dividends"].alias("dividends"),
                       F.col("extras")["stock_splits"].alias("stock_splits"))


# ---------------------------------------------------------------- O04 --------

def _payloads(spark, sf_dir):
    ev = driver.read_table(spark, sf_dir, "events")
    e = F.col("event_id")
    k = F.get_json_object("props", "$.k")
    sym = F.when(e % 11 == 0, F.lit('"symbol": "", "id": 0')).otherwise(
        F.concat(F.lit('"symbol": "INST_'), F.col("user_id").cast("string"), F.lit('"')))
    ts = (F.when(e % 9 == 0, F.lit(', "timestamp": "nope"'))
          .when(e % 9 == 1, F.lit(""))
          .otherwise(F.concat(F.lit(', "timestamp": "'), F.date_format("ts", ISO_FRAC), F.lit('"'))))
    v = F.col("value").cast("string")
    close = (F.when(e % 10 == 0, F.lit("null"))
             .when(e % 10 == 1, F.concat(F.lit('"'), v, F.lit('"'))).otherwise(v))
    obj = F.concat(F.lit("{"), sym, ts, F.lit(', "close": '), close, F.lit(', "volume": '), k,
                   F.lit(', "pe": '), k, F.lit("}"))
    payload = (F.when(e % 4 == 0, F.concat(F.lit("["), obj, F.lit("]")))
               .when(e % 4 == 1, F.concat(F.lit('{"data": ['), obj, F.lit("]}")))
               .otherwise(obj))
    return ev.select("event_id", payload.alias("payload"))


@query("normalise_external_json", f"""
SELECT event_id, 'INST_' || CAST(user_id AS VARCHAR) AS instrumentId,
       CASE WHEN event_id % 9 = 1 THEN TIMESTAMP '{BATCH_TS}' ELSE ts END AS dataTimestamp,
       CAST(0 AS DOUBLE) AS open, CAST(0 AS DOUBLE) AS high, CAST(0 AS DOUBLE) AS low,
       value AS close,
       CAST(json_extract(props, '$.k') AS DOUBLE) AS volume,
       CAST(json_extract(props, '$.k') AS DOUBLE) AS pe
FROM events WHERE event_id % 11 <> 0 AND event_id % 9 <> 0 AND event_id % 10 <> 0""")
def q_normalise_external_json(spark, sf_dir):
    good, _ = vendor.normalise_external_json(_payloads(spark, sf_dir), BATCH_TS,
                                             keep=["event_id"])
    return good.select("event_id", "instrumentId", "dataTimestamp", "open", "high", "low",
                       "close", "volume", F.col("extras")["pe"].alias("pe"))


# ---------------------------------------------------------------- O12 --------

def _attribute_payloads(spark, sf_dir):
    p = driver.read_table(spark, sf_dir, "part")
    js = F.concat(
        F.lit('{"brand": "'), F.col("p_brand"), F.lit('", "size": '), F.col("p_size").cast("string"),
        F.lit(', "retail": '), F.col("p_retailprice").cast("string"),
        F.lit(', "promo": '), F.when(F.col("p_type") == "PROMO", "true").otherwise("false"),
        F.lit(', "tags": ["'), F.lower("p_type"), F.lit('"], "dims": {"size": '),
        F.col("p_size").cast("string"), F.lit('}, "note": null}'))
    return p.select(F.concat(F.lit("INST_"), F.col("p_partkey").cast("string"))
                    .alias("instrumentId"), js.alias("attributes"))


@query("explode_attributes", with_tables("instruments") + """
, p AS (SELECT 'INST_' || CAST(p_partkey AS VARCHAR) AS instrumentId, * FROM part)
SELECT instrumentId, 'brand' AS attributeName, p_brand AS attributeValue, 'str' AS attributeType FROM p
UNION ALL SELECT instrumentId, 'size', CAST(p_size AS VARCHAR), 'int' FROM p
UNION ALL SELECT instrumentId, 'retail', CAST(p_retailprice AS VARCHAR), 'float' FROM p
UNION ALL SELECT instrumentId, 'promo', CASE WHEN p_type = 'PROMO' THEN 'true' ELSE 'false' END,
                 'bool' FROM p
UNION ALL SELECT instrumentId, 'tags', '["' || lower(p_type) || '"]', 'list' FROM p
UNION ALL SELECT instrumentId, 'dims', '{"size":' || CAST(p_size AS VARCHAR) || '}', 'dict' FROM p
UNION ALL SELECT instrumentId, 'note', 'null', 'NoneType' FROM p""")
def q_explode_attributes(spark, sf_dir):
    return ops.explode_attributes(_attribute_payloads(spark, sf_dir))


# ---------------------------------------------------------------- O09 --------

@query("assign_keys", with_tables("instruments") + """
SELECT symbol, 'INST_' || upper(substr(sha256('{"symbol":"' || symbol || '"}'), 1, 12)) AS newId
FROM instruments""")
def q_assign_keys(spark, sf_dir):
    inst = driver.instruments(spark, sf_dir).select("symbol")
    return ops.assign_keys(inst, "INST_", ["symbol"], "newId")


# ---------------------------------------------------------------- O10 / O11 --

def _candidate_instruments(spark, sf_dir):
    """Every part proposes two instruments: its registered symbol and a
    name-only symbol that many parts share."""
    p = driver.read_table(spark, sf_dir, "part")
    base = [F.col("p_name").alias("name"),
            F.concat(F.col("p_brand"), F.lit(" "), F.col("p_type")).alias("description"),
            F.lower("p_type").alias("instrumentClass"),
            F.when(F.col("p_size") % 2 == 0, "US").otherwise("Global").alias("region"),
            F.lit("USD").alias("currency"), F.col("p_partkey").alias("seq")]
    name_sym = F.upper(F.replace(F.col("p_name"), F.lit(" "), F.lit("-")))
    full_sym = F.concat(name_sym, F.lit("-"), F.col("p_partkey").cast("string"))
    return p.select(full_sym.alias("symbol"), *base).unionByName(
        p.select(name_sym.alias("symbol"), *base))


@query("register_instruments", with_tables("instruments") + """
, cand AS (
  SELECT upper(replace(p_name, ' ', '-')) AS symbol, p_name AS name,
         p_brand || ' ' || p_type AS description, lower(p_type) AS instrumentClass,
         CASE WHEN p_size % 2 = 0 THEN 'US' ELSE 'Global' END AS region, 'USD' AS currency,
         row_number() OVER (PARTITION BY upper(replace(p_name, ' ', '-')) ORDER BY p_partkey) AS rn
  FROM part)
SELECT 'INST_' || upper(substr(sha256('{"symbol":"' || symbol || '"}'), 1, 12)) AS instrumentId,
       symbol, name, description, instrumentClass, region, currency, true AS isActive
FROM cand WHERE rn = 1 AND symbol NOT IN (SELECT symbol FROM instruments)""")
def q_register_instruments(spark, sf_dir):
    out = ops.register_instruments(_candidate_instruments(spark, sf_dir),
                                   driver.instruments(spark, sf_dir), order=["seq"])
    return out.drop("validFrom", "createdAt")


@query("register_sources", with_tables("sources") + """
, cand AS (
  SELECT n_name AS providerName,
         CASE WHEN n_nationkey % 2 = 0 THEN lower(r_name) ELSE lower(n_name) END AS providerType,
         'https://example.invalid/' || lower(n_name) AS apiEndpoint, 'nation ' || n_name AS description,
         n_nationkey AS seq
  FROM nation JOIN region ON n_regionkey = r_regionkey),
firsts AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY providerType ORDER BY seq) AS rn
                 FROM cand) WHERE rn = 1)
SELECT 'DS_' || upper(substr(sha256('{"providerType":"' || providerType || '"}'), 1, 12))
         AS dataSourceId, providerName, providerType, apiEndpoint, description
FROM firsts WHERE providerType NOT IN (SELECT providerType FROM sources)""")
def q_register_sources(spark, sf_dir):
    n = driver.read_table(spark, sf_dir, "nation")
    r = driver.read_table(spark, sf_dir, "region")
    cand = n.join(r, n.n_regionkey == r.r_regionkey).select(
        F.col("n_name").alias("providerName"),
        F.when(F.col("n_nationkey") % 2 == 0, F.lower("r_name")).otherwise(F.lower("n_name"))
        .alias("providerType"),
        F.concat(F.lit("https://example.invalid/"), F.lower("n_name")).alias("apiEndpoint"),
        F.concat(F.lit("nation "), F.col("n_name")).alias("description"),
        F.col("n_nationkey").alias("seq"))
    return ops.register_sources(cand, driver.sources(spark, sf_dir), order=["seq"])


# ---------------------------------------------------------------- O14 --------

@query("add_portfolios", with_tables("portfolios") + """
SELECT 'PORT_' || upper(substr(sha256('{"portfolioName":"' || portfolioName || '","ownerType":"'
         || ownerType || '","ownerId":"' || ownerId || '"}'), 1, 12)) AS portfolioId,
       portfolioName, ownerType, ownerId
FROM portfolios""")
def q_add_portfolios(spark, sf_dir):
    p = driver.portfolios(spark, sf_dir).drop("portfolioId")
    return ops.add_portfolios(p).drop("createdAt")


@query("add_holdings", with_tables("holdings") + """
SELECT portfolioId, instrumentId, quantity,
       CASE WHEN quantity % 7 <> 0 THEN averageCost END AS averageCost, acquiredDate,
       true AS idFormed, CAST(1 AS BIGINT) AS rowsWithId
FROM holdings UNION ALL
SELECT portfolioId, instrumentId, quantity,
       CASE WHEN quantity % 7 <> 0 THEN averageCost END, acquiredDate, true, 1 FROM holdings""")
def q_add_holdings(spark, sf_dir):
    """Every holding twice, a share without a cost: each row has an id of its own."""
    h = driver.holdings(spark, sf_dir).withColumn(
        "averageCost", F.when(F.col("quantity") % 7 != 0, F.col("averageCost")))
    out = ops.add_holdings(h.unionByName(h))
    # All ids are counted, but only those of several rows (by chance, as ids have 48 bits) are joined back:
    # the rows themselves need no shuffle. The one task before the broadcast gets no other ids. No id is
    # null; said so, the join does not work each id out once more to leave nulls out.
    uses = (out.groupBy(F.coalesce("holdingId", F.lit("")).alias("holdingId"))
            .agg(F.count(F.lit(1)).alias("rowsWithId")))
    several = uses.filter(F.col("rowsWithId") > 1).repartition(1)
    return out.join(F.broadcast(several), "holdingId", "left").select(
        "portfolioId", "instrumentId", "quantity", "averageCost", "acquiredDate",
        F.col("holdingId").rlike("^HOLD_[0-9A-F]{12}$").alias("idFormed"),
        F.coalesce("rowsWithId", F.lit(1).cast("long")).alias("rowsWithId"))


# ---------------------------------------------------------------- O13 / O36 --

@query("record_provenance", with_tables("provenance") + f"""
SELECT {_key_sql('PROV_', 'event_id')} AS provenanceId, instrumentId, sourceId, sourceType,
       ingestTime, sha256(rawData) AS rawDataHash, ingestionMethod,
       CAST(NULL AS VARCHAR) AS transformationLogic
FROM provenance""")
def q_record_provenance(spark, sf_dir):
    prov = driver.provenance(spark, sf_dir)
    return lineage.record_provenance(
        prov, payload="rawData", source_type=F.col("sourceType"),
        method=F.col("ingestionMethod"), ingest_time=F.col("ingestTime"), id_cols=["event_id"],
        source_col="sourceId")


_SUMMARY_SQL = with_tables("provenance", "sources") + """
, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY instrumentId, sourceId
                               ORDER BY ingestTime DESC, provenanceId DESC) AS rn,
         count(*) OVER (PARTITION BY instrumentId, sourceId) AS totalRecords
  FROM provenance)
"""


@query("provenance_summary", _SUMMARY_SQL + """
SELECT r.sourceId, r.instrumentId, provenanceId, sourceType, ingestTime, sha256(rawData) AS rawDataHash,
       ingestionMethod, totalRecords, coalesce(s.providerName, 'Unknown') AS providerName,
       coalesce(s.providerType, 'Unknown') AS providerType
FROM ranked r LEFT JOIN sources s ON s.dataSourceId = r.sourceId WHERE rn = 1""")
def q_provenance_summary(spark, sf_dir):
    prov = driver.provenance(spark, sf_dir).withColumn("rawDataHash", lineage.payload_hash("rawData"))
    return lineage.provenance_summary(prov, driver.sources(spark, sf_dir))


@query("provenance_summary_tool", _SUMMARY_SQL + """
SELECT instrumentId, sourceId, provenanceId, sourceType, ingestTime, ingestionMethod
FROM ranked WHERE rn = 1""")
def q_provenance_summary_tool(spark, sf_dir):
    prov = driver.provenance(spark, sf_dir)
    return lineage.provenance_summary(prov, driver.sources(spark, sf_dir), tool=True)
