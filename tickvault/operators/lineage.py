"""Lineage: provenance rows for ingested records (O13) and their summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickvault.functions.columns import surrogate_key


def payload_hash(payload: str | list[str] | Column) -> Column:
    """SHA-256 of a payload: a text column as it is, or the JSON of the named
    columns taken in name order (key-sorted JSON), so equal payloads hash equal."""
    if isinstance(payload, Column):
        return F.sha2(payload, 256)
    if isinstance(payload, str):
        return F.sha2(F.col(payload).cast("string"), 256)
    return F.sha2(F.to_json(F.struct(*sorted(payload))), 256)


def _lit(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def record_provenance(records: DataFrame, payload: str | list[str], source_type: str | Column,
                      method: str | Column, ingest_time: Column, id_cols: list[str],
                      instrument_col: str = "instrumentId", source_col: str = "dataSourceId",
                      transformation_logic: Column | None = None,
                      raw_hash: Column | None = None) -> DataFrame:
    """One lineage row per accepted record.

    The provenance id is derived from ``id_cols`` (which must identify the
    record), so a retried task writes the same ids. ``raw_hash`` supplies a
    hash computed earlier (e.g. of the record before validation changed it).
    """
    logic = transformation_logic if transformation_logic is not None \
        else F.lit(None).cast("string")
    return records.select(
        surrogate_key("PROV_", *id_cols).alias("provenanceId"),
        F.col(instrument_col).alias("instrumentId"),
        F.col(source_col).alias("sourceId"),
        _lit(source_type).alias("sourceType"),
        ingest_time.cast("timestamp_ntz").alias("ingestTime"),
        (raw_hash if raw_hash is not None else payload_hash(payload)).alias("rawDataHash"),
        _lit(method).alias("ingestionMethod"),
        logic.alias("transformationLogic"),
    )


SUMMARY_FIELDS = ("provenanceId", "sourceType", "ingestTime", "rawDataHash", "ingestionMethod")
TOOL_FIELDS = ("provenanceId", "sourceType", "ingestTime", "ingestionMethod")


def provenance_summary(provenance: DataFrame, sources: DataFrame,
                       keys: DataFrame | None = None, tool: bool = False) -> DataFrame:
    """Per (instrument, source) the newest lineage row and the row count,
    with the source's name and type ('Unknown' when the source is missing).

    ``max_by`` and ``count`` are partial aggregates, so a hot instrument adds
    one row per map task to the shuffle.
    """
    rows = provenance
    if keys is not None:
        rows = rows.join(keys.select("instrumentId").distinct(), "instrumentId", "left_semi")
    fields = TOOL_FIELDS if tool else SUMMARY_FIELDS
    newest = F.max_by(F.struct(*fields), F.struct("ingestTime", "provenanceId"))
    summary = (rows.groupBy("instrumentId", "sourceId")
               .agg(newest.alias("_n"), F.count(F.lit(1)).alias("totalRecords"))
               .select("instrumentId", "sourceId", "_n.*", "totalRecords"))
    if tool:
        return summary.drop("totalRecords")
    src = sources.select(F.col("dataSourceId").alias("sourceId"), "providerName", "providerType")
    unknown = F.lit("Unknown")
    return (summary.join(src, "sourceId", "left")
            .withColumn("providerName", F.coalesce("providerName", unknown))
            .withColumn("providerType", F.coalesce("providerType", unknown)))
