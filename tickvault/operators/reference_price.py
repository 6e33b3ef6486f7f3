"""Latest price by free references: O26, O28, O27 and O32 for all requests in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickvault.operators import resolve
from tickvault.operators.series import PAIR, latest_indicators


def latest_price_by_reference(requests: DataFrame, instruments: DataFrame, series: DataFrame, sources: DataFrame,
                              preferred: str = resolve.PREFERRED_PROVIDER_TYPE) -> DataFrame:
    """Per request (requestId, ref, sourceRef) the newest price with all its indicators, and ``status``.

    ``ref`` is an instrument id or an exact symbol. ``sourceRef`` is a source id or, ignoring case, a
    provider's name or type; null or empty asks for the source of the preferred type among those
    with data for the instrument, else the first of them. ``status`` is "ok", "instrument not found",
    "no data sources" (none given and none with data) or "no price"; the answer's columns are null in
    all but the first. Every request row comes out once, repeated ones too. ``default_source`` starts
    one small job while the query is built.
    """
    asked = resolve.resolve_instruments(requests, instruments, mode="exact").drop("tier")
    given = F.nullif(F.col("sourceRef"), F.lit(""))
    named = resolve.resolve_sources(asked.withColumn("_given", given), sources, "_given", mode="exact")
    chosen = (resolve.default_source(series.select("instrumentId"), series, sources, preferred)
              .filter(~F.col("how").startswith("fallback"))
              .select(F.col("instrumentId").alias("_i"), F.col("dataSourceId").alias("_default")))
    pairs = (named.join(chosen, F.col("instrumentId") == F.col("_i"), "left")
             .withColumn("dataSourceId", F.when(F.col("instrumentId").isNull(), F.lit(None))
                         .when(F.col("_given").isNull(), F.col("_default")).otherwise(F.col("dataSourceId")))
             .select("requestId", "ref", "sourceRef", *PAIR))
    status = (F.when(F.col("instrumentId").isNull(), "instrument not found")
              .when(F.col("dataSourceId").isNull(), "no data sources")
              .when(F.col("timestamp").isNull(), "no price").otherwise("ok"))
    return pairs.join(latest_indicators(series), list(PAIR), "left").select(
        "requestId", "ref", "sourceRef", *PAIR, status.alias("status"), "timestamp", "indicators", "texts", "dataQuality")
