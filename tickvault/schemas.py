"""One fixed StructType per warehouse table.

Known OHLCV indicators are typed top-level columns so a query that reads only
``close`` prunes the Parquet scan to that column; any other number lands in
``extras``, any other value (text, or JSON text) in ``texts``.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

S, D, B, TS = T.StringType(), T.DoubleType(), T.BooleanType(), T.TimestampNTZType()

INDICATORS = ("open", "high", "low", "close", "volume")


def _struct(*fields):
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


TEMPORAL = (("validFrom", TS), ("validTo", TS),
            ("transactionStart", TS), ("transactionEnd", TS))

INSTRUMENTS = _struct(
    ("instrumentId", S), ("symbol", S), ("name", S), ("description", S),
    ("instrumentClass", S), ("region", S), ("currency", S), ("isActive", B),
    *TEMPORAL, ("deletionMarker", S), ("createdAt", TS), ("updatedAt", TS))

SERIES = _struct(
    ("seriesId", S), ("instrumentId", S), ("dataSourceId", S), ("dataTimestamp", TS),
    *[(n, D) for n in INDICATORS], ("extras", T.MapType(S, D)), ("texts", T.MapType(S, S)),
    ("dataQuality", S),
    *TEMPORAL, ("recordedAt", TS))

SOURCES = _struct(
    ("dataSourceId", S), ("providerName", S), ("providerType", S), ("apiEndpoint", S),
    ("description", S), ("dataQuality", S), *TEMPORAL, ("createdAt", TS), ("updatedAt", TS))

PROVENANCE = _struct(
    ("provenanceId", S), ("instrumentId", S), ("sourceId", S), ("sourceType", S),
    ("ingestTime", TS), ("rawDataHash", S), ("ingestionMethod", S),
    ("transformationLogic", S), ("metadata", T.MapType(S, S)))

ATTRIBUTES = _struct(
    ("attributeId", S), ("instrumentId", S), ("attributeName", S), ("attributeValue", S),
    ("attributeType", S), *TEMPORAL)

PORTFOLIOS = _struct(
    ("portfolioId", S), ("portfolioName", S), ("ownerType", S), ("ownerId", S),
    ("createdAt", TS), *TEMPORAL)

HOLDINGS = _struct(
    ("holdingId", S), ("portfolioId", S), ("instrumentId", S), ("quantity", D),
    ("averageCost", D), ("acquiredDate", TS), *TEMPORAL)

# Raw series record as it arrives on the ingest path (JSON lines / stream); the open
# indicators stay JSON text, and a line that is no record is kept whole.
RAW_SERIES_RECORD = _struct(
    ("instrumentId", S), ("dataSourceId", S), ("dataTimestamp", S),
    ("indicators", S), ("dataQuality", S), ("transformationLogic", S), ("_corrupt_record", S))

# Change feed driving the version fold: one row per register / delete / restore.
CHANGE_FEED = _struct(("instrumentId", S), ("ts", TS), ("event_id", T.LongType()),
                      ("op", S), ("reason", S))


def conform(df: DataFrame, schema: T.StructType, keep_extra: bool = False) -> DataFrame:
    """``df`` in a table's fixed layout: its columns in schema order, cast to
    the schema's types, missing ones filled with nulls (extra columns kept
    after them when ``keep_extra``)."""
    have = set(df.columns)
    cols = [(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields]
    if keep_extra:
        cols += [F.col(c) for c in df.columns if c not in schema.fieldNames()]
    return df.select(*cols)
