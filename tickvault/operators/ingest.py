"""Ingest path: validation, keys, registration, attributes, append and export.

O05-O07, O09-O12, O14, O15. All row-wise work is built-in expressions; the
only shuffles are the first-row-per-key dedupes of registration (partial
aggregates) and the anti joins against what already exists.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickvault.functions.columns import (
    iso_text, join_null_safe, normalise_timestamp, parse_iso_utc, split_indicators, surrogate_key)
from tickvault.operators.commits import publish, published
from tickvault.schemas import INDICATORS, SERIES, conform

# The fields a record of each kind must have.
REQUIRED_SERIES = ("instrumentId", "dataSourceId", "dataTimestamp", "indicators")


def normalise_timestamps(df: DataFrame, text_col: str, batch_ts, out_col: str = "dataTimestamp"
                         ) -> DataFrame:
    """O05 over a column: ISO text -> UTC TIMESTAMP_NTZ, batch time when the text
    does not parse, plus a ``ts_defaulted`` flag."""
    batch = F.lit(batch_ts).cast("timestamp_ntz")
    parsed = parse_iso_utc(F.col(text_col))
    return (df.withColumn(out_col, normalise_timestamp(F.col(text_col), batch))
            .withColumn("ts_defaulted", parsed.isNull()))


def with_row_identity(files: DataFrame, out_col: str = "rowId") -> DataFrame:
    """Add the identity of each row of Parquet files as read: file and row number in it. Equal rows
    differ in it, and reading the same files again gives the same values, without a
    shuffle or a stored numbering. To be called on the reader's own DataFrame."""
    place = F.concat(F.col("_metadata.file_path"), F.lit("#"), F.col("_metadata.row_index").cast("string"))
    return files.withColumn(out_col, place)


def validate_series(raw: DataFrame, batch_ts, key_cols: list[str] | None = None,
                    data_quality: str = "verified", row_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Split raw series records into (valid, rejects).

    ``raw`` columns: instrumentId, dataSourceId, dataTimestamp (text),
    indicators (map<string,double>, or the text of a JSON object with values
    of any type), optional dataQuality. A record needs non-null ids, a
    timestamp and at least one indicator; a non-finite number is refused.
    Numbers go to the typed columns and ``extras``, other values to ``texts``;
    with a ``_corrupt_record`` column, its rows are rejected as malformed. The timestamp is normalised (O05; unparsable text
    falls back to the batch time, flagged). Valid rows come out in the
    ``series`` layout with a content-derived ``seriesId`` built from
    ``key_cols`` (default: instrument, source, timestamp text and indicators). Equal records
    have equal ids, unless ``row_id`` names a column that tells rows apart
    (``with_row_identity``), which then is part of the key.
    """
    as_text = isinstance(raw.schema["indicators"].dataType, T.StringType)
    if as_text:
        values = F.try_variant_get(F.try_parse_json("indicators"), "$", "map<string,variant>")
        numbers, texts = split_indicators(F.col("_values"))
        staged = raw.withColumn("_values", values).withColumn("_num", numbers).withColumn("_txt", texts)
    else:
        staged = (raw.withColumn("_num", F.col("indicators"))
                  .withColumn("_txt", F.lit(None).cast("map<string,string>")))
    ind = F.col("_num")
    empty = ind.isNull() | (F.size(ind) + F.coalesce(F.size("_txt"), F.lit(0)) <= 0)
    close = F.try_element_at(ind, F.lit("close"))
    finite = lambda c: c.isNull() | (~F.isnan(c) & (F.abs(c) != float("inf")))
    all_finite = F.forall(F.map_values(ind), finite)
    malformed = F.col("_corrupt_record").isNotNull() if "_corrupt_record" in raw.columns else F.lit(False)
    reason = (F.when(malformed, "malformed record")
              .when(F.col("instrumentId").isNull(), "missing instrumentId")
              .when(F.col("dataSourceId").isNull(), "missing dataSourceId")
              .when(F.col("dataTimestamp").isNull(), "missing dataTimestamp")
              .when(empty, "missing indicators")
              .when(~finite(close), "non-finite close")
              .when(~all_finite, "non-finite indicator"))
    tagged = staged.withColumn("reject_reason", reason)
    rejects = tagged.filter(F.col("reject_reason").isNotNull()).select(*raw.columns, "reject_reason")
    ok = normalise_timestamps(tagged.filter(F.col("reject_reason").isNull()),
                              "dataTimestamp", batch_ts, out_col="_ts")
    # By default the payload is part of the key: records that differ get ids that differ.
    keys = key_cols or ["instrumentId", "dataSourceId", "dataTimestamp",
                        F.array_sort(F.map_entries("_num")).alias("indicators"),
                        *([F.array_sort(F.map_entries("_txt")).alias("texts")] if as_text else [])]
    keys = [*keys, *([row_id] if row_id else [])]
    known = F.map_filter(ind, lambda k, v: ~k.isin(*INDICATORS))
    quality = (F.coalesce(F.col("dataQuality"), F.lit(data_quality))
               if "dataQuality" in raw.columns else F.lit(data_quality))
    valid = ok.select(
        surrogate_key("TS_", *keys).alias("seriesId"),
        "instrumentId", "dataSourceId",
        F.col("_ts").alias("dataTimestamp"),
        *[F.try_element_at(ind, F.lit(n)).alias(n) for n in INDICATORS],
        known.alias("extras"),
        F.col("_txt").alias("texts"),
        quality.alias("dataQuality"),
        "ts_defaulted",
        *[c for c in raw.columns if c not in
          (*REQUIRED_SERIES, "dataQuality", "reject_reason", "_corrupt_record")],
    )
    return valid, rejects


def ingest_summary(valid: DataFrame, rejects: DataFrame, by: list[str] | None = None
                   ) -> DataFrame:
    """Counts per group: ingested, attempted, errors, and the status text
    ('success' if anything went in, else 'partial')."""
    by = by or []
    both = (valid.select(*by, F.lit(True).alias("_ok"))
            .unionByName(rejects.select(*by, F.lit(False).alias("_ok"))))
    agg = both.groupBy(*by).agg(
        F.count_if("_ok").alias("ingestedCount"),
        F.count(F.lit(1)).alias("totalAttempted"),
        F.count_if(~F.col("_ok")).alias("errorCount"))
    return agg.withColumn("status", F.when(F.col("ingestedCount") > 0, "success")
                          .otherwise("partial"))


def assign_keys(df: DataFrame, prefix: str, natural_key: list[str], out_col: str,
                ordinal: bool = False) -> DataFrame:
    """Content-derived surrogate ids (prefix + 12 upper-case hex digits).

    With ``ordinal=True`` rows repeating the same natural key get 1, 2, ...
    added to the key, so identical rows still get distinct ids.
    """
    cols = list(natural_key)
    if ordinal:
        df = with_copy_ordinal(df, natural_key)
        cols.append("_ordinal")
    out = df.withColumn(out_col, surrogate_key(prefix, *cols))
    return out.drop("_ordinal") if ordinal else out


# Copies of a row that one task writes in a row of its own list.
COPIES = 1 << 12


def with_copy_ordinal(df: DataFrame, key: list[str]) -> DataFrame:
    """Add ``_ordinal``: 1, 2, ... over the rows sharing ``key``.

    A row whose key is unique gets 1; null key columns are equal to each other. Where ``df`` has no
    column beside the key, copies are equal rows: they are counted (``_counted_copies``). Otherwise
    copies are numbered within their input split first (a window over
    (key, split), so a key repeated across a third of the table is spread
    over all its splits), then offset by the copies in earlier splits (a
    running sum over one count row per (key, split)). The split numbers are frozen by a reliable checkpoint
    (in ``spark.checkpoint.dir``) before the two uses read them, so both
    see the same numbering and a retry after a lost executor re-reads it.
    """
    if set(df.columns) <= set(key):
        return _counted_copies(df)
    split = df.withColumn("_split", F.spark_partition_id()).checkpoint(eager=True)
    w = Window.partitionBy(*key, "_split").orderBy(*key)
    local = split.withColumn("_rn", F.row_number().over(w))
    counts = split.groupBy(*key, "_split").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(*key).orderBy("_split").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = counts.select(*key, "_split",
                            F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"))
    return (join_null_safe(local, offsets, [*key, "_split"])
            .withColumn("_ordinal", F.col("_off") + F.col("_rn"))
            .drop("_split", "_rn", "_off"))


def _counted_copies(df: DataFrame) -> DataFrame:
    """Every row of ``df`` with ``_ordinal`` 1, 2, ... over its copies: rows are counted, then written
    out again as often. Nothing is stored, and the result is the same on every run. The copies of a row
    with over ``COPIES`` of them are dealt over tasks in lists of that many.

    Grouping makes a floating zero positive, so the sign of zeros is part of the group.
    """
    cols = df.columns
    zeros = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    negative = [F.when((F.col(c) == 0) & F.col(c).cast("string").startswith("-"), F.lit(1 << i)).otherwise(F.lit(0))
                for i, c in enumerate(zeros)]
    groups = (df.withColumn("_sign", sum(negative[1:], negative[0]) if negative else F.lit(0))
              .groupBy(*cols, "_sign").agg(F.count(F.lit(1)).alias("_c")))
    signed = [F.when(F.col("_sign").bitwiseAND(F.lit(1 << zeros.index(c))) != 0, F.lit(-0.0).cast(df.schema[c].dataType))
              .otherwise(F.col(c)).alias(c) if c in zeros else F.col(c) for c in cols]
    some = groups.filter(F.col("_c") <= COPIES).select(*signed, F.explode(F.sequence(F.lit(1).cast("long"), "_c")).alias("_ordinal"))
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lists = (groups.filter(F.col("_c") > COPIES)
             .withColumn("_from", F.explode(F.sequence(F.lit(1).cast("long"), "_c", F.lit(COPIES).cast("long"))))
             .repartition(tasks, *cols, "_from"))
    last = F.least(F.col("_c"), F.col("_from") + (COPIES - 1))
    return some.unionByName(lists.select(*signed, F.explode(F.sequence("_from", last)).alias("_ordinal")))


def first_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row per key in ``order`` -- a partial ``min_by`` aggregate,
    so a key repeated a billion times still ships one row per task."""
    cols = [c for c in df.columns if c != key]
    first = F.min_by(F.struct(*cols), F.struct(*order))
    return df.groupBy(key).agg(first.alias("_f")).select(key, "_f.*")


# Fixed values.
INSTRUMENT_FIELDS = ("symbol", "name", "description", "instrumentClass", "region", "currency")


def register_instruments(new: DataFrame, existing: DataFrame, order: list[str],
                         created_at=None) -> DataFrame:
    """Instruments to insert: rows with all six fields, the first per
    symbol in ``order``, minus symbols already registered (active or not)."""
    complete = new
    for f in INSTRUMENT_FIELDS:
        complete = complete.filter(F.col(f).isNotNull())
    firsts = first_per_key(complete.select(*INSTRUMENT_FIELDS, *order), "symbol", order)
    fresh = firsts.join(existing.select("symbol"), "symbol", "left_anti")
    out = assign_keys(fresh, "INST_", ["symbol"], "instrumentId")
    ts = F.lit(created_at).cast("timestamp_ntz") if created_at else F.lit(None).cast("timestamp_ntz")
    return out.select("instrumentId", *INSTRUMENT_FIELDS, F.lit(True).alias("isActive"),
                      ts.alias("validFrom"), ts.alias("createdAt"))


# Fixed values.
SOURCE_FIELDS = ("providerName", "providerType", "apiEndpoint", "description")


def register_sources(new: DataFrame, existing: DataFrame, order: list[str]) -> DataFrame:
    """Sources to insert: complete rows, first per providerType, minus
    provider types already present."""
    complete = new
    for f in SOURCE_FIELDS:
        complete = complete.filter(F.col(f).isNotNull())
    firsts = first_per_key(complete.select(*SOURCE_FIELDS, *order), "providerType", order)
    fresh = firsts.join(existing.select("providerType"), "providerType", "left_anti")
    return assign_keys(fresh, "DS_", ["providerType"], "dataSourceId").select(
        "dataSourceId", *SOURCE_FIELDS)


def _type_name(v: Column) -> Column:
    """Python type name of a JSON value, from its variant schema."""
    s = F.schema_of_variant(v)
    return (F.when(s == "STRING", "str").when(s == "BOOLEAN", "bool")
            .when(s.isin("TINYINT", "SMALLINT", "INT", "BIGINT"), "int")
            .when(s.startswith("DECIMAL") | s.isin("DOUBLE", "FLOAT"), "float")
            .when(s.startswith("ARRAY"), "list").when(s.startswith("OBJECT"), "dict")
            .when(s == "VOID", "NoneType").otherwise(F.lower(s)))


def explode_attributes(df: DataFrame, json_col: str = "attributes",
                       key: str = "instrumentId") -> DataFrame:
    """A JSON object of attributes -> one row per key with its value (text:
    strings as they are, anything else as JSON) and its type name."""
    obj = F.try_variant_get(F.try_parse_json(F.col(json_col)), "$", "map<string,variant>")
    rows = df.select(key, F.explode(obj).alias("attributeName", "_v"))
    kind = _type_name(F.col("_v"))
    # strings as they are, numbers as Python prints them (a float keeps ".0"),
    # anything else as JSON text
    text = (F.when(kind.isin("str", "int"), F.try_variant_get("_v", "$", "string"))
            .when(kind == "float", F.try_variant_get("_v", "$", "double").cast("string"))
            .otherwise(F.to_json("_v")))
    return rows.select(key, "attributeName", text.alias("attributeValue"),
                       kind.alias("attributeType"))


def add_portfolios(df: DataFrame, created_at=None) -> DataFrame:
    """Portfolios with content-derived ids."""
    out = assign_keys(df, "PORT_", ["portfolioName", "ownerType", "ownerId"], "portfolioId")
    ts = F.lit(created_at).cast("timestamp_ntz") if created_at else F.lit(None).cast("timestamp_ntz")
    return out.select("portfolioId", "portfolioName", "ownerType", "ownerId",
                      ts.alias("createdAt"))


def add_holdings(df: DataFrame, natural_key: list[str] | None = None, row_id: str | None = None) -> DataFrame:
    """Holdings with content-derived ids. Repeated holdings get ids of their own: from the
    column ``row_id`` where it is named (``with_row_identity``; no shuffle), else by an ordinal."""
    fields = ["portfolioId", "instrumentId", "quantity", "averageCost", "acquiredDate"]
    key = [*(natural_key or fields), *([row_id] if row_id else [])]
    rows = df.select(*dict.fromkeys([*fields, *key]))
    return assign_keys(rows, "HOLD_", key, "holdingId", ordinal=row_id is None).select("holdingId", *fields)


def _write_series(valid: DataFrame, path: str, mode: str) -> int:
    """Write rows of the series layout, partitioned by month and sorted within files by
    (instrument, source, time), so that Parquet min/max statistics prune range scans. Returns
    their number (an observed metric of the write itself, no second pass)."""
    from pyspark.sql import Observation
    obs = Observation("append_series")
    rows = (conform(valid, SERIES, keep_extra=True)
            .withColumn("ts_month", F.date_format("dataTimestamp", "yyyy-MM")))
    # Range partitioning on the full sort key: sampled boundaries split a busy
    # month -- and a hot instrument within it -- by time across tasks, and
    # each task writes one contiguous, sorted slice. The row count is observed
    # above the exchange, so the partitioner's sampling pass does not count.
    order = ["ts_month", "instrumentId", "dataSourceId", "dataTimestamp"]
    (rows.repartitionByRange(*order).sortWithinPartitions(*order)
     .observe(obs, F.count(F.lit(1)).alias("rows"))
     .write.mode(mode).partitionBy("ts_month").parquet(path))
    return int(obs.get.get("rows", 0))


def append_series(valid: DataFrame, path: str, load_id: str | None = None) -> int:
    """Append rows to the series table; returns the number of rows written.

    With ``load_id`` (letters, digits, ``-`` and ``_``) the rows go to a folder of that load, which is
    published when they are all there: a load that failed is written anew, one that is
    published already is not written again (its number is returned), and ``read_series`` sees
    each load once. Without it rows are appended as they are, and a retry repeats them.
    """
    if load_id is None:
        return _write_series(valid, path, "append")
    if not re.fullmatch(r"[A-Za-z0-9_-]+", load_id):
        raise ValueError("load_id must be letters, digits, - and _")
    spark = valid.sparkSession
    held = published(spark, path, f"load-{load_id}")
    if held:
        return held[f"load-{load_id}"]["rows"]
    rows = _write_series(valid, f"{path}/load=load-{load_id}", "overwrite")
    return publish(spark, path, f"load-{load_id}", rows=rows)["rows"]


def read_series(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all published loads of a series table, read from their folders alone, with the
    columns ``load`` and ``ts_month``. Fails where nothing is published."""
    loads = [name for name, facts in published(spark, path).items() if facts["rows"]]
    if not loads:
        raise ValueError(f"no published load with rows under {path}")
    return spark.read.option("basePath", path).parquet(*[f"{path}/load={name}" for name in sorted(loads)])


def _iso_everywhere(field: T.StructField, col: Column) -> Column:
    dt = field.dataType
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return iso_text(col.cast("timestamp_ntz"))
    if isinstance(dt, T.StructType):
        return F.struct(*[_iso_shallow(f, col[f.name]).alias(f.name) for f in dt.fields])
    if isinstance(dt, T.MapType) and isinstance(dt.valueType, (T.TimestampType, T.TimestampNTZType)):
        return F.transform_values(col, lambda k, v: iso_text(v.cast("timestamp_ntz")))
    return col


def _iso_shallow(field: T.StructField, col: Column) -> Column:
    if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
        return iso_text(col.cast("timestamp_ntz"))
    return col


def export_frame(df: DataFrame, drop: tuple[str, ...] = ("_id",)) -> DataFrame:
    """O15's output form: internal id dropped, timestamps as ISO text -- at the
    top level and one level deep in structs and maps."""
    keep = [f for f in df.schema.fields if f.name not in drop]
    return df.select(*[_iso_everywhere(f, F.col(f.name)).alias(f.name) for f in keep])


def export_documents(df: DataFrame, path: str) -> None:
    """Write the output form as JSON lines."""
    export_frame(df).write.mode("overwrite").option("ignoreNullFields", "false").json(path)
