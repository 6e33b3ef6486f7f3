"""Structured Streaming operators.

Both sinks are ``foreachBatch`` writers that overwrite the ``batch_id``
partition of their output (dynamic partition overwrite). A micro-batch that
is replayed after a failure rewrites exactly its own partition, so the
output is the same as if it had run once; with the checkpoint in the shared
checkpoint folder a restarted query resumes where it stopped.

A batch counts once its record is in the output's log (``operators.commits``), written after
its data. Readers and the compaction take the list of batches from the log once and read
those only. The log also keeps the time a batch first began, which a replay takes again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tickvault.operators import ingest, lineage
from tickvault.operators.commits import publish, published
from tickvault.operators.series import PAIR
from tickvault.schemas import RAW_SERIES_RECORD

# the raw record plus the sender's record number
RAW_RECORD = T.StructType(RAW_SERIES_RECORD.fields + [T.StructField("event_id", T.LongType())])

SERIES_ROW = T.StructType([
    T.StructField("seriesId", T.StringType()),
    T.StructField("instrumentId", T.StringType()),
    T.StructField("dataSourceId", T.StringType()),
    T.StructField("dataTimestamp", T.TimestampNTZType()),
    T.StructField("close", T.DoubleType()),
    T.StructField("dataQuality", T.StringType()),
])


def _write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    (df.withColumn("batch_id", F.lit(batch_id))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("batch_id").parquet(path))


def stream_ingest_series(spark: SparkSession, input_dir: str, out_dir: str, checkpoint: str,
                         batch_ts=None, key_cols: list[str] | None = None,
                         schema: T.StructType = RAW_RECORD, max_files_per_trigger: int | None = None,
                         available_now: bool = True) -> StreamingQuery:
    """Accept raw series records as they arrive (JSON lines).

    Each micro-batch is validated (O05/O06); valid rows, rejects (with the
    reason) and one lineage row per accepted record (O13, hash of the raw
    record's own fields) go to ``out_dir/{valid,rejects,lineage}``; the batch is published in
    ``out_dir`` once all three are there.
    A line that is no JSON record is rejected with its text in ``_corrupt_record``.
    Duplicates are kept, as in the reference. ``batch_ts`` (the fallback
    time for unparsable timestamps) defaults to the time at which the batch was first begun, as
    the log keeps it, so a replay gives the same rows.
    """
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    raw = reader.json(input_dir)
    payload_cols = sorted(c for c in schema.fieldNames() if c not in ("event_id", "_corrupt_record"))

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        when = batch_ts
        if when is None:
            now = spark.sql("select date_format(current_timestamp(), 'yyyy-MM-dd HH:mm:ss.SSSSSS')").first()[0]
            when = publish(spark, out_dir, f"begun-{batch_id}", time=now)["time"]
        hashed = batch.withColumn("_rawHash", lineage.payload_hash(payload_cols))
        valid, rejects = ingest.validate_series(hashed, when, key_cols=key_cols)
        valid = valid.persist()
        try:
            _write_batch(valid.drop("_rawHash"), f"{out_dir}/valid", batch_id)
            _write_batch(rejects.drop("_rawHash"), f"{out_dir}/rejects", batch_id)
            logic = (F.col("transformationLogic") if "transformationLogic" in valid.columns
                     else None)
            prov = lineage.record_provenance(
                valid, payload=payload_cols, raw_hash=F.col("_rawHash"),
                source_type="time_series_data",
                method="api_post", ingest_time=F.lit(when),
                id_cols=["seriesId"], transformation_logic=logic)
            _write_batch(prov, f"{out_dir}/lineage", batch_id)
            publish(spark, out_dir, f"batch-{batch_id}", batch=batch_id)
        finally:
            valid.unpersist()

    writer = raw.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start()


def stream_latest_price(spark: SparkSession, input_dir: str, out_dir: str, checkpoint: str,
                        schema: T.StructType = SERIES_ROW, fmt: str = "parquet",
                        max_files_per_trigger: int | None = None,
                        available_now: bool = True) -> StreamingQuery:
    """The latest price per (instrument, source) as series rows arrive.

    A streaming ``max_by`` aggregation keeps one state row per pair; in
    update mode each micro-batch emits only the pairs it changed, written to
    ``out_dir/batch_id=N``. The current answer is the newest batch's row for
    every pair (``current_latest``). State is one row per pair, so no
    watermark is needed.
    """
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    rows = reader.load(input_dir)
    cols = [c for c in schema.fieldNames() if c not in PAIR]
    latest = (rows.groupBy(*PAIR)
              .agg(F.max_by(F.struct(*cols), F.struct("dataTimestamp", "seriesId")).alias("latest")))

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        _write_batch(batch, out_dir, batch_id)
        publish(batch.sparkSession, out_dir, f"batch-{batch_id}", batch=batch_id)

    writer = (latest.writeStream.outputMode("update").foreachBatch(per_batch)
              .option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start()


def published_upto(spark: SparkSession, out_dir: str) -> int:
    """The last published batch of a stream, -1 before the first. Batches follow each other, so
    all up to it are published too."""
    return max((facts["batch"] for facts in published(spark, out_dir).values() if "batch" in facts), default=-1)


def current_latest(spark: SparkSession, out_dir: str, snapshot: str | None = None,
                   upto: int | None = None) -> DataFrame:
    """Current latest price per pair: the row from the newest batch.

    Batches are those published when this is called, or up to ``upto``. With ``snapshot``
    (written by ``compact_latest``), only batches after the
    snapshot's last batch are read (partition pruning on ``batch_id``) and
    combined with it, so the read does not grow with the stream's age.
    """
    upto = published_upto(spark, out_dir) if upto is None else upto
    batches = spark.read.parquet(out_dir).filter(F.col("batch_id") <= upto)
    if snapshot is not None:
        snap = spark.read.parquet(snapshot)
        covered = snap.agg(F.max("batch_id")).first()[0]
        if covered is not None:
            batches = batches.filter(F.col("batch_id") > covered).unionByName(snap)
    return (batches.groupBy(*PAIR).agg(F.max_by("latest", "batch_id").alias("latest"))
            .select(*PAIR, "latest.*"))


def compact_latest(spark: SparkSession, out_dir: str, snapshot: str,
                   previous: str | None = None, upto: int | None = None) -> str:
    """Fold every batch published so far, or up to ``upto`` (and a previous snapshot) into a new
    snapshot folder: one row per pair, tagged with the last batch it covers. The last batch
    is asked for once, before any data is read, so a batch that lands meanwhile is in
    neither the rows nor the tag. Batch folders are left in place; readers given the
    snapshot skip them."""
    upto = published_upto(spark, out_dir) if upto is None else upto
    cur = current_latest(spark, out_dir, previous, upto)
    latest = F.struct(*[c for c in cur.columns if c not in PAIR]).alias("latest")
    cur.select(*PAIR, latest, F.lit(upto).cast("int").alias("batch_id")).write.parquet(snapshot)
    return snapshot
