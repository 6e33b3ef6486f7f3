"""A stored version table that batches of changes are merged into (O37, O38 incrementally).

Changes and versions lie in buckets of the key's hash. A batch, late changes included, reads
the buckets its keys fall into and nothing else: of each of its keys, the versions before the
earliest new change stay as they are, and the changes from the version in force there onward
are folded again. New contents of a bucket go to a folder of the merge, which is then
published (``operators.commits``); readers take each bucket from the last merge that wrote
it. A merge that failed is done anew, one that is published is not repeated.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickvault.operators.commits import publish, published
from tickvault.operators.temporal import ROWS_PER_BUCKET, apply_changes

BUCKETS = 64
# Files per bucket that a batch may be written to in parallel, so that a hot key is too.
FILES = 8
# Sequence numbers of the two rows that stand for a key's past; a feed must not use them.
_PAST = -(1 << 63)


def _with(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*df.schema.fields, T.StructField(name, kind)])


def _merges(spark: SparkSession, root: str) -> list[tuple[str, dict]]:
    return sorted(published(spark, root).items(), key=lambda m: m[1]["number"])


def _holders(merges: list[tuple[str, dict]]) -> dict[int, str]:
    """The merge that holds each bucket's versions; buckets without any are left out."""
    out = {}
    for name, facts in merges:
        out |= {b: name for b in facts["buckets"]}
        for b in set(facts["buckets"]) - set(facts["filled"]):
            del out[b]
    return out


def _read(spark: SparkSession, root: str, holders: dict[int, str]) -> DataFrame:
    paths = [f"{root}/versions/merge={name}/bucket={b}" for b, name in sorted(holders.items())]
    return spark.read.option("basePath", f"{root}/versions").parquet(*paths).drop("merge")


def read_versions(spark: SparkSession, root: str) -> DataFrame:
    """The stored versions as of the last published merge (columns of ``apply_changes``)."""
    holders = _holders(_merges(spark, root))
    if not holders:
        raise ValueError(f"no published versions under {root}")
    return _read(spark, root, holders).drop("bucket")


def merge_changes(batch: DataFrame, root: str, name: str, key: str = "instrumentId", ts: str = "ts",
                  seq: str = "event_id", buckets: int = BUCKETS, rows_per_bucket: int = ROWS_PER_BUCKET,
                  **fold) -> None:
    """Merge a batch of changes into the versions stored under ``root``.

    ``name`` (letters, digits, ``-``, ``_``) is the batch's own: a second call with it does
    nothing. After any number of merges the stored versions are those of ``apply_changes`` over
    all batches together, in whatever order their changes came. ``seq`` must be a number and
    tell changes of a key at one time apart. All batches have one schema; ``buckets``
    cannot be changed later. ``fold`` goes to ``apply_changes``. A batch without rows is
    published and changes nothing.
    """
    if not re.fullmatch(r"[A-Za-z0-9_-]+", name):
        raise ValueError("name must be letters, digits, - and _")
    spark = batch.sparkSession
    merges = _merges(spark, root)
    if name in dict(merges):
        return
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    (batch.withColumn("bucket", bucket).repartition("bucket", F.pmod(F.xxhash64(seq), F.lit(FILES)))
     .write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/changes/merge={name}"))
    new = spark.read.schema(_with(batch, "bucket", T.IntegerType())).parquet(f"{root}/changes/merge={name}")
    touched = sorted(r["bucket"] for r in new.select("bucket").distinct().collect())
    filled = _rewrite(spark, root, name, new, merges, touched, key, ts, seq, rows_per_bucket, fold) if touched else []
    publish(spark, root, name, number=len(merges), buckets=touched, filled=filled)


def _rewrite(spark, root, name, new, merges, touched, key, ts, seq, rows_per_bucket, fold) -> list[int]:
    """Write the touched buckets' versions after the batch; returns the buckets that have any."""
    here = F.col("bucket").isin(touched)
    seen = [m for m, _ in merges] + [name]
    changes = (spark.read.schema(_with(new, "merge", T.StringType())).parquet(f"{root}/changes")
               .filter(F.col("merge").isin(seen) & here).drop("merge"))
    folded = lambda feed: apply_changes(feed, key, ts, seq, rows_per_bucket=rows_per_bucket, **fold)
    held = {b: m for b, m in _holders(merges).items() if b in touched}
    at = F.struct(F.col("validFrom").alias("t"), F.col(seq).alias("s"))
    earliest = new.groupBy(F.col(key).alias("_key")).agg(F.min(F.struct(F.col(ts).alias("t"), F.col(seq).alias("s"))).alias("_from"))
    mine = F.col(key) == F.col("_key")
    kept, tails = None, earliest.withColumn("_past", F.lit(None).cast("string"))
    if held:
        old = _read(spark, root, held).withColumn("bucket", F.col("bucket").cast("int"))
        rows = old.join(earliest, mine, "left")
        # The version in force just before the key's earliest new change is where its tail begins.
        past = (rows.filter(at < F.col("_from")).groupBy(F.col(key).alias("_pkey"))
                .agg(F.max(at).alias("_start"), F.max_by("op", at).alias("_past")))
        tails = (earliest.join(past, F.col("_key") == F.col("_pkey"), "left")
                 .select("_key", F.coalesce("_start", "_from").alias("_from"), "_past"))
        untouched = F.col("_from").isNull() | (at < F.col("_from"))
        kept = old.join(tails, mine, "left").filter(untouched).drop("_key", "_from", "_past")
    tail = changes.join(tails, mine).filter(F.struct(F.col(ts).alias("t"), F.col(seq).alias("s")) >= F.col("_from"))
    # A key's past is one or two changes that lead to the state the version in force ended:
    # registered for a delete, registered and deleted for a restore.
    before = tails.filter(F.col("_past").isin("delete", "restore")).select(
        F.col("_key").alias(key), F.col("_from.t").alias(ts),
        F.explode(F.when(F.col("_past") == "delete", F.array(F.lit("register")))
                  .otherwise(F.array(F.lit("register"), F.lit("delete")))).alias("op"))
    before = before.withColumn(seq, F.when(F.col("op") == "register", F.lit(_PAST)).otherwise(F.lit(_PAST + 1)).cast(new.schema[seq].dataType))
    feed = tail.select(*[c for c in new.columns if c != "bucket"]).unionByName(before, allowMissingColumns=True)
    bucket = new.select(F.col(key).alias("_bkey"), "bucket").distinct()
    fresh = (folded(feed).filter(F.col(seq) > _PAST + 1).join(bucket, F.col(key) == F.col("_bkey")).drop("_bkey"))
    out = fresh if kept is None else kept.unionByName(fresh)
    path = f"{root}/versions/merge={name}"
    (out.repartition("bucket", F.pmod(F.xxhash64(key, seq), F.lit(FILES)))
     .write.mode("overwrite").partitionBy("bucket").parquet(path))
    stored = spark.read.schema(out.schema).parquet(path)
    return sorted(r["bucket"] for r in stored.select("bucket").distinct().collect())
