"""A log of published batches beside a table's data.

A batch is written first, to a place of its own, and then published by one small record
under ``<table>/_log``. Readers ask the log once and read exactly the batches it names, so they
never see half a batch or one that landed in between; a retried batch finds its record and
is skipped, or overwrites its own unpublished data. One writer publishes at a time; the log
has one row per batch.
"""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession


def publish(spark: SparkSession, root: str, name: str, **facts) -> dict:
    """Publish batch ``name`` with ``facts`` (JSON values). If it is published already, its record
    stays as it is. Returns the record that holds."""
    held = published(spark, root, name)
    if held:
        return held[name]
    spark.createDataFrame([(json.dumps(facts),)], "facts string").coalesce(1).write.mode("overwrite").json(f"{root}/_log/name={name}")
    return facts


def published(spark: SparkSession, root: str, name: str | None = None) -> dict[str, dict]:
    """The records of all batches, or of batch ``name``, as they stand at this moment."""
    at = f"{root}/_log" if name is None else f"{root}/_log/name={name}"
    try:
        rows = (spark.read.schema("facts string, name string").option("basePath", f"{root}/_log")
                .option("recursiveFileLookup", "false").json(at).collect())
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}
    return {r["name"]: json.loads(r["facts"]) for r in rows}
