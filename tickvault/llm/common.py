"""Helpers the training-data operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickvault.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Rows per Arrow batch handed to Python: texts may be very long, so batches are kept short.
BATCH_ROWS = 500


def query(name: str, oracle: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""
    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
            return fn(spark, sf_dir)
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the shared checkpoint folder and read it back: its rows are
    computed once, and a lost executor does not cost the work before it again."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# What a Python worker keeps from task to task, by operator: it runs tasks of all operators in turn.
_KEPT: dict[str, dict] = {}


def kept(name: str) -> dict:
    """What this worker keeps under ``name``, until a task begins that does not use it."""
    return _KEPT.setdefault(name, {})


def forget(using: str | None = None) -> None:
    """Drop what tasks of other operators have left in this worker."""
    for name in _KEPT.keys() - {using}:
        del _KEPT[name]


def give_back() -> None:
    """Return freed memory to the machine. Allocators keep it for a worker's later tasks, but beside an
    executor's heap there is little room for what each of its workers once needed at most."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim is not None:
        trim(0)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
              schema: str, using: str | None = None) -> DataFrame:
    """``df.mapInArrow``, in workers that keep nothing beyond a task but what is ``kept`` under ``using``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(using)
        yield from fn(batches)
        give_back()
    return df.mapInArrow(run, schema)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def volume(df: DataFrame, column: str) -> tuple[int, int]:
    """(rows, bytes of ``column``): two numbers that size partitions, in one scan."""
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(column)).alias("b")).first()
    return int(r["n"]), int(r["b"] or 0)


def rebatch(rows: Iterator, size: Callable, limit: int) -> Iterator[list]:
    """Lists of rows whose ``size`` adds up to about ``limit``."""
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += size(row)
        if total >= limit:
            yield held
            held, total = [], 0
    if held:
        yield held


def batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema)], schema=schema)
