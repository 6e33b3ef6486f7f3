"""Series stored clustered by (instrument, source): O23 and O32-O35 without a shuffle of prices.

``store_clustered`` writes two parts. Ordinary pairs lie in buckets of the pair's hash, sorted by pair and
time: Spark reads a bucket as one partition and knows that a pair lies in one, so ranges, latest prices,
statistics and trends need no exchange, however often they are asked. Pairs with over ``rows_per_pair``
rows lie apart, in range partitions of (pair, time), and are answered by the operators of ``series``, which
split them; so no bucket grows with a hot pair. Each pair lies in exactly one part.

Every store is a generation of its own below the path and counts once it is published; readers of an older
one go on reading it. Stored tables are found again by their path, in any session.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickvault.functions.columns import exact_sum
from tickvault.operators import series as ops
from tickvault.operators.commits import publish, published

ORDER = (*ops.PAIR, "dataTimestamp", "seriesId")


@dataclass(frozen=True)
class Clustered:
    """The two parts of a stored series; ``hot`` is None where no pair is large."""
    pairs: DataFrame
    hot: DataFrame | None

    def each(self, of_pairs, of_hot=None) -> DataFrame:
        """``of_pairs`` of the buckets and ``of_hot`` (or the same) of the large pairs, together."""
        answer = of_pairs(self.pairs)
        return answer if self.hot is None else answer.unionByName((of_hot or of_pairs)(self.hot))


def store_clustered(series: DataFrame, path: str, buckets: int | None = None,
                    rows_per_pair: int = ops.ROWS_PER_RANGE) -> Clustered:
    """Write ``series`` as a new generation under ``path`` and publish it.

    ``buckets`` (default: the session's shuffle partitions) should leave a bucket what a task can hold,
    some 200 MB; they must be at least 1. The pairs with over ``rows_per_pair`` rows, at most the
    ``MAX_HOT_PAIRS`` largest, go to the second part. The input is read for the counts and once per part.
    Rows with null keys, repeated rows and further columns are kept as they are.
    """
    spark = series.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions")) if buckets is None else buckets
    if buckets < 1 or rows_per_pair < 1:
        raise ValueError("buckets and rows_per_pair must be positive")
    generation = f"gen-{uuid.uuid4().hex}"
    large = ops._hot_pairs(series, rows_per_pair)
    ordinary = series
    if large is not None:
        marked = ops._join_pairs(series, large.select(*ops.PAIR, F.lit(True).alias("_large")), "left", small=True)
        ordinary = marked.filter(F.col("_large").isNull()).drop("_large")
        # range bounds on pair and time: one large pair is spread over many tasks and files
        (marked.filter("_large").drop("_large").repartitionByRange(buckets, *ORDER).sortWithinPartitions(*ORDER)
         .write.parquet(f"{path}/{generation}/hot"))
    table = _table(generation)
    # the shuffle deals rows as the buckets do, so that each task writes one file
    (ordinary.repartition(buckets, *ops.PAIR).write.format("parquet").bucketBy(buckets, *ops.PAIR).sortBy(*ORDER)
     .option("path", f"{path}/{generation}/pairs").saveAsTable(table))
    publish(spark, path, generation, nth=len(published(spark, path)), buckets=buckets, hot=large is not None,
            columns=series.schema.json())
    return open_clustered(spark, path)


def open_clustered(spark: SparkSession, path: str) -> Clustered:
    """The newest published generation under ``path``. Fails where nothing is published."""
    held = published(spark, path)
    if not held:
        raise ValueError(f"no published series under {path}")
    generation, facts = max(held.items(), key=lambda item: item[1]["nth"])
    schema, table = T.StructType.fromJson(json.loads(facts["columns"])), _table(generation)
    if not spark.catalog.tableExists(table):
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        pair, order = ", ".join(ops.PAIR), ", ".join(ORDER)
        place = f"{path}/{generation}/pairs".replace("'", "\\'")
        spark.sql(f"CREATE TABLE {table} ({fields}) USING parquet CLUSTERED BY ({pair}) SORTED BY ({order}) "
                  f"INTO {facts['buckets']} BUCKETS LOCATION '{place}'")
    hot = spark.read.schema(schema).parquet(f"{path}/{generation}/hot") if facts["hot"] else None
    return Clustered(spark.table(table), hot)


def _table(generation: str) -> str:
    return "tickvault_series_" + generation.replace("-", "_")


def range_of(store: Clustered, start=None, end=None, limit: int | None = None,
             keys: DataFrame | None = None) -> DataFrame:
    """O23 over a stored series."""
    return store.each(lambda rows: ops.series_range(rows, start, end, limit, keys))


def latest_of(store: Clustered, keys: DataFrame | None = None, **columns) -> DataFrame:
    """O32 over a stored series (``columns`` as in ``series.latest_price``)."""
    return store.each(lambda rows: ops.latest_price(rows, keys, **columns))


def stats_of(store: Clustered, start=None, end=None, order: str = "value", keys: DataFrame | None = None,
             tool: bool = False, rows_per_range: int = ops.ROWS_PER_RANGE) -> DataFrame:
    """O33 over a stored series, or with ``tool`` O34 (which has no ``order``). Buckets hold no large pair,
    so none is counted or split there; large pairs take rank selection beyond ``rows_per_range`` rows."""
    def stats(rows, per_range):
        if tool:
            return ops.series_stats_tool(rows, start, end, keys=keys, rows_per_range=per_range)
        return ops.series_stats(rows, start, end, order=order, keys=keys, rows_per_range=per_range)
    return store.each(lambda rows: stats(rows, None), lambda rows: stats(rows, rows_per_range))


def trend_of(store: Clustered, days: int = 30, keys: DataFrame | None = None) -> DataFrame:
    """O35 over a stored series. In the buckets one window numbers a pair's closes from the newest, and
    both slices are summed from it: no join, and each price is read once."""
    if days <= 0:
        raise ValueError("days must be positive")
    return store.each(lambda rows: _bucket_trend(rows, days, keys), lambda rows: ops.trend(rows, days, keys=keys))


def _bucket_trend(series: DataFrame, days: int, keys: DataFrame | None) -> DataFrame:
    close = F.col("close")
    newest = (Window.partitionBy(*ops.PAIR).orderBy(F.col("dataTimestamp").desc(), F.col("seriesId").desc())
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # rows without a close take no place: the n-th close has position n, repeated records included
    placed = ops.narrow(series, keys).withColumn("_pos", F.count(close).over(newest))
    recent = F.when(F.col("_pos") <= days, close)
    older = F.when(F.col("_pos") > days, close)
    sums = placed.groupBy(*ops.PAIR).agg(
        F.count(close).alias("_n"), exact_sum(recent).alias("_recent"), exact_sum(older).alias("_older"),
        F.max(close).alias("_hi"), F.min(close).alias("_lo"))
    return sums.select(*ops.PAIR, *ops._trend_columns(F.col("_n"), F.col("_recent"), F.col("_older"), days,
                                                      F.col("_hi"), F.col("_lo")))
