"""Pages of a long listing (O16): a stored order for deep pages, and a seek form.

``store_order`` sorts the rows once, by range partitions, and keeps how many rows lie in each. A page at
any offset then reads only the partitions that hold it. ``rows_after`` needs no stored order: it
takes the next rows after a given one, which each task cuts down to the page's size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def store_order(rows: DataFrame, path: str, order: list[str], partitions: int) -> None:
    """Write ``rows`` to ``path`` in ``partitions`` ranges of ``order`` (nulls first), whose last column should make
    rows unique; rows that agree in all of it lie in one range. Counts of the ranges go beside it.
    The columns ``_part`` and ``_nth`` are the store's own."""
    ranged = rows.repartitionByRange(partitions, *order).withColumn("_part", F.spark_partition_id())
    ranged.sortWithinPartitions(*order).write.partitionBy("_part").parquet(f"{path}/rows")
    # a table without rows has no partition that would tell its columns
    rows.limit(0).write.parquet(f"{path}/columns")
    stored = rows.sparkSession.read.schema(ranged.schema).parquet(f"{path}/rows")
    stored.groupBy("_part").agg(F.count(F.lit(1)).alias("rows")).coalesce(1).write.parquet(f"{path}/counts")


def read_page(spark: SparkSession, path: str, order: list[str], offset: int, limit: int) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` of a stored order. Two numbers per partition are summed up in order to
    find the ones that hold the page (one row per partition, in one task); of the others no row is read. One small job (the
    first partition, the last one and the rows before) runs while the query is built."""
    if offset < 0 or limit < 0:
        raise ValueError("offset and limit must not be negative")
    columns = spark.read.parquet(f"{path}/columns").schema
    rows = spark.read.schema(columns.add("_part", T.IntegerType())).parquet(f"{path}/rows")
    counts = spark.read.schema("_part int, rows bigint").parquet(f"{path}/counts")
    upto = F.sum("rows").over(Window.orderBy("_part"))
    held = (counts.select("_part", (upto - F.col("rows")).alias("before"), upto.alias("upto"))
            .filter((F.col("upto") > offset) & (F.col("before") < offset + limit))
            .agg(F.min("_part").alias("lo"), F.max("_part").alias("hi"), F.min("before").alias("before")).first())
    if held["lo"] is None:
        return rows.drop("_part").limit(0)
    page = rows.filter(F.col("_part").between(held["lo"], held["hi"])).orderBy("_part", *order)
    skip = offset - held["before"]
    return (page.offset(skip) if skip else page).limit(limit).drop("_part")


def _after(order: list[str], last: tuple) -> Column:
    """``order`` > ``last``, column by column, nulls first as in the sort."""
    cases, same = [], F.lit(True)
    for name, value in zip(order, last):
        col = F.col(name)
        more = col.isNotNull() if value is None else F.coalesce(col > F.lit(value), F.lit(False))
        cases.append(same & more)
        same = same & col.eqNullSafe(F.lit(value))
    return reduce(lambda a, b: a | b, cases)


def rows_after(rows: DataFrame, order: list[str], last: tuple | None, limit: int) -> DataFrame:
    """The first ``limit`` rows after the row whose ``order`` columns are ``last`` (None: from the start). ``order`` must
    make rows unique. The lower bound on the first column reaches the scan."""
    if last is not None:
        if len(last) != len(order):
            raise ValueError("last must have one value per order column")
        if last[0] is not None:
            rows = rows.filter(F.col(order[0]) >= F.lit(last[0]))
        rows = rows.filter(_after(order, last))
    return rows.orderBy(*order).limit(limit)
