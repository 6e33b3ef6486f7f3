"""Warehouse tables derived from the driver's Parquet tables.

Each function reads one or two driver tables lazily and maps them onto a
warehouse table (the mapping is documented in FIXTURES.md §3). Nothing is
materialised: Catalyst prunes the scan to the columns a query touches and
pushes predicates down to Parquet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F



def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _id(prefix: str, col: str | Column) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.concat(F.lit(prefix), c.cast("string"))


def source_index(event_type: Column) -> Column:
    # fixed values: event type -> source number
    return (F.when(event_type == "click", 0).when(event_type == "error", 1)
            .when(event_type == "purchase", 2).when(event_type == "signup", 3)
            .otherwise(4))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events -> series: one price point per event, `value` is the close."""
    ev = read_table(spark, sf_dir, "events")
    nul = F.lit(None).cast("double")
    return ev.select(
        _id("TS_", "event_id").alias("seriesId"),
        _id("INST_", "user_id").alias("instrumentId"),
        _id("DS_", source_index(F.col("event_type"))).alias("dataSourceId"),
        F.col("ts").alias("dataTimestamp"),
        nul.alias("open"), nul.alias("high"), nul.alias("low"),
        F.col("value").alias("close"), nul.alias("volume"),
        F.from_json("props", "map<string,double>").alias("extras"),
        F.lit("verified").alias("dataQuality"),
        F.col("event_id"),
    )


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = read_table(spark, sf_dir, "region")
    return r.select(
        _id("DS_", "r_regionkey").alias("dataSourceId"),
        F.col("r_name").alias("providerName"),
        F.lower("r_name").alias("providerType"),
        F.concat(F.lit("https://example.invalid/"), F.lower("r_name")).alias("apiEndpoint"),
        F.concat(F.lit("region "), F.col("r_name")).alias("description"),
    )


def instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "part")
    return p.select(
        _id("INST_", "p_partkey").alias("instrumentId"),
        F.concat(F.upper(F.replace(F.col("p_name"), F.lit(" "), F.lit("-"))), F.lit("-"),
                 F.col("p_partkey").cast("string")).alias("symbol"),
        F.col("p_name").alias("name"),
        F.concat(F.col("p_brand"), F.lit(" "), F.col("p_type")).alias("description"),
        F.lower("p_type").alias("instrumentClass"),
        F.when(F.col("p_size") % 2 == 0, "US").otherwise("Global").alias("region"),
        F.lit("USD").alias("currency"),
        (F.col("p_partkey") % 10 != 9).alias("isActive"),
    )


def attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "part")
    inst = _id("INST_", "p_partkey").alias("instrumentId")
    brand = p.select(inst, F.lit("brand").alias("attributeName"),
                     F.col("p_brand").alias("attributeValue"), F.lit("str").alias("attributeType"))
    size = p.select(inst, F.lit("size").alias("attributeName"),
                    F.col("p_size").cast("string").alias("attributeValue"),
                    F.lit("int").alias("attributeType"))
    return brand.unionByName(size)


def change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events")
    return (ev.filter(F.col("event_type").isin("signup", "error", "purchase"))
            .select(_id("INST_", "user_id").alias("instrumentId"), "ts", "event_id",
                    F.when(F.col("event_type") == "signup", "register")
                    .when(F.col("event_type") == "error", "delete")
                    .otherwise("restore").alias("op")))


def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events")
    return ev.select(
        _id("PROV_", "event_id").alias("provenanceId"),
        _id("INST_", "user_id").alias("instrumentId"),
        _id("DS_", F.col("event_id") % 7).alias("sourceId"),
        F.when(F.col("event_id") % 2 == 0, "bulk_import").otherwise("time_series_data")
        .alias("sourceType"),
        F.col("ts").alias("ingestTime"),
        F.col("props").alias("rawData"),
        F.lit("bulk_api_post").alias("ingestionMethod"),
        F.col("event_id"),
    )


def portfolios(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer")
    return c.select(
        _id("PORT_", "c_custkey").alias("portfolioId"),
        F.col("c_name").alias("portfolioName"),
        F.when(F.col("c_mktsegment") == "HOUSEHOLD", "individual").otherwise("company")
        .alias("ownerType"),
        F.col("c_custkey").cast("string").alias("ownerId"),
    )


def holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    o = read_table(spark, sf_dir, "orders")
    return (li.join(o, li.l_orderkey == o.o_orderkey)
            .select(_id("PORT_", "o_custkey").alias("portfolioId"),
                    _id("INST_", "l_partkey").alias("instrumentId"),
                    F.col("l_quantity").alias("quantity"),
                    (F.col("l_extendedprice") / F.col("l_quantity")).alias("averageCost"),
                    F.col("o_orderdate").alias("acquiredDate")))
