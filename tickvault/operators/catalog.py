"""Catalog queries over instruments, sources, attributes and holdings.

O16-O22, O24, O25, O29-O31. Lookups take a DataFrame of references and
answer them all in one join instead of one request per id.

Join strategy: nothing is hinted. Dimension sides (sources, per-instrument
summaries) are broadcast by Catalyst/AQE only when their measured size is
under ``spark.sql.autoBroadcastJoinThreshold``; above it the same plan runs
as a sort-merge join, and AQE splits a skewed reference key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickvault.functions.columns import join_null_safe


def _order_cols(df: DataFrame, preferred=("createdAt", "instrumentId")):
    return [c for c in preferred if c in df.columns]


def active(instruments: DataFrame) -> DataFrame:
    return instruments.filter(F.col("isActive"))


def list_instruments(instruments: DataFrame, offset: int = 0, limit: int | None = None,
                     tool: bool = False) -> DataFrame:
    """Active instruments, identifying columns; optional page.

    The API form renames the id to ``assetId``; the tool form also calls the
    class ``class`` and adds ``currency``. A page (offset/limit) is taken in
    (createdAt, instrumentId) order so it is stable between calls.
    """
    cols = [F.col("instrumentId").alias("assetId"), "symbol", "name",
            F.col("instrumentClass").alias("class" if tool else "instrumentClass"), "region"]
    if tool:
        cols.append("currency")
    rows = active(instruments)
    if offset or limit is not None:
        rows = rows.orderBy(*_order_cols(rows))
        if offset:
            rows = rows.offset(offset)
        if limit is not None:
            rows = rows.limit(limit)
    return rows.select(*cols)


def instruments_by_class(instruments: DataFrame, limit: int | None = None,
                         classes: DataFrame | None = None) -> DataFrame:
    """Active instruments of each class, all or the first ``limit`` of each.

    With a limit it is a per-class top-N: Spark plans it as a partial ``WindowGroupLimit`` so a
    large class forwards at most ``limit`` rows per map task.
    """
    rows = active(instruments)
    if classes is not None:
        rows = rows.join(classes.distinct(), "instrumentClass", "left_semi")
    if limit is None:
        return rows
    w = Window.partitionBy("instrumentClass").orderBy(*_order_cols(rows))
    return (rows.withColumn("_rn", F.row_number().over(w))
            .filter(F.col("_rn") <= limit).drop("_rn"))


def inactive_instruments(instruments: DataFrame) -> DataFrame:
    """Every soft-deleted instrument (current state)."""
    return instruments.filter(~F.col("isActive"))


def lookup_instruments(refs: DataFrame, instruments: DataFrame, ref_col: str = "ref",
                       by_symbol: bool = True) -> DataFrame:
    """Active instrument by id, else by exact symbol; misses kept with nulls.

    ``refs`` has a string column ``ref_col``; output keeps every ref row and
    adds the instrument's columns (null on a miss). Ids and symbols go into
    one keyed table (an id outranks a symbol with the same text), so the
    references -- the large side -- are joined, and shuffled, once.
    """
    act = active(instruments)
    cols = list(act.columns)
    inst = F.struct(*cols)
    keyed = act.select(F.col("instrumentId").alias("_k"), F.lit(0).alias("_prio"),
                       inst.alias("_inst"))
    if by_symbol:
        keyed = keyed.unionByName(act.select(F.col("symbol").alias("_k"), F.lit(1).alias("_prio"),
                                             inst.alias("_inst")))
        keyed = keyed.groupBy("_k").agg(F.min_by("_inst", "_prio").alias("_inst"))
    else:
        keyed = keyed.drop("_prio")
    hit = refs.join(keyed, refs[ref_col] == keyed["_k"], "left")
    keep = list(refs.columns)
    return hit.select(*keep, *[F.col(f"_inst.{c}").alias(c) for c in cols])


def list_sources(sources: DataFrame) -> DataFrame:
    """Every source, four identifying columns."""
    return sources.select("dataSourceId", "providerName", "providerType", "description")


def lookup_sources(refs: DataFrame, sources: DataFrame, ref_col: str = "dataSourceId",
                   tool: bool = False) -> DataFrame:
    """Full source rows for the referenced ids (unknown ids drop out)."""
    rows = sources.join(refs.select(F.col(ref_col).alias("dataSourceId")).distinct(),
                        "dataSourceId", "left_semi")
    if tool:
        rows = rows.select("dataSourceId", "providerName", "providerType",
                           "apiEndpoint", "description")
    return rows


def instrument_attributes(attributes: DataFrame, keys: DataFrame) -> DataFrame:
    """Every attribute row of the instruments in ``keys``."""
    return attributes.join(keys.select("instrumentId").distinct(), "instrumentId", "left_semi")


def sources_for_instrument(series: DataFrame, sources: DataFrame,
                           keys: DataFrame | None = None) -> DataFrame:
    """Per instrument, the source rows that have series data for it.

    ``distinct`` on the pair is a partial aggregate, so a hot instrument
    contributes one row per (task, source) to the shuffle.
    """
    pairs = series.select("instrumentId", "dataSourceId")
    if keys is not None:
        pairs = pairs.join(keys.select("instrumentId").distinct(), "instrumentId", "left_semi")
    return pairs.distinct().join(sources, "dataSourceId")


def instrument_details(instruments: DataFrame, attributes: DataFrame, series: DataFrame,
                       sources: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Active instrument + its attributes + the sources having data for it.

    Arrays are bounded by the attributes and sources of one instrument (not
    by its series rows): series are reduced to distinct pairs first.
    """
    inst = active(instruments)
    if keys is not None:
        inst = inst.join(keys.select("instrumentId").distinct(), "instrumentId", "left_semi")
    attr_cols = [c for c in attributes.columns if c != "instrumentId"]
    attrs = attributes.groupBy("instrumentId").agg(
        F.sort_array(F.collect_list(F.struct(*attr_cols))).alias("attributes"))
    srcs = sources_for_instrument(series, sources)
    src_cols = [c for c in srcs.columns if c != "instrumentId"]
    srcs = srcs.groupBy("instrumentId").agg(
        F.sort_array(F.collect_list(F.struct(*src_cols))).alias("dataSources"))
    empty = F.array()
    return (inst.join(attrs, "instrumentId", "left").join(srcs, "instrumentId", "left")
            .withColumn("attributes", F.coalesce("attributes", empty.cast(attrs.schema["attributes"].dataType)))
            .withColumn("dataSources", F.coalesce("dataSources", empty.cast(srcs.schema["dataSources"].dataType))))


def compare_instruments(requests: DataFrame, instruments: DataFrame, by_symbol: bool = True,
                        request_col: str = "requestId", refs_col: str | None = None
                        ) -> tuple[DataFrame, DataFrame]:
    """Identifying columns of the instruments named by each request.

    ``requests`` is either long form (request_col, position, ref) or, with
    ``refs_col`` set, one row per request holding an array of references
    (exploded with its positions). Input order and repeats are kept (the
    ``position`` column), misses are dropped. Requests with fewer than two
    references go to the second DataFrame (rejects) instead.
    Returns (comparison, rejects).
    """
    too_few = F.lit("at least 2 instrument references required").alias("reject_reason")
    if refs_col is not None:
        # the array tells its size, so nothing is counted or joined
        refs = F.coalesce(F.size(refs_col), F.lit(0))
        ok = requests.filter(refs >= 2).select(
            request_col, F.posexplode(refs_col).alias("position", "ref"))
        rejects = requests.filter(refs < 2).select(request_col, too_few)
    else:
        sizes = requests.groupBy(request_col).agg(F.count(F.lit(1)).alias("_refs"))
        ok = (join_null_safe(requests, sizes, [request_col])
              .filter(F.col("_refs") >= 2).drop("_refs"))
        rejects = sizes.filter(F.col("_refs") < 2).select(request_col, too_few)
    found = lookup_instruments(ok, instruments, "ref", by_symbol=by_symbol)
    comparison = found.filter(F.col("instrumentId").isNotNull()).select(
        request_col, "position", "ref", "instrumentId", "symbol", "name",
        F.col("instrumentClass").alias("class"), "region")
    return comparison, rejects


def portfolio_holdings(holdings: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Every holding of the portfolios in ``keys`` (all when None), with
    the portfolio's holding count; holdings without a portfolio count as one
    group. No validity filter, as in the reference."""
    rows = holdings
    if keys is not None:
        rows = rows.join(keys.select("portfolioId").distinct(), "portfolioId", "left_semi")
    counts = rows.groupBy("portfolioId").agg(F.count(F.lit(1)).alias("holdingCount"))
    return join_null_safe(rows, counts, ["portfolioId"])


def source_status(sources: DataFrame, series: DataFrame) -> DataFrame:
    """O31: 'Active' for a source with any series row, else 'No data'."""
    used = series.select("dataSourceId").distinct().withColumn("_used", F.lit(True))
    return (sources.join(used, "dataSourceId", "left")
            .select("dataSourceId", "providerName", "providerType",
                    F.when(F.col("_used"), "Active").otherwise("No data").alias("status")))
