"""Per-(instrument, source) series queries: range, latest, statistics, trend.

Every operator answers for all pairs in one job. ``keys`` (optional) narrows
to a DataFrame of wanted pairs or instruments through a semi join.

Scale notes
-----------
* Without a row cap (the default) every row counts. Counts, sums and extremes are partial
  aggregates; medians come from one count per (pair, price) and, for hot pairs, distributed
  rank selection, so no task sorts or holds a hot pair's prices. The trend's "newest N" part
  is a top-N per pair, planned as a partial ``WindowGroupLimit``.
* An explicit row cap is a ``row_number() <= cap`` filter, also a partial
  ``WindowGroupLimit`` where Spark's threshold allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickvault.functions.columns import EXACT, exact_mean

PAIR = ("instrumentId", "dataSourceId")

# Rank selection of a hot pair's median: ranges per round, their search steps, rounds.
RANGES, RANGE_STEP, RANGE_ROUNDS = 256, 16, 2
ROWS_PER_RANGE = 1_000_000
# At most so many pairs are split: the bound of the broadcasts of their intervals and cuts (2 KB
# a pair). Any further pair holds less than 1 / MAX_HOT_PAIRS of all rows.
MAX_HOT_PAIRS = 10_000


def _newest_first(partition=PAIR):
    return Window.partitionBy(*partition).orderBy(
        F.col("dataTimestamp").desc(), F.col("seriesId").desc())


def narrow(df: DataFrame, keys: DataFrame | None) -> DataFrame:
    """Keep rows whose key columns (those of ``keys``) appear in ``keys``."""
    if keys is None:
        return df
    return df.join(keys.distinct(), on=list(keys.columns), how="left_semi")


def in_range(series: DataFrame, start=None, end=None) -> DataFrame:
    """Inclusive timestamp range; either bound may be omitted."""
    ts = F.col("dataTimestamp")
    if start is not None:
        series = series.filter(ts >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        series = series.filter(ts <= F.lit(end).cast("timestamp_ntz"))
    return series


def cap_newest(series: DataFrame, cap: int | None) -> DataFrame:
    """At most ``cap`` newest rows per pair (all rows when cap is None)."""
    if cap is None:
        return series
    if cap <= 0:
        raise ValueError("row cap must be positive")
    return (series.withColumn("_rn", F.row_number().over(_newest_first()))
            .filter(F.col("_rn") <= cap).drop("_rn"))


def series_range(series: DataFrame, start=None, end=None, limit: int | None = None,
                 keys: DataFrame | None = None) -> DataFrame:
    """Rows per pair in [start, end], all of them, or with ``limit`` the newest
    so many, numbered from the newest."""
    rows = in_range(narrow(series, keys), start, end)
    if limit is None:
        return rows
    return (rows.withColumn("rowNumber", F.row_number().over(_newest_first()))
            .filter(F.col("rowNumber") <= limit))


def latest_price(series: DataFrame, keys: DataFrame | None = None,
                 columns: tuple[str, ...] = ("seriesId", "dataTimestamp", "open", "high",
                                              "low", "close", "volume", "dataQuality")
                 ) -> DataFrame:
    """Newest row per pair (ties on timestamp broken by seriesId).

    ``max_by`` over a struct is an ordinary aggregate: it is combined
    map-side, so a hot pair costs one partial row per task.
    """
    rows = narrow(series, keys)
    newest = F.max_by(F.struct(*columns), F.struct("dataTimestamp", "seriesId"))
    return (rows.groupBy(*PAIR).agg(newest.alias("_latest"))
            .select(*PAIR, "_latest.*"))


def indicators(series: DataFrame) -> Column:
    """All numbers of a series row by name: the typed columns that are not null, and ``extras``."""
    typed = [c for c in ("open", "high", "low", "close", "volume") if c in series.columns]
    pairs = [x for c in typed for x in (F.lit(c), F.col(c).cast("double"))]
    numbers = F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())
    if "extras" not in series.columns:
        return numbers
    extras = F.map_filter("extras", lambda k, v: ~k.isin(*typed)) if typed else F.col("extras")
    return F.map_concat(numbers, F.coalesce(extras, F.create_map().cast("map<string,double>")))


def latest_indicators(series: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """O32 with every indicator: the newest row per pair as ``timestamp``, ``indicators`` (numbers by
    name), ``texts`` (values that are not numbers; null where the series has none) and ``dataQuality``."""
    texts = F.col("texts") if "texts" in series.columns else F.lit(None).cast("map<string,string>")
    rows = narrow(series, keys)
    answer = F.struct(F.col("dataTimestamp").alias("timestamp"), indicators(series).alias("indicators"),
                      texts.alias("texts"), "dataQuality")
    newest = F.max_by(answer, F.struct("dataTimestamp", "seriesId"))
    return rows.groupBy(*PAIR).agg(newest.alias("_latest")).select(*PAIR, "_latest.*")


def _close_rows(series, start, end, row_cap, keys):
    # Cap first, then drop rows without a close (the reference's order).
    rows = cap_newest(in_range(narrow(series, keys), start, end), row_cap)
    return rows.filter(F.col("close").isNotNull())


def _join_pairs(left: DataFrame, right: DataFrame, how: str = "inner", small: bool = False) -> DataFrame:
    """Null-safe join on the pair; ``small`` marks a right side of at most ``MAX_HOT_PAIRS`` rows."""
    other = right.select(*[F.col(c).alias(f"_{c}") if c in PAIR else F.col(c) for c in right.columns])
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in PAIR]
    return left.join(F.broadcast(other) if small else other, same[0] & same[1], how).drop(*[f"_{c}" for c in PAIR])


def _range_of(close: Column, cuts: Column) -> Column:
    """How many of the sorted ``cuts`` lie below ``close``, in steps of ``RANGE_STEP``."""
    below = lambda a: F.size(F.filter(a, lambda x: x < close))
    coarse = F.filter(cuts, lambda x, i: (i + 1) % RANGE_STEP == 0)
    skipped = below(coarse) * RANGE_STEP
    return skipped + below(F.slice(cuts, skipped + 1, RANGE_STEP))


def _inside() -> Column:
    return ((F.col("_lo").isNull() | (F.col("close") > F.col("_lo")))
            & (F.col("_hi").isNull() | (F.col("close") <= F.col("_hi"))))


def _narrowed(prices: DataFrame, state: DataFrame) -> DataFrame:
    """One round of rank selection over the pairs of ``state`` (pair, _n, _lo, _hi, _below): its
    interval of closes, cut at quantiles into ranges, is replaced by the ranges that hold the
    two middle ranks. Only the counts of ranges are summed up in order, never prices."""
    rows = _join_pairs(prices, state, small=True).filter(_inside())
    # _c is always positive: naming it lets Spark read the one shuffle of prices again.
    cuts = rows.groupBy(*PAIR).agg(F.array_distinct(F.percentile_approx(
        F.when(F.col("_c") > 0, F.col("close")), [i / RANGES for i in range(1, RANGES)], 16 * RANGES)).alias("_cuts"))
    placed = _join_pairs(rows, cuts, small=True)
    counts = (placed.groupBy(*PAIR, _range_of(F.col("close"), F.col("_cuts")).alias("_r"))
              .agg(F.sum("_c").alias("_c")))
    upto = F.sum("_c").over(Window.partitionBy(*PAIR).orderBy("_r"))
    at = _join_pairs(_join_pairs(counts.withColumn("_sum", upto), state, small=True), cuts, small=True)
    before, upto = F.col("_below") + F.col("_sum") - F.col("_c"), F.col("_below") + F.col("_sum")
    lower, upper = F.floor((F.col("_n") + 1) / 2), F.floor((F.col("_n") + 2) / 2)
    middle = at.filter((upto >= lower) & (before < upper)).groupBy(*PAIR).agg(
        F.max("_n").alias("_n"), F.min(before).alias("_below"),
        F.min_by(F.coalesce(F.get("_cuts", F.col("_r") - 1), F.col("_lo")), "_r").alias("_lo"),
        F.max_by(F.coalesce(F.get("_cuts", F.col("_r")), F.col("_hi")), "_r").alias("_hi"))
    return middle.select(*PAIR, "_n", "_lo", "_hi", "_below")


def _hot_pairs(rows: DataFrame, rows_per_range: int) -> DataFrame | None:
    """Pairs with over ``rows_per_range`` rows and their counts, or None. One count per pair while
    the query is built; at most the ``MAX_HOT_PAIRS`` largest come to the driver."""
    sizes = rows.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("_n"))
    large = sizes.filter(F.col("_n") > rows_per_range)
    found = large.orderBy(F.desc("_n"), *PAIR).limit(MAX_HOT_PAIRS).collect()
    return rows.sparkSession.createDataFrame(found, large.schema) if found else None


def _with_ranks(prices: DataFrame, *part: str) -> DataFrame:
    """Running counts over the sorted prices of each pair (and further columns ``part``)."""
    pair = Window.partitionBy(*PAIR, *part)
    up = pair.orderBy("close").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return prices.withColumn("_upto", F.sum("_c").over(up)).withColumn("_sum", F.sum("_c").over(pair))


def _middle(n: Column) -> list[Column]:
    """The closes at the ranks floor((n + 1) / 2) and floor((n + 2) / 2) of ``_with_ranks``."""
    at = lambda rank: F.max(F.when((F.col("_upto") >= rank) & (F.col("_upto") - F.col("_c") < rank), F.col("close")))
    return [at(F.floor((n + 1) / 2)).alias("_lower"), at(F.floor((n + 2) / 2)).alias("_upper")]


def _price_stats(rows: DataFrame, rows_per_range: int | None) -> DataFrame:
    """Per pair: count, minPrice, maxPrice, avgPrice, the two middle closes ``_lower`` and
    ``_upper``, and the first and last close by time.

    Closes are counted per (pair, price), which are spread by both, and a pair's prices are
    sorted for the middle. Where a pair has over ``rows_per_range`` rows, its prices are not sorted:
    ``RANGE_ROUNDS`` rounds of rank selection find the range that holds the middle, some
    2 / 256^2 of them, and only that range is; the rest are partial aggregates of the rows.
    None says that no pair is large: none is counted.
    """
    by_time, close = F.struct("dataTimestamp", "seriesId"), F.col("close")
    hot = None if rows_per_range is None else _hot_pairs(rows, rows_per_range)
    if hot is None:
        prices = rows.groupBy(*PAIR, "close").agg(
            F.count(F.lit(1)).alias("_c"), F.try_sum(close.try_cast(EXACT)).alias("_exact"),
            F.min(by_time).alias("_first"), F.max(by_time).alias("_last"))
        fits = F.count("_exact") == F.count(F.lit(1))
        total = F.coalesce(F.when(fits, F.try_sum("_exact").cast("double")), F.sum(close * F.col("_c")))
        return _with_ranks(prices).groupBy(*PAIR).agg(
            F.sum("_c").alias("count"), F.min(close).alias("minPrice"), F.max(close).alias("maxPrice"),
            (total / F.sum("_c")).alias("avgPrice"), *_middle(F.col("_sum")),
            F.min_by(close, "_first").alias("_earliest"), F.max_by(close, "_last").alias("_latest"))
    prices = rows.groupBy(*PAIR, "close").agg(F.count(F.lit(1)).alias("_c"))
    nul = F.lit(None).cast("double")
    state = hot.select(*PAIR, "_n", nul.alias("_lo"), nul.alias("_hi"), F.lit(0).cast("bigint").alias("_below"))
    for _ in range(RANGE_ROUNDS):
        state = _narrowed(prices, state)
    held = _join_pairs(prices, state, "left", small=True).withColumn("_split", F.col("_n").isNotNull())
    ranked = _with_ranks(held.filter(~F.col("_split") | _inside()), "_split")
    ranked = ranked.withColumn("_upto", F.col("_upto") + F.coalesce("_below", F.lit(0)))
    middle = ranked.groupBy(*PAIR).agg(*_middle(F.coalesce("_n", "_sum")))
    whole = rows.groupBy(*PAIR).agg(
        F.count(close).alias("count"), F.min(close).alias("minPrice"), F.max(close).alias("maxPrice"),
        exact_mean(close).alias("avgPrice"), F.min_by(close, by_time).alias("_earliest"),
        F.max_by(close, by_time).alias("_latest"))
    return _join_pairs(whole, middle)


def series_stats(series: DataFrame, start=None, end=None, row_cap: int | None = None,
                 order: str = "value", keys: DataFrame | None = None,
                 median: str = "exact", accuracy: int = 10_000,
                 rows_per_range: int | None = ROWS_PER_RANGE) -> DataFrame:
    """Count, min, max, mean, true median, first, last, change, % change.

    All rows of a pair count unless ``row_cap`` keeps only the newest. ``order="value"``
    keeps the reference's behaviour: prices are sorted by value, so first = min and
    last = max. ``order="time"`` gives the chronologically first and last close instead.
    ``median="approx"`` takes ``percentile_approx`` (relative rank error 1/accuracy).
    """
    if median not in ("exact", "approx"):
        raise ValueError("median must be 'exact' or 'approx'")
    if order not in ("value", "time"):
        raise ValueError("order must be 'value' or 'time'")
    rows = _close_rows(series, start, end, row_cap, keys)
    agg = _price_stats(rows, rows_per_range).withColumn("medianPrice", F.col("_lower") * 0.5 + F.col("_upper") * 0.5)
    if median == "approx":
        near = rows.groupBy(*PAIR).agg(F.percentile_approx("close", 0.5, accuracy).alias("medianPrice"))
        agg = _join_pairs(agg.drop("medianPrice"), near)
    first, last = ("minPrice", "maxPrice") if order == "value" else ("_earliest", "_latest")
    agg = agg.withColumn("firstPrice", F.col(first)).withColumn("lastPrice", F.col(last))
    change = F.col("lastPrice") - F.col("firstPrice")
    return agg.select(
        *PAIR, "count", "minPrice", "maxPrice", "avgPrice", "medianPrice", "firstPrice", "lastPrice",
        change.alias("priceChange"),
        F.when(F.col("firstPrice") != 0, change / F.col("firstPrice") * 100)
        .otherwise(F.lit(0.0)).alias("percentChange"))


def series_stats_tool(series: DataFrame, start=None, end=None,
                      row_cap: int | None = None, keys: DataFrame | None = None,
                      rows_per_range: int | None = ROWS_PER_RANGE) -> DataFrame:
    """The tool variant: *upper* median, volatility = max - min."""
    agg = _price_stats(_close_rows(series, start, end, row_cap, keys), rows_per_range)
    spread = F.col("maxPrice") - F.col("minPrice")
    return agg.select(
        *PAIR, "count", "minPrice", "maxPrice", "avgPrice", F.col("_upper").alias("medianPrice"),
        F.col("minPrice").alias("firstPrice"), F.col("maxPrice").alias("lastPrice"),
        spread.alias("priceChange"), spread.alias("volatility"))


def _trend_columns(n: Column, recent_sum: Column, older_sum: Column, days: int,
                   hi: Column, lo: Column) -> list[Column]:
    recent = recent_sum / F.least(F.lit(days).cast("bigint"), n)
    # The reference divides the (empty) older slice by max(1, n - days): 0.
    older = F.when(n > days, older_sum / (n - days)).otherwise(F.lit(0.0))
    enough = n >= 2
    trend = (F.when(~enough, F.lit("insufficient"))
             .when(recent > older, "upward").when(recent < older, "downward")
             .otherwise("stable"))
    change = F.when(older > 0, (recent - older) / older * 100).otherwise(F.lit(0.0))
    return [
        n.alias("count"),
        trend.alias("trend"),
        F.when(enough, recent).alias("recentAvg"),
        F.when(enough, older).alias("olderAvg"),
        F.when(enough, change).alias("changePercent"),
        F.when(enough, hi - lo).alias("volatility"),
    ]


def trend(series: DataFrame, days: int = 30, row_cap: int | None = None,
          keys: DataFrame | None = None) -> DataFrame:
    """Mean of the newest ``days`` closes vs the mean of the older ones.

    ``days`` counts rows, as in the reference, and every row of a pair counts unless
    ``row_cap`` keeps only the newest. Pairs with fewer than two closes report trend
    'insufficient', pairs without any close a count of 0.
    """
    if days <= 0:
        raise ValueError("days must be positive")
    close = F.col("close")
    rows = cap_newest(narrow(series, keys), row_cap)
    exact = close.try_cast(EXACT)

    def sums(prefix: str) -> list[Column]:
        fits = F.count(exact) == F.count(close)
        return [F.count(close).alias(f"{prefix}n"), F.when(fits, F.try_sum(exact)).alias(f"{prefix}exact"),
                F.sum(close).alias(f"{prefix}sum")]

    # Only a pair's newest `days` closes are ranked (a partial WindowGroupLimit). The older
    # ones are the whole pair without those: exact decimals, or doubles where a sum does not fit.
    recent = (rows.filter(close.isNotNull()).withColumn("_pos", F.row_number().over(_newest_first()))
              .filter(F.col("_pos") <= days).groupBy(*PAIR).agg(*sums("_r_")))
    whole = rows.groupBy(*PAIR).agg(*sums("_"), F.max(close).alias("_hi"), F.min(close).alias("_lo"))
    both = _join_pairs(whole, recent, "left")
    older = F.coalesce(F.try_subtract("_exact", "_r_exact").cast("double"), F.col("_sum") - F.col("_r_sum"))
    return both.select(*PAIR, *_trend_columns(
        F.col("_n"), F.coalesce(F.col("_r_exact").cast("double"), F.col("_r_sum")), older, days, F.col("_hi"), F.col("_lo")))


def stats_and_trend(series: DataFrame, days: int = 30, keys: DataFrame | None = None) -> DataFrame:
    """O33 (value order) and O35 side by side for every pair that has a close."""
    stats, found = series_stats(series, keys=keys), trend(series, days, keys=keys).drop("count")
    return _join_pairs(stats, found)
