"""Temporal operators: version fold (soft delete / restore), current view, as-of.

Versions are half-open ``[validFrom, validTo)``: at any instant exactly one
version of a key is valid (after its registration).

Skew
----
Both the version fold and the as-of join need "the previous/next row of the
same key". A plain ``Window.partitionBy(key)`` would sort a hot key (say a
third of all changes) inside one task. Instead a hot key's rows are cut into
buckets by rank (``split_hot``): at quantiles of their times, an instant that
many rows share being a bucket of its own, which is cut again by sequence number.
The windows run per (key, bucket). An ordinary key is one bucket and needs
nothing else. For the few
hot keys, the values that cross a bucket edge come from one summary row per
bucket (a partial aggregate over hot keys only) carried by a per-key window over
those rows. A hot key is spread over as many tasks as its size
needs, cold rows are shuffled once, and no step emits pairs of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickvault.functions.columns import iso_text

ROWS_PER_BUCKET = 1_000_000
# At most so many keys, the largest, are split: the bound of the broadcasts of their cuts (2 KB a
# key); any other key holds less than 1 / MAX_HOT_KEYS of all rows. In the same way, a bucket is
# cut again only if it holds over 1 / MAX_HOT_BUCKETS of the hot rows.
MAX_HOT_KEYS = 20_000
MAX_HOT_BUCKETS = 500_000
# Quantiles of a hot key's times, and the step in which they are searched.
CUTS, CUT_STEP = 256, 16


def hot_keys(df: DataFrame, key: str, rows_per_bucket: int, *extra: Column) -> DataFrame | None:
    """Keys with over ``rows_per_bucket`` rows, with their row count ``_n`` and ``extra`` aggregates,
    or None. One count per key while the query is built, so that tables without such a key get
    a plan without them; at most the ``MAX_HOT_KEYS`` largest come to the driver."""
    large = df.groupBy(key).agg(*extra, F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > rows_per_bucket)
    found = large.orderBy(F.desc("_n"), key).limit(MAX_HOT_KEYS).collect()
    return df.sparkSession.createDataFrame(found, large.schema) if found else None


def _micros(ts: str) -> Column:
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(ts).cast("timestamp_ntz"))


def _below(cuts: Column, steps: Column, value: Column) -> Column:
    """How many of the sorted ``cuts`` are less than ``value``; ``steps`` holds each of their ``CUT_STEP``-th."""
    count = lambda a: F.size(F.filter(a, lambda x: x < value))
    skipped = count(steps) * CUT_STEP
    return skipped + count(F.slice(cuts, skipped + 1, CUT_STEP))


def split_hot(df: DataFrame, hot: DataFrame | None, key: str, ts: str, seq: str, rows_per_bucket: int,
              kind: str | None = None) -> DataFrame:
    """Add ``_hot`` and ``_b``: buckets of about ``rows_per_bucket`` rows of each key of ``hot``
    (``hot_keys``, whose columns are added too), 0 for other keys and where it is None. Buckets follow the order of
    (ts, kind, seq): ``kind`` (0 or 1) comes before ``seq`` at one instant, and rows of kind 1
    have no order among themselves there.

    A key's times are cut at 255 quantiles. Instants at a cut are buckets of their own, so one
    that many rows share is set apart; then each bucket that is still too large is cut into
    equal spans: of its times, or at a single instant of its sequence numbers (for kind 1, of
    hashes). Only rows that agree in all of the order cannot be parted.
    """
    if hot is None:
        return df.withColumn("_hot", F.lit(False)).withColumn("_b", F.lit(0).cast("bigint"))
    micros = _micros(ts)
    named = hot.withColumnRenamed(key, "_key")
    rows = df.join(F.broadcast(named), F.col(key) == F.col("_key"), "left").withColumn("_hot", F.col("_key").isNotNull())
    cuts = (df.join(F.broadcast(hot.select(key)), key, "left_semi").groupBy(F.col(key).alias("_cutKey"))
            .agg(F.array_distinct(F.percentile_approx(micros, [i / CUTS for i in range(1, CUTS)], 16 * CUTS)).alias("_cuts"))
            .withColumn("_steps", F.filter("_cuts", lambda x, i: (i + 1) % CUT_STEP == 0)))

    def placed(rows: DataFrame) -> DataFrame:
        rows = rows.join(F.broadcast(cuts), F.col(key) == F.col("_cutKey"), "left")
        # Passing the place through a one-element inline (a Generate) searches it once a row, not
        # again in each expression below that names it.
        rows = rows.select("*", F.inline(F.array(F.struct(_below(F.col("_cuts"), F.col("_steps"), micros).alias("_below")))))
        below = F.col("_below")
        instant = F.coalesce(F.get("_cuts", below) == micros, F.lit(False))
        last = F.lit(0) if kind is None else F.col(kind)
        order = F.when(~instant, micros).when(last == 0, F.col(seq).try_cast("bigint")).otherwise(
            F.pmod(F.xxhash64(*df.columns), F.lit(1 << 20)))
        return (rows.withColumn("_b1", F.coalesce(3 * below + F.when(instant, 1 + last).otherwise(0), F.lit(-1)).cast("bigint"))
                .withColumn("_o", F.coalesce(order, F.lit(0)).cast("bigint")))

    total = hot.select(F.sum("_n")).scalar()
    large = (placed(df.join(F.broadcast(hot.select(key)), key, "left_semi"))
             .groupBy(F.col(key).alias("_bKey"), F.col("_b1").alias("_bb"))
             .agg(F.count(F.lit(1)).alias("_bn"), F.min("_o").alias("_o0"), F.max("_o").alias("_o1"))
             .filter((F.col("_bn") > rows_per_bucket) & (F.col("_bn") * MAX_HOT_BUCKETS > total)))
    rows = placed(rows).join(F.broadcast(large), (F.col(key) == F.col("_bKey")) & (F.col("_b1") == F.col("_bb")), "left")
    # micros x spans can pass 64 bits, and a double would not keep the order of neighbours
    wide = lambda c: c.cast("decimal(20,0)")
    spans = F.ceil(F.col("_bn") / F.lit(rows_per_bucket))
    span = F.floor((wide(F.col("_o")) - wide(F.col("_o0"))) * spans.cast("decimal(12,0)")
                   / (wide(F.col("_o1")) - wide(F.col("_o0")) + 1)).cast("bigint")
    bucket = F.when(F.col("_hot"), F.col("_b1") * F.lit(1 << 40) + F.coalesce(span, F.lit(0).cast("bigint")))
    return (rows.withColumn("_b", F.coalesce(bucket, F.lit(0).cast("bigint")))
            .drop("_key", "_cutKey", "_cuts", "_steps", "_below", "_b1", "_o", "_bKey", "_bb", "_bn", "_o0", "_o1", "_n"))


def apply_changes(feed: DataFrame, key: str = "instrumentId", ts: str = "ts",
                  seq: str = "event_id", op: str = "op", reason: str | None = "reason",
                  default_reason: str = "user_requested", recorded: str | None = None,
                  rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Fold a register / delete / restore change feed into versions.

    Rules: the first register of a key wins; changes before it and later
    registers are dropped; a delete of an inactive key and a restore of an
    active key are no-ops and dropped. After any op the state is fixed by the
    op alone (delete -> inactive, otherwise active), so an op is kept exactly
    when the previous raw op left the other state; kept ops alternate
    between active and inactive, so a version ends at the first later op of
    the other state.

    Output: one row per version with validFrom, validTo (next version's
    start, null for the current one), isActive, deletionMarker
    ``DELETED_<iso time>_<reason>`` on delete versions, the op and its
    sequence number, transactionStart (when the change was recorded:
    ``recorded`` column, else its own time) and validToRecordedAt (when the
    version's end became known).

    One shuffle, by (key, time bucket), and one sorted pass yield per op its
    eligibility (first register from a whole-partition window, or from the
    broadcast hot-key table), the previous eligible op's state and the next
    eligible op of either state. Only hot keys span buckets; their edge values
    come from a per-bucket summary. There is no join with a
    per-key table as large as the key set.
    """
    order_key = F.struct(ts, seq)
    is_reg = F.col(op) == "register"

    def eligible(first: Column) -> Column:
        # at or after the key's first register; later registers are no-ops
        return first.isNotNull() & (order_key >= first) & (~is_reg | (order_key == first))

    # Keys large enough to need several buckets -- at most MAX_HOT_KEYS of
    # them -- with their first register, broadcast. Every
    # other key is one bucket and finds its first register in its own window.
    hot = hot_keys(feed, key, rows_per_bucket, F.min(F.when(is_reg, order_key)).alias("_hfirst"))
    base = (split_hot(feed, hot, key, ts, seq, rows_per_bucket)
            .withColumn("_active", F.col(op) != "delete")
            .withColumn("_rec", F.col(recorded) if recorded else F.col(ts)))
    stamp = F.struct(F.col(ts).alias("t"), F.col("_rec").alias("r"))

    whole = Window.partitionBy(key, "_b")
    first = F.min(F.when(is_reg, order_key)).over(whole)
    if hot is not None:
        first = F.when(F.col("_hot"), F.col("_hfirst")).otherwise(first)
    rows = base.withColumn("_first", first).withColumn("_elig", eligible(F.col("_first")))
    on = F.when(F.col("_elig") & F.col("_active"), stamp)
    off = F.when(F.col("_elig") & ~F.col("_active"), stamp)
    w = Window.partitionBy(key, "_b").orderBy(ts, seq)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    # "the nearest later op" as a growing frame over the reversed order
    later = (Window.partitionBy(key, "_b").orderBy(F.col(ts).desc(), F.col(seq).desc())
             .rowsBetween(Window.unboundedPreceding, -1))
    local = rows.select(
        "*",
        F.last(F.when(F.col("_elig"), F.col("_active")), ignorenulls=True).over(before)
        .alias("_prev"),
        F.last(on, ignorenulls=True).over(later).alias("_nextOn"),
        F.last(off, ignorenulls=True).over(later).alias("_nextOff"))

    nul = F.lit(None)
    joined = (local.withColumn("_cPrev", nul.cast("boolean")).withColumn("_cOn", nul.cast(local.schema["_nextOn"].dataType))
              .withColumn("_cOff", nul.cast(local.schema["_nextOff"].dataType)))
    if hot is not None:
        # Hot keys span several buckets. Their buckets are summarised by a partial
        # aggregate over eligible hot rows (one row per bucket) and the values
        # crossing bucket edges are carried by a window over them. The rows already
        # lie by (key, bucket), so joining the carried values moves only those.
        by_order = F.struct(ts, seq)
        summary = (base.filter(F.col("_hot") & eligible(F.col("_hfirst")))
                   .groupBy(key, "_b").agg(
                       F.max_by("_active", by_order).alias("_endState"),
                       F.min_by(stamp, F.when(F.col("_active"), by_order)).alias("_firstOn"),
                       F.min_by(stamp, F.when(~F.col("_active"), by_order)).alias("_firstOff")))
        wb = Window.partitionBy(key).orderBy("_b")
        wb_later = Window.partitionBy(key).orderBy(F.col("_b").desc()).rowsBetween(
            Window.unboundedPreceding, -1)
        carry = summary.select(
            key, "_b",
            F.lag("_endState").over(wb).alias("_cPrev"),
            F.last("_firstOn", ignorenulls=True).over(wb_later).alias("_cOn"),
            F.last("_firstOff", ignorenulls=True).over(wb_later).alias("_cOff"))

        joined = local.join(carry, [key, "_b"], "left")
    prev = F.coalesce("_prev", "_cPrev")
    kept = joined.filter(F.col("_elig") & (prev.isNull() | (prev != F.col("_active"))))
    ends_at = F.when(F.col("_active"), F.coalesce("_nextOff", "_cOff")).otherwise(
        F.coalesce("_nextOn", "_cOn"))
    why = F.col(reason) if reason and reason in feed.columns else F.lit(None).cast("string")
    marker = F.when(F.col(op) == "delete", F.concat(
        F.lit("DELETED_"), iso_text(F.col(ts)), F.lit("_"), F.coalesce(why, F.lit(default_reason))))
    return kept.select(
        key,
        F.col(ts).alias("validFrom"),
        ends_at["t"].alias("validTo"),
        F.col("_active").alias("isActive"),
        marker.alias("deletionMarker"),
        F.col(op).alias("op"),
        F.col(seq).alias(seq),
        F.col("_rec").alias("transactionStart"),
        ends_at["r"].alias("validToRecordedAt"),
    )


def current_versions(versions: DataFrame) -> DataFrame:
    """The current version of every key (the open-ended one)."""
    return versions.filter(F.col("validTo").isNull())


def inactive_current(versions: DataFrame) -> DataFrame:
    """O18 over the version table: keys whose current version is deleted."""
    return current_versions(versions).filter(~F.col("isActive"))


def as_of(versions: DataFrame, points: DataFrame, key: str = "instrumentId",
          at: str = "dataTimestamp", how: str = "inner", seq: str | None = "event_id",
          rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """For every point (key, time), the version valid at that time.

    Versions of a key must not overlap (true of ``apply_changes`` output);
    then the valid version is the last one starting at or before the point,
    provided it has not ended. Points and version starts are interleaved in
    one time-ordered stream per (key, bucket) and the latest version start
    is carried forward -- a sort, never a pairing of points with versions.
    ``how="left"`` keeps unmatched points with null version columns.
    """
    vcols = [c for c in versions.columns if c != key]
    pcols = [c for c in points.columns if c != key]
    vtype = versions.select(F.struct(*vcols).alias("v")).schema["v"].dataType
    ptype = points.select(F.struct(*pcols).alias("p")).schema["p"].dataType
    tie = F.col(seq) if seq and seq in versions.columns else F.lit(0).cast("long")
    vrows = versions.select(key, F.col("validFrom").alias("_t"), F.lit(0).alias("_kind"),
                            tie.cast("long").alias("_seq"), F.struct(*vcols).alias("_v"),
                            F.lit(None).cast(ptype).alias("_p"))
    prows = points.select(key, F.col(at).alias("_t"), F.lit(1).alias("_kind"),
                          F.lit(0).cast("long").alias("_seq"),
                          F.lit(None).cast(vtype).alias("_v"), F.struct(*pcols).alias("_p"))
    # Versions and points of a key count together, and a burst of either at one instant is parted.
    rows = vrows.filter(F.col("_t").isNotNull()).unionByName(prows)
    hot = hot_keys(rows, key, rows_per_bucket)
    rows = split_hot(rows, hot, key, "_t", "_seq", rows_per_bucket, kind="_kind")
    order = ["_t", "_kind", "_seq"]
    w_in = (Window.partitionBy(key, "_b").orderBy(*order)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = rows.withColumn("_in", F.last("_v", ignorenulls=True).over(w_in))
    found = local.filter(F.col("_kind") == 1).withColumn("_hit", F.col("_in"))
    if hot is not None:
        # hot keys only: each bucket's latest version start (a partial aggregate, one row per
        # bucket), carried to later buckets
        summary = (rows.filter("_hot").groupBy(key, "_b").agg(
            F.max_by("_v", F.when(F.col("_kind") == 0, F.struct(*order))).alias("_end")))
        w_b = (Window.partitionBy(key).orderBy("_b")
               .rowsBetween(Window.unboundedPreceding, -1))
        carry = summary.select(key, "_b",
                               F.last("_end", ignorenulls=True).over(w_b).alias("_carry"))
        found = found.join(carry, [key, "_b"], "left").withColumn("_hit", F.coalesce("_in", "_carry"))
    valid = F.col("_hit").isNotNull() & (
        F.col("_hit.validTo").isNull() | (F.col("_t") < F.col("_hit.validTo")))
    if how == "inner":
        found = found.filter(valid)
    elif how == "left":
        found = found.withColumn("_hit", F.when(valid, F.col("_hit")))
    else:
        raise ValueError("how must be 'inner' or 'left'")
    return found.select(key, *[F.col(f"_p.{c}").alias(c) for c in pcols],
                        *[F.col(f"_hit.{c}").alias(c) for c in vcols])


def known_versions(feed: DataFrame, tx_time, recorded: str = "recordedAt", **kw) -> DataFrame:
    """Versions as the warehouse knew them at transaction time ``tx_time``: only changes
    recorded by then are folded, so a later record changes nothing that was known."""
    return apply_changes(feed.filter(F.col(recorded) <= F.lit(tx_time).cast("timestamp_ntz")),
                         recorded=recorded, **kw)


def as_of_bitemporal(feed: DataFrame, points: DataFrame, tx_time, recorded: str = "recordedAt", **kw) -> DataFrame:
    """O39 bitemporal: valid at each point's time, as known at ``tx_time``."""
    return as_of(known_versions(feed, tx_time, recorded), points, **kw)
