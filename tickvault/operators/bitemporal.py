"""As-of with a transaction time per point (O39): what was known then of what was valid then.

``as_of_bitemporal`` folds the feed once for one transaction time. Here every point brings its own,
and no point's answer is folded anew. Which version held at (valid time, transaction time) follows
from a few nearest changes among those recorded by the transaction time: the last restore and the
last delete at or before the valid time, the first ones after it, and the first register.

"The nearest change on the left that was recorded by then" is a search in two dimensions. All
changes and points of a key are ranked by valid time, and the ranks form a tree of four children
a node: two rows part at exactly one node, the one to a child further left than the other's. So in
every node, in the order of transaction time, running maxima over the changes of the first
children answer the points of those after them, and running minima the other way round. Each row
lies in one node of every level: rows x log4(rows of the key), in one shuffle. Only ranks are
carried through the tree; the changes that were found are looked up at the end.

Hot keys are split twice by ``split_hot``: by valid time for the ranking, and by transaction
time inside the nodes, whose buckets are summed up in one row each and carried to the next. A
node that cannot hold more rows than a bucket is left whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickvault.functions.columns import iso_text
from tickvault.operators.temporal import ROWS_PER_BUCKET, hot_keys, split_hot

# The node of all registers and points of a key, beside the levels of the tree.
REGISTERS = -1
# A node has 2 ** BITS children.
BITS = 2


def _ranked(rows: DataFrame, key: str, hot: DataFrame | None, rows_per_bucket: int) -> DataFrame:
    """Add ``_rank`` (from 0, by valid time within the key), ``_levels`` and ``_tb`` (buckets by
    transaction time, 0 for keys that are not hot)."""
    rows = split_hot(rows, hot, key, "_t", "_seq", rows_per_bucket, kind="_kind").withColumnRenamed("_b", "_xb")
    w = Window.partitionBy(key, "_xb")
    # rows that agree in all of the order are alike, so a task that runs again ranks the same way
    order = ["_t", "_kind", "_seq", "_known", F.xxhash64("_c", "_p")]
    rows = rows.withColumn("_rank", F.row_number().over(w.orderBy(*order)).cast("bigint") - 1)
    if hot is None:
        rows = rows.withColumn("_size", F.count(F.lit(1)).over(w))
    else:
        sizes = rows.groupBy(key, "_xb").agg(F.count(F.lit(1)).alias("_in"))
        before = Window.partitionBy(key).orderBy("_xb").rowsBetween(Window.unboundedPreceding, -1)
        places = sizes.select(key, "_xb", F.coalesce(F.sum("_in").over(before), F.lit(0)).alias("_before"),
                              F.sum("_in").over(Window.partitionBy(key)).alias("_size"))
        rows = rows.join(places, [key, "_xb"]).withColumn("_rank", F.col("_rank") + F.col("_before")).drop("_before")
    rows = (rows.withColumn("_levels", F.ceil(F.length(F.bin(F.col("_size") - 1)) / BITS).cast("int"))
            .drop("_xb", "_hot", "_size"))
    return split_hot(rows, hot, key, "_known", "_seq", rows_per_bucket, kind="_kind").withColumnRenamed("_b", "_tb")


def _child() -> Column:
    return F.call_function("shiftright", F.col("_rank"), F.col("_level") * BITS).bitwiseAND(F.lit(2 ** BITS - 1))


def _spread(rows: DataFrame, rows_per_bucket: int) -> DataFrame:
    """Add ``_node`` and ``_child`` (null in the node of registers) to rows that have ``_level``; nodes
    of at most ``rows_per_bucket`` ranks are no longer split by transaction time."""
    level, in_tree = F.col("_level"), F.col("_level") >= 0
    large = ~in_tree | (F.pow(F.lit(2.0), (level + 1) * BITS) > rows_per_bucket)
    node = F.when(in_tree, F.call_function("shiftright", F.col("_rank"), (level + 1) * BITS))
    return (rows.withColumn("_node", F.coalesce(node, F.lit(0).cast("bigint"))).withColumn("_child", F.when(in_tree, _child()))
            .withColumn("_hot", F.col("_hot") & large).withColumn("_tb", F.when(large, F.col("_tb")).otherwise(0)))


def _before(value: Column) -> dict[str, Column]:
    """``value`` of rows in a child before the k-th one, by k."""
    return {str(k): F.when(F.col("_child") < k, value) for k in range(1, 2 ** BITS)}


def _after(value: Column) -> dict[str, Column]:
    return {str(k): F.when(F.col("_child") > k, value) for k in range(2 ** BITS - 1)}


def _own(name: str) -> Column:
    """The one of the columns ``name`` + k that is of the row's own child."""
    return F.coalesce(*[F.when(F.col("_child") == k, F.col(f"{name}{k}")) for k in
                        (range(1, 2 ** BITS) if name.startswith("last") else range(2 ** BITS - 1))])


def _running(rows: DataFrame, nodes: list[str], wanted: dict[str, tuple[bool, Column]], hot: bool) -> DataFrame:
    """Running extremes of the changes within each of ``nodes``, up to each point's transaction
    time: ``wanted`` maps a name to (largest, value), null for points."""
    best = {True: F.max, False: F.min}
    w = (Window.partitionBy(*nodes, "_tb").orderBy("_known", "_kind")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = rows.select("*", *[best[up](v).over(w).alias(n) for n, (up, v) in wanted.items()])
    found = found.filter(F.col("_kind") == 1)
    if not hot:
        return found
    # every bucket that holds points needs the edge before it, also one without changes
    summary = (rows.filter(F.col("_hot")).groupBy(*nodes, "_tb")
               .agg(*[best[up](v).alias(n) for n, (up, v) in wanted.items()]))
    before = Window.partitionBy(*nodes).orderBy("_tb").rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(*nodes, "_tb", *[best[up](F.col(n)).over(before).alias(f"_e_{n}")
                                            for n, (up, _) in wanted.items()])
    found = found.join(carry, [*nodes, "_tb"], "left")
    merged = {True: F.greatest, False: F.least}
    for n, (up, _) in wanted.items():
        found = found.withColumn(n, merged[up](F.col(n), F.col(f"_e_{n}"))).drop(f"_e_{n}")
    return found


def as_of_bitemporal_points(feed: DataFrame, points: DataFrame, key: str = "instrumentId",
                            at: str = "dataTimestamp", known: str = "knownAt", ts: str = "ts",
                            seq: str = "event_id", op: str = "op", reason: str | None = "reason",
                            default_reason: str = "user_requested", recorded: str = "recordedAt",
                            how: str = "inner", rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """For every point (key, ``at``, ``known``) the version valid at ``at``, by the rules of
    ``apply_changes`` over the changes recorded by ``known``, with the columns of ``as_of``.
    validTo, like the rest, is what was known then.

    Changes and points with a null key or time match nothing; ``how="left"`` keeps such points,
    and all others without a version, with null version columns. Repeated points are answered
    each. Changes of a key must differ in (ts, seq). Points take any columns but maps and
    variants; a point column named like a version column gives two columns of that name.

    Ranked rows are checkpointed (``spark.checkpoint.dir``), as three later steps read them.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be 'inner' or 'left'")
    pcols = [c for c in points.columns if c != key]
    why = F.col(reason) if reason and reason in feed.columns else F.lit(None).cast("string")
    changes = feed.filter(F.col(key).isNotNull() & F.col(ts).isNotNull() & F.col(recorded).isNotNull())
    crows = changes.select(
        key, F.col(ts).alias("_t"), F.lit(0).alias("_kind"), F.col(seq).cast("long").alias("_seq"),
        F.col(recorded).alias("_known"),
        F.struct(F.col(ts).alias("t"), F.col(seq).alias("seq"), F.col(recorded).alias("rec"),
                 F.col(op).alias("op"), why.alias("why")).alias("_c"))
    ptype = points.select(F.struct(*pcols).alias("p")).schema["p"].dataType
    ctype = crows.schema["_c"].dataType
    prows = points.select(key, F.col(at).alias("_t"), F.lit(1).alias("_kind"), F.lit(0).cast("long").alias("_seq"),
                          F.col(known).alias("_known"), F.lit(None).cast(ctype).alias("_c"), F.struct(*pcols).alias("_p"))
    can_match = F.col(key).isNotNull() & F.col("_t").isNotNull() & F.col("_known").isNotNull()
    rows = crows.withColumn("_p", F.lit(None).cast(ptype)).unionByName(prows.filter(can_match))
    hot = hot_keys(rows, key, rows_per_bucket)
    rows = _ranked(rows, key, hot, rows_per_bucket).checkpoint()

    kind, change, rank = F.col("_kind"), F.col("_c"), F.col("_rank")
    register, off = change["op"] == "register", change["op"] == "delete"
    is_on, is_off = (kind == 0) & ~F.col("_off"), (kind == 0) & F.col("_off")
    # Nodes: registers meet all points in one, other changes meet points in the tree.
    tree = F.sequence(F.lit(0), F.col("_levels") - 1)
    levels = (F.when(kind == 1, F.concat(F.array(F.lit(REGISTERS)), tree))
              .when(register, F.array(F.lit(REGISTERS))).otherwise(tree))
    thin = [key, "_known", "_kind", "_rank", "_tb", "_hot", "_levels"]
    spread = _spread(rows.select(*thin, off.alias("_off"), F.explode(levels).alias("_level")), rows_per_bucket)
    wanted = {"first": (False, F.when((kind == 0) & (F.col("_level") == REGISTERS), rank))}
    for state, of_state in (("On", is_on), ("Off", is_off)):
        wanted |= {f"last{state}{k}": (True, v) for k, v in _before(F.when(of_state, rank)).items()}
        wanted |= {f"next{state}{k}": (False, v) for k, v in _after(F.when(of_state, rank)).items()}
    near = _running(spread, [key, "_level", "_node"], wanted, hot is not None)
    near = near.groupBy(key, "_rank").agg(
        *[F.max(_own(c)).alias(c) for c in ("lastOn", "lastOff")],
        *[F.min(_own(c)).alias(c) for c in ("nextOn", "nextOff")], F.min("first").alias("first"),
        F.first("_known").alias("_known"), F.first("_levels").alias("_levels"),
        *[F.max(F.when(F.col("_level") == REGISTERS, F.col(c))).alias(c) for c in ("_tb", "_hot")])
    # Changes before the first register count for nothing; the register itself is an "on". At one
    # instant changes rank before points.
    near = near.filter(F.col("first") < rank)
    for c in ("lastOn", "lastOff"):
        near = near.withColumn(c, F.when(F.col(c) > F.col("first"), F.col(c)))
    near = (near.withColumn("_on", F.col("lastOff").isNull() | F.coalesce(F.col("lastOn") > F.col("lastOff"), F.lit(False)))
            .withColumn("_end", F.when(F.col("_on"), F.col("nextOff")).otherwise(F.col("nextOn")))
            .withColumn("_edge", F.when(F.col("_on"), F.col("lastOff")).otherwise(F.coalesce("lastOn", "first"))))

    # The version starts at the first change of its state after the last one of the other state.
    asked = (near.filter(F.col("_edge").isNotNull())
             .select(key, "_known", F.lit(1).alias("_kind"), F.col("_edge").alias("_rank"), "_tb", "_hot", "_levels", "_on",
                     rank.alias("_point")))
    changed = rows.filter((kind == 0) & ~register).select(*thin, (~off).alias("_on"), F.lit(None).cast("bigint").alias("_point"))
    spread = (_spread(asked.unionByName(changed).withColumn("_level", F.explode(tree)), rows_per_bucket)
              .filter(F.col("_child") != F.when(kind == 0, 0).otherwise(2 ** BITS - 1)))
    start = _running(spread, [key, "_on", "_level", "_node"], {
        f"start{k}": (False, v) for k, v in _after(F.when(kind == 0, rank)).items()}, hot is not None)
    start = start.groupBy(key, F.col("_point").alias("_rank")).agg(F.min(_own("start")).alias("_from"))
    hit = (near.join(start, [key, "_rank"], "left")
           .select(key, "_rank", F.when(F.col("_edge").isNull(), F.col("first")).otherwise(F.col("_from")).alias("_from"),
                   F.col("_end").alias("_to"), "_on"))
    found = rows.filter(kind == 0)
    for place, name in (("_from", "_start"), ("_to", "_end")):
        hit = hit.join(found.select(key, rank.alias(place), change.alias(name)), [key, place], "left")
    hit = hit.select(key, "_rank", "_start", "_end", "_on")
    out = rows.filter(kind == 1).select(key, "_rank", "_p").join(hit, [key, "_rank"], how)
    if how == "left":
        out = out.unionByName(prows.filter(~can_match).select(key, "_p"), allowMissingColumns=True)
    start = F.col("_start")
    marker = F.when(start["op"] == "delete", F.concat(
        F.lit("DELETED_"), iso_text(start["t"]), F.lit("_"), F.coalesce(start["why"], F.lit(default_reason))))
    return out.select(
        key, *[F.col("_p")[c].alias(c) for c in pcols], start["t"].alias("validFrom"), F.col("_end.t").alias("validTo"),
        F.col("_on").alias("isActive"), marker.alias("deletionMarker"), start["op"].alias("op"),
        start["seq"].alias(seq), start["rec"].alias("transactionStart"), F.col("_end.rec").alias("validToRecordedAt"))
