"""As-of with a transaction time per point against a fold that is repeated for every point."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tickvault.operators.bitemporal import as_of_bitemporal_points

FEED = "instrumentId string, ts timestamp_ntz, event_id bigint, op string, recordedAt timestamp_ntz, reason string"
POINTS = "instrumentId string, pointId int, dataTimestamp timestamp_ntz, knownAt timestamp_ntz"
DAY = dt.datetime(2024, 1, 1)


def hour(h):
    return None if h is None else DAY + dt.timedelta(hours=h)


def refold(feed, key, at, known):
    """(validFrom, validTo, isActive, op, event_id, transactionStart, validToRecordedAt), or None."""
    if None in (key, at, known):
        return None
    rows = sorted((r for r in feed if r[0] == key and r[1] is not None and r[4] is not None and r[4] <= known),
                  key=lambda r: (r[1], r[2]))
    first = next((r for r in rows if r[3] == "register"), None)
    if first is None:
        return None
    kept = []
    for r in rows[rows.index(first):]:
        if (r is first or r[3] != "register") and (not kept or (kept[-1][3] == "delete") != (r[3] == "delete")):
            kept.append(r)
    for r, end in zip(kept, kept[1:] + [None]):
        if r[1] <= at and (end is None or at < end[1]):
            return (r[1], end and end[1], r[3] != "delete", r[3], r[2], r[4], end and end[4])
    return None


def table(seed, n_feed=160, n_points=240, hours=20):
    """Few instants, so many ties; late, early and null records; one key with most of the rows."""
    rnd = random.Random(seed)
    keys = ["a"] * 6 + ["b", "c", None]
    when = lambda lo, hi: None if rnd.random() < 0.03 else hour(rnd.randint(lo, hi))
    feed = [(rnd.choice(keys), when(0, hours), i, rnd.choice(["register", "delete", "restore", "delete", "restore"]),
             when(0, hours + 10), rnd.choice([None, "x"])) for i in range(n_feed)]
    points = [(rnd.choice(keys + ["none"]), i, when(-1, hours + 1), when(-1, hours + 11)) for i in range(n_points)]
    return feed, points + points[:20]


@pytest.mark.parametrize("seed, rows_per_bucket", [(1, 1_000_000), (2, 25)])
def test_equals_a_fold_per_point(spark, seed, rows_per_bucket):
    feed, points = table(seed)
    got = as_of_bitemporal_points(spark.createDataFrame(feed, FEED), spark.createDataFrame(points, POINTS),
                                  how="left", rows_per_bucket=rows_per_bucket).collect()
    cols = ("validFrom", "validTo", "isActive", "op", "event_id", "transactionStart", "validToRecordedAt")
    answer = sorted((r.pointId, tuple(r[c] for c in cols)) for r in got if r.validFrom)
    expected = sorted((p[1], v) for p in points if (v := refold(feed, p[0], p[2], p[3])))
    assert len(got) == len(points)
    assert len(expected) > 60 and answer == expected
    marks = {r.event_id: r.deletionMarker for r in got if r.op == "delete"}
    for event_id, mark in marks.items():
        assert mark.endswith(feed[event_id][5] or "user_requested")
    assert all(r.deletionMarker is None for r in got if r.op != "delete")


def test_an_earlier_register_recorded_late(spark):
    """The late register makes the changes before the known one count, from its record on."""
    feed = [("a", hour(5), 1, "register", hour(5), None), ("a", hour(3), 2, "delete", hour(6), None),
            ("a", hour(1), 3, "register", hour(8), None)]
    points = [("a", 0, hour(4), hour(7)), ("a", 1, hour(4), hour(8)), ("a", 2, hour(6), hour(7)), ("a", 3, hour(6), hour(9))]
    got = {r.pointId: (r.op, r.validFrom, r.validTo) for r in as_of_bitemporal_points(
        spark.createDataFrame(feed, FEED), spark.createDataFrame(points, POINTS)).collect()}
    assert got == {1: ("delete", hour(3), None), 2: ("register", hour(5), None), 3: ("delete", hour(3), None)}


def test_empty_tables(spark):
    feed, points = table(3, 12, 12)
    none_f, none_p = spark.createDataFrame([], FEED), spark.createDataFrame([], POINTS)
    assert as_of_bitemporal_points(spark.createDataFrame(feed, FEED), none_p).count() == 0
    kept = as_of_bitemporal_points(none_f, spark.createDataFrame(points, POINTS), how="left")
    assert kept.count() == len(points) and kept.filter(F.col("validFrom").isNotNull()).count() == 0
    with pytest.raises(ValueError):
        as_of_bitemporal_points(none_f, none_p, how="outer")


def test_tree_carries_ranks_alone(spark):
    # rows are repeated once a level: the changes themselves are not among the columns that are
    feed, points = table(4)
    df = as_of_bitemporal_points(spark.createDataFrame(feed, FEED), spark.createDataFrame(points, POINTS), how="left")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    spread = [line for line in plan.splitlines() if "Generate explode" in line]
    assert len(spread) >= 2 and not any("_c#" in line or "_p#" in line for line in spread)
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and not any("struct" in line.lower() for line in windows)
