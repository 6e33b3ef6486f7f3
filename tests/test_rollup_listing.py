"""Daily roll-up, stored listings and prices by reference against plain Python."""

import datetime as dt
import random

import pytest

from tickvault.operators import listing, reference_price, rollup, series
from tickvault.session import scratch_path

DAY = dt.datetime(2024, 1, 1)
SERIES = ("seriesId string, instrumentId string, dataSourceId string, dataTimestamp timestamp_ntz, close double, "
          "volume double, extras map<string,double>, texts map<string,string>, dataQuality string")


def rows(n, seed=1):
    rnd = random.Random(seed)
    return [(f"TS_{i}", rnd.choice(["a"] * 8 + ["b", None]), "s", None if rnd.random() < 0.02 else DAY + dt.timedelta(minutes=rnd.randint(0, 9 * 1440)),
             None if rnd.random() < 0.05 else round(rnd.lognormvariate(3, 2), 3), None, {"k": float(i)}, None, "ok") for i in range(n)]


@pytest.mark.parametrize("start, end", [(None, None), ("2024-01-03 00:00:00", "2024-01-05 23:59:59.999999"),
                                        ("2024-01-02 11:17:00", "2024-01-07 09:00:00"),
                                        ("2024-01-04 03:00:00", "2024-01-04 04:00:00")])
def test_rollup_equals_rows(spark, start, end):
    data = rows(6000)
    table = spark.createDataFrame(data, SERIES)
    path = scratch_path(spark, "rollup-test")
    rollup.daily_rollup(table).write.partitionBy("day").parquet(path)
    qs = (0.0, 0.25, 0.5, 0.9, 1.0)
    got = {r.instrumentId: r for r in rollup.stats_from_rollup(spark.read.parquet(path), table, start, end, qs).collect()}
    lo, hi = (dt.datetime.fromisoformat(x) if x else None for x in (start, end))
    expected = {}
    for r in data:
        if r[3] and r[4] is not None and (lo is None or r[3] >= lo) and (hi is None or r[3] <= hi):
            expected.setdefault(r[1], []).append(r[4])
    assert set(got) == set(expected)
    for key, closes in expected.items():
        closes.sort()
        r = got[key]
        assert (r["count"], r.minPrice, r.maxPrice) == (len(closes), closes[0], closes[-1])
        assert r.avgPrice == pytest.approx(sum(closes) / len(closes), rel=1e-12)
        for q, value in zip(qs, r.quantiles):
            below = sum(c < value for c in closes) / len(closes)
            upto = sum(c <= value for c in closes) / len(closes)
            assert below - 0.03 <= q <= upto + 0.03


def test_rollup_range_without_series(spark):
    table = spark.createDataFrame(rows(50), SERIES)
    daily = rollup.daily_rollup(table)
    with pytest.raises(ValueError):
        rollup.stats_from_rollup(daily, None, "2024-01-02 11:00:00", None)
    assert rollup.stats_from_rollup(daily, None, "2024-01-02 00:00:00", None).count() > 0
    assert rollup.stats_from_rollup(rollup.daily_rollup(table.limit(0)), table.limit(0)).count() == 0


def test_rollup_of_prices_that_do_not_fit(spark):
    data = [(str(i), "a", "s", DAY, v, None, None, None, "ok") for i, v in enumerate([1e30, 1e30, 2.0])]
    r = rollup.stats_from_rollup(rollup.daily_rollup(spark.createDataFrame(data, SERIES))).first()
    assert (r["count"], r.avgPrice) == (3, pytest.approx(2e30 / 3))


def test_pages_and_seek_meet_every_row_once(spark):
    rnd = random.Random(4)
    data = [(rnd.choice([None, 1, 2, 2, 3]), f"id{i:03}") for i in range(137)]
    table, path, order = spark.createDataFrame(data, "g int, id string").repartition(5), scratch_path(spark, "pages"), ["g", "id"]
    listing.store_order(table, path, order, 7)
    expected = sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    for offset, limit in [(0, 10), (60, 50), (130, 20), (136, 1), (137, 5), (500, 5), (20, 0)]:
        page = listing.read_page(spark, path, order, offset, limit)
        assert [tuple(r) for r in page.collect()] == expected[offset:offset + limit]
    seen, last = [], None
    while page := listing.rows_after(table, order, last, 40).collect():
        seen += [tuple(r) for r in page]
        last = seen[-1]
    assert seen == expected
    with pytest.raises(ValueError):
        listing.read_page(spark, path, order, -1, 5)


def test_deep_page_reads_its_partitions_only(spark):
    path = scratch_path(spark, "deep")
    listing.store_order(spark.range(10000), path, ["id"], 20)
    page = listing.read_page(spark, path, ["id"], 9000, 10)
    assert [r.id for r in page.collect()] == list(range(9000, 9010))
    held = page.inputFiles()
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_part" in plan and len(held) >= 1


def test_empty_listing(spark):
    path = scratch_path(spark, "none")
    listing.store_order(spark.range(0), path, ["id"], 4)
    assert listing.read_page(spark, path, ["id"], 0, 10).count() == 0
    assert listing.rows_after(spark.range(0), ["id"], None, 10).count() == 0


def test_latest_price_by_reference(spark):
    inst = spark.createDataFrame([("INST_1", "AAA", True), ("INST_2", "BBB", True), ("INST_3", "CCC", False), ("INST_4", "DDD", True)],
                                 "instrumentId string, symbol string, isActive boolean")
    srcs = spark.createDataFrame([("DS_1", "One", "csv"), ("DS_2", "Two", "yahoo"), ("DS_3", "Three", "csv")],
                                 "dataSourceId string, providerName string, providerType string")
    prices = spark.createDataFrame(
        [("TS_1", "INST_1", "DS_1", DAY, 1.0, 5.0, {"k": 2.0, "close": 9.0}, {"note": "x"}, "ok"),
         ("TS_2", "INST_1", "DS_2", DAY, 2.0, None, None, None, "ok"),
         ("TS_3", "INST_1", "DS_1", DAY - dt.timedelta(1), 3.0, None, None, None, "ok"),
         ("TS_4", "INST_2", "DS_3", DAY, None, None, {"k": 1.0}, None, None)], SERIES)
    asks = [(1, "AAA", None), (2, "INST_1", "one"), (3, "BBB", ""), (4, "CCC", None), (5, "DDD", None), (6, "BBB", "yahoo"),
            (7, None, None), (2, "INST_1", "one"), (8, "aaa", None), (9, "INST_9", "DS_1")]
    requests = spark.createDataFrame(asks, "requestId int, ref string, sourceRef string")
    got = sorted(((r.requestId, r.dataSourceId, r.status, r.indicators) for r in
                  reference_price.latest_price_by_reference(requests, inst, prices, srcs).collect()), key=lambda r: r[0])
    one = (2, "DS_1", "ok", {"close": 1.0, "volume": 5.0, "k": 2.0})
    assert got == [(1, "DS_2", "ok", {"close": 2.0}), one, one, (3, "DS_3", "ok", {"k": 1.0}),
                   (4, None, "instrument not found", None), (5, None, "no data sources", None), (6, "DS_2", "no price", None),
                   (7, None, "instrument not found", None), (8, None, "instrument not found", None), (9, "DS_1", "no price", None)]
    newest = {(r.instrumentId, r.dataSourceId): r.texts for r in series.latest_indicators(prices).collect()}
    assert newest[("INST_1", "DS_1")] == {"note": "x"}
