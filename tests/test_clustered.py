"""The stored series: same answers as the operators on plain rows, and no exchange of bucketed ones."""

import datetime as dt
import random

import pytest

from tickvault.operators import clustered, series
from tickvault.session import scratch_path

DAY = dt.datetime(2024, 1, 1)
LAYOUT = "seriesId string, instrumentId string, dataSourceId string, dataTimestamp timestamp_ntz, close double, note string"


def rows(n=1500, seed=3):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        pair = ("hot", "s") if i % 3 == 0 else (rnd.choice(["a", "b", None, "c d'"]), rnd.choice(["s", "t", None]))
        when = None if rnd.random() < 0.03 else DAY + dt.timedelta(hours=rnd.randint(0, 60))
        close = None if rnd.random() < 0.05 else round(rnd.lognormvariate(3, 2), rnd.randint(0, 3))
        out += [(f"TS_{i}", *pair, when, close, "x" * rnd.randint(0, 3))] * rnd.choice([1, 1, 2])
    return out + [("TS_z", "lone", "s", DAY, None, None), ("TS_y", "large", "s", DAY, 1e30, None), ("TS_x", "large", "s", DAY, 3e30, None)]


def same(got, expected):
    text = lambda df: sorted(map(repr, df.select(*sorted(df.columns)).collect()))
    assert got.columns == expected.columns
    assert text(got) == text(expected)


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(rows(), LAYOUT).repartition(6)


@pytest.fixture(scope="module", params=[100, 10 ** 6])
def store(spark, table, request):
    return clustered.store_clustered(table, scratch_path(spark, "clustered-test"), 5, rows_per_pair=request.param)


def test_each_pair_lies_in_one_part(store, table):
    same(store.each(lambda part: part), table)
    if store.hot is not None:
        pairs = [set(map(tuple, part.select(*series.PAIR).distinct().collect())) for part in (store.pairs, store.hot)]
        assert ("hot", "s") in pairs[1] and not pairs[0] & pairs[1]
        assert len(store.hot.inputFiles()) > 1


def test_ranges_and_latest(store, table):
    start, end = "2024-01-01 12:00:00", "2024-01-02 23:00:00"
    same(clustered.range_of(store, start, end), series.series_range(table, start, end))
    same(clustered.latest_of(store, columns=("seriesId", "dataTimestamp", "close")),
         series.latest_price(table, columns=("seriesId", "dataTimestamp", "close")))
    # among equal records it does not matter which one is numbered first
    same(clustered.range_of(store, limit=4), series.series_range(table, limit=4))


@pytest.mark.parametrize("days", [1, 5, 40])
def test_trend(store, table, days):
    exact = clustered.trend_of(store, days).filter("instrumentId is null or instrumentId <> 'large'")
    same(exact, series.trend(table, days).filter("instrumentId is null or instrumentId <> 'large'"))
    big = clustered.trend_of(store, 1).filter("instrumentId = 'large'").first()
    assert (big["count"], big.recentAvg, big.olderAvg, big.trend) == (2, 1e30, 3e30, "downward")


def test_statistics(store, table):
    for order in ("value", "time"):
        same(clustered.stats_of(store, order=order, rows_per_range=20).drop("firstPrice", "lastPrice", "priceChange", "percentChange"),
             series.series_stats(table, order=order).drop("firstPrice", "lastPrice", "priceChange", "percentChange"))
    same(clustered.stats_of(store), series.series_stats(table))
    same(clustered.stats_of(store, "2024-01-01 12:00:00", "2024-01-02 06:00:00", tool=True),
         series.series_stats_tool(table, "2024-01-01 12:00:00", "2024-01-02 06:00:00"))


def test_keys(spark, store, table):
    keys = spark.createDataFrame([("a", "s"), ("hot", "s"), ("nobody", "s")], "instrumentId string, dataSourceId string")
    same(clustered.trend_of(store, 5, keys), series.trend(table, 5, keys=keys))
    same(clustered.latest_of(store, keys, columns=("close",)), series.latest_price(table, keys, ("close",)))


@pytest.mark.parametrize("ask", [
    lambda s: clustered.range_of(s), lambda s: clustered.range_of(s, limit=3), lambda s: clustered.latest_of(s, columns=("close",)),
    lambda s: clustered.stats_of(s), lambda s: clustered.stats_of(s, order="time"), lambda s: clustered.stats_of(s, tool=True),
    lambda s: clustered.trend_of(s, 7)])
def test_buckets_are_read_without_exchange(spark, table, ask):
    plain = clustered.store_clustered(table, scratch_path(spark, "clustered-plan"), 5)
    assert plain.hot is None
    answer = ask(plain)
    answer.collect()
    assert "Exchange" not in answer._jdf.queryExecution().executedPlan().toString()


def test_a_bucket_is_one_file_of_whole_pairs(spark, table):
    plain = clustered.store_clustered(table, scratch_path(spark, "clustered-files"), 5)
    from pyspark.sql import functions as F
    held = plain.pairs.select(*series.PAIR, F.input_file_name().alias("file")).distinct()
    assert len(plain.pairs.inputFiles()) <= 5
    assert held.groupBy(*series.PAIR).count().filter("count > 1").count() == 0


def test_generations(spark, table):
    path = scratch_path(spark, "clustered-generations")
    with pytest.raises(ValueError):
        clustered.open_clustered(spark, path)
    old = clustered.store_clustered(table, path, 3)
    table.limit(7).write.parquet(f"{path}/gen-unpublished/pairs")
    new = clustered.store_clustered(table.filter("instrumentId = 'a'"), path, 4)
    assert old.pairs.count() == table.count()
    same(new.pairs, table.filter("instrumentId = 'a'"))
    # a session that does not know the table finds it by its path, in buckets as before
    for name in [t.name for t in spark.catalog.listTables() if t.name.startswith("tickvault_series_gen_")]:
        spark.sql(f"DROP TABLE {name}")
    again = clustered.open_clustered(spark, path)
    same(again.pairs, table.filter("instrumentId = 'a'"))
    answer = clustered.stats_of(again)
    assert "Exchange" not in answer._jdf.queryExecution().executedPlan().toString()


def test_empty_series_and_bad_sizes(spark, table):
    none = clustered.store_clustered(table.limit(0), scratch_path(spark, "clustered-none"), 3)
    assert clustered.stats_of(none).count() == clustered.trend_of(none).count() == clustered.range_of(none).count() == 0
    for wrong in ({"buckets": 0}, {"rows_per_pair": 0}):
        with pytest.raises(ValueError):
            clustered.store_clustered(table, scratch_path(spark, "clustered-bad"), **wrong)
    with pytest.raises(ValueError):
        clustered.trend_of(none, 0)
