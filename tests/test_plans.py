"""Physical-plan properties of the registered queries (checked on sf0.001)."""

import re

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
FILE_BACKED = {"scan_vendor_csv", "scan_vendor_feeds", "as_of_hot", "append_series", "export_documents", "stream_ingest_series",
               "stream_latest_price", "as_of", "as_of_bitemporal", "as_of_instant", "append_series_twice",
               "stream_latest_compacted", "apply_changes_incremental", "validate_series_copies", "add_holdings_rows"}


def _plan(spark, name):
    df = E.queries()[name](spark, SF)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(E.queries()) - FILE_BACKED - set(E.LLM_QUERIES)))
def test_no_pairwise_joins_or_python(spark, name):
    plan = _plan(spark, name)
    for bad in ("BroadcastNestedLoopJoin", "CartesianProduct", "BatchEvalPython",
                "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas"):
        assert bad not in plan, (name, bad)


@pytest.mark.parametrize("name", ["series_range_capped", "series_stats_capped", "trend_capped",
                                  "instruments_by_class_capped"])
def test_caps_limit_before_the_shuffle(spark, name):
    plan = _plan(spark, name)
    assert re.search(r"WindowGroupLimit .*Partial", plan), name
    assert re.search(r"WindowGroupLimit .*Final", plan), name


def test_range_filter_pushed_and_scan_pruned(spark):
    plan = _plan(spark, "series_range")
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan
    stats = _plan(spark, "series_stats")
    schema = re.search(r"ReadSchema: (struct<[^>]*>)", stats).group(1)
    assert "props" not in schema and "value" in schema


def test_aggregates_are_partial(spark):
    for name in ("latest_price", "provenance_summary", "series_stats"):
        assert re.search(r"partial_(max_by|count|min)", _plan(spark, name)), name


def test_statistics_hold_no_pair_in_a_buffer(spark):
    for name in ("series_stats", "series_stats_tool", "instrument_scorecard"):
        assert not re.search(r"median\(|percentile", _plan(spark, name)), name


@pytest.mark.parametrize("name", ["series_stats_hot", "series_stats_tool_hot"])
def test_no_window_sorts_the_prices_of_a_hot_pair(spark, name):
    plan = _plan(spark, name)
    windows = re.findall(r"Window \[.*?\], \[(.*?)\], \[(.*?)\]", plan)
    by_price = [part for part, order in windows if "close" in order]
    assert by_price and all("_split" in part for part in by_price)
