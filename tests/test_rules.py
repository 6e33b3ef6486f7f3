"""Hand-made cases, one per rule (FIXTURES.md §4), worked out by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tickvault.operators import catalog, ingest, lineage, resolve, series, temporal
from tickvault.session import scratch_path
from tickvault.sources import vendor

T0 = dt.datetime(2024, 1, 1)


def _series(spark, closes, pair=("I1", "S1")):
    """closes are given oldest first; None = row without a close."""
    rows = [(f"TS_{i:03d}", pair[0], pair[1], T0 + dt.timedelta(days=i), c)
            for i, c in enumerate(closes)]
    return spark.createDataFrame(
        rows, "seriesId string, instrumentId string, dataSourceId string, "
              "dataTimestamp timestamp_ntz, close double")


def _one(df):
    rows = df.collect()
    assert len(rows) == 1, rows
    return rows[0]


def test_even_size_medians(spark):
    s = _series(spark, [1.0, 2.0, 3.0, 4.0])
    assert _one(series.series_stats(s)).medianPrice == 2.5
    assert _one(series.series_stats_tool(s)).medianPrice == 3.0


def test_value_sorted_first_last(spark):
    r = _one(series.series_stats(_series(spark, [5.0, 1.0, 3.0])))
    assert (r.firstPrice, r.lastPrice, r.priceChange, r.percentChange) == (1.0, 5.0, 4.0, 400.0)
    t = _one(series.series_stats(_series(spark, [5.0, 1.0, 3.0]), order="time"))
    assert (t.firstPrice, t.lastPrice) == (5.0, 3.0)


def test_zero_minimum(spark):
    assert _one(series.series_stats(_series(spark, [0.0, 2.0]))).percentChange == 0.0


def test_short_trend(spark):
    # newest first 3, 1  ->  oldest first 1, 3
    r = _one(series.trend(_series(spark, [1.0, 3.0]), days=30))
    assert (r.recentAvg, r.olderAvg, r.trend, r.changePercent, r.volatility) == \
        (2.0, 0.0, "upward", 0.0, 2.0)


def test_long_trend(spark):
    # newest first 1, 1, 4, 4
    s = _series(spark, [4.0, 4.0, 1.0, 1.0])
    for cap in (1000, None):
        r = _one(series.trend(s, days=2, row_cap=cap))
        assert (r.recentAvg, r.olderAvg, r.trend, r.changePercent) == (1.0, 4.0, "downward", -75.0)


def test_one_close_is_insufficient(spark):
    r = _one(series.trend(_series(spark, [7.0])))
    assert r.trend == "insufficient" and r.recentAvg is None


def test_cap_before_close_filter(spark):
    s = _series(spark, [5.0, 6.0, None, None])
    assert series.series_stats(s, row_cap=2).count() == 0
    assert _one(series.series_stats(s, row_cap=None))["count"] == 2


def test_series_range_newest_first_with_limit(spark):
    s = _series(spark, [1.0, 2.0, 3.0, 4.0, 5.0])
    rows = series.series_range(s, "2024-01-02", "2024-01-05", limit=2).orderBy("rowNumber").collect()
    assert [r.close for r in rows] == [5.0, 4.0]


def test_latest_price(spark):
    r = _one(series.latest_price(_series(spark, [1.0, 9.0, 3.0]), columns=("seriesId", "close")))
    assert (r.seriesId, r.close) == ("TS_002", 3.0)


def test_offset_and_bad_timestamps(spark):
    df = spark.createDataFrame([("2024-01-02T03:04:05+02:00",), ("nope",)], "t string")
    out = ingest.normalise_timestamps(df, "t", "2024-02-01 00:00:00").collect()
    assert out[0].dataTimestamp == dt.datetime(2024, 1, 2, 1, 4, 5) and not out[0].ts_defaulted
    assert out[1].dataTimestamp == dt.datetime(2024, 2, 1) and out[1].ts_defaulted


def test_external_defaults_and_bad_timestamp(spark):
    p = spark.createDataFrame([('{"symbol":"X","close":"2","pe":9}',),
                               ('{"symbol":"Y","timestamp":"nope"}',)], "payload string")
    good, bad = vendor.normalise_external_json(p, "2024-02-01 00:00:00")
    g = _one(good)
    assert (g.instrumentId, g.close, g.open, g.high, g.low, g.volume) == ("X", 2.0, 0, 0, 0, 0)
    assert g.extras == {"pe": 9.0}
    assert _one(bad).reject_reason == "bad timestamp"


def test_external_shapes(spark):
    p = spark.createDataFrame([('[{"id": 5}, {"id": 6}]',), ('{"data": [{"id": 7}]}',),
                               ('"text"',), ('{"id": 0, "symbol": ""}',)], "payload string")
    good, bad = vendor.normalise_external_json(p, "2024-02-01 00:00:00")
    assert sorted(r.instrumentId for r in good.collect()) == ["5", "6", "7"]
    assert [r.reject_reason for r in bad.collect()] == ["missing instrument"]


def test_csv_fill_and_drop(spark):
    raw = spark.createDataFrame([("2024-01-05", "1.5"), ("2024-01-06", "None")],
                                "Date string, Close string")
    good, bad = vendor.map_vendor_columns(raw, (("close", "close"),))
    g = _one(good)
    assert (g.open, g.high, g.low, g.close, g.volume) == (1.5, 1.5, 1.5, 1.5, 0.0)
    assert _one(bad).reject_reason == "no close"


def test_csv_last_usable_mapping_wins(spark):
    raw = spark.createDataFrame([("2024-01-05", "1.5", "2.5"), ("2024-01-06", "1.5", "")],
                                "Date string, Close string, `Adj. Close` string")
    good, _ = vendor.map_vendor_columns(raw, (("close", "close"), ("adj. close", "close")))
    assert [r.close for r in good.orderBy("dataTimestamp").collect()] == [2.5, 1.5]


def test_half_even_rounding_on_decimal_text(spark):
    raw = spark.createDataFrame([("2024-01-05", "0.12345")], "Date string, Close string")
    good, _ = vendor.map_vendor_columns(raw, (("close", "close"),))
    assert _one(good).close == 0.1234


def test_repeat_symbol_first_kept(spark):
    new = spark.createDataFrame(
        [("A", "first", "d", "stock", "US", "USD", 1), ("A", "second", "d", "stock", "US", "USD", 2),
         ("B", "b", "d", "stock", "US", "USD", 3)],
        "symbol string, name string, description string, instrumentClass string, "
        "region string, currency string, seq int")
    existing = spark.createDataFrame([("B",)], "symbol string")
    r = _one(ingest.register_instruments(new, existing, order=["seq"]))
    assert (r.symbol, r.name) == ("A", "first") and r.instrumentId.startswith("INST_")
    assert len(r.instrumentId) == len("INST_") + 12


def _feed(spark, ops):
    rows = [("I1", T0 + dt.timedelta(hours=i), i, op) for i, op in enumerate(ops)]
    return spark.createDataFrame(rows, "instrumentId string, ts timestamp_ntz, event_id long, op string")


def test_repeat_delete_versions(spark):
    v = temporal.apply_changes(_feed(spark, ["delete", "register", "delete", "delete", "restore",
                                             "register", "restore"]))
    rows = v.orderBy("validFrom").collect()
    assert [r.isActive for r in rows] == [True, False, True]
    assert rows[1].deletionMarker == "DELETED_2024-01-01T02:00:00_user_requested"
    assert rows[0].validTo == rows[1].validFrom and rows[-1].validTo is None


def test_versions_do_not_overlap_or_gap(spark):
    import random
    rng = random.Random(7)
    rows = []
    for k in range(20):
        t = T0
        for i in range(rng.randint(1, 60)):
            t += dt.timedelta(minutes=rng.randint(1, 3000))
            rows.append((f"I{k}", t, len(rows), rng.choice(["register", "delete", "restore"])))
    feed = spark.createDataFrame(rows, "instrumentId string, ts timestamp_ntz, event_id long, op string")
    v = temporal.apply_changes(feed, rows_per_bucket=4)
    by_key = {}
    for r in v.collect():
        by_key.setdefault(r.instrumentId, []).append(r)
    for vs in by_key.values():
        vs.sort(key=lambda r: r.validFrom)
        for a, b in zip(vs, vs[1:]):
            assert a.validTo == b.validFrom and a.isActive != b.isActive
        assert vs[-1].validTo is None and vs[0].op == "register"


def test_as_of_matches_brute_force(spark):
    import random
    rng = random.Random(11)
    rows = []
    for k in range(5):
        t = T0
        for _ in range(rng.randint(1, 40)):
            t += dt.timedelta(minutes=rng.randint(1, 5000))
            rows.append((f"I{k}", t, len(rows), rng.choice(["register", "delete", "restore"])))
    feed = spark.createDataFrame(rows, "instrumentId string, ts timestamp_ntz, event_id long, op string")
    v = temporal.apply_changes(feed, rows_per_bucket=3)
    pts = spark.createDataFrame(
        [(f"I{rng.randint(0, 5)}", T0 + dt.timedelta(minutes=rng.randint(0, 200000)), i)
         for i in range(400)], "instrumentId string, at timestamp_ntz, pid int")
    got = temporal.as_of(v, pts, at="at", rows_per_bucket=7).select("pid", "validFrom")
    cond = ((pts.instrumentId == v.instrumentId) & (v.validFrom <= pts.at)
            & (v.validTo.isNull() | (pts.at < v.validTo)))
    want = pts.join(v, cond).select("pid", "validFrom")
    assert sorted(got.collect()) == sorted(want.collect())


def test_unknown_source_in_lineage(spark):
    prov = spark.createDataFrame(
        [("P1", "I1", "DS_X", "bulk_import", T0, "h", "bulk_api_post")],
        "provenanceId string, instrumentId string, sourceId string, sourceType string, "
        "ingestTime timestamp_ntz, rawDataHash string, ingestionMethod string")
    src = spark.createDataFrame([("DS_1", "n", "t")],
                                "dataSourceId string, providerName string, providerType string")
    r = _one(lineage.provenance_summary(prov, src))
    assert (r.providerName, r.providerType, r.totalRecords) == ("Unknown", "Unknown", 1)


def test_compare_keeps_order_and_repeats(spark):
    inst = spark.createDataFrame([("INST_A", "A", "a", "stock", "US", True)],
                                 "instrumentId string, symbol string, name string, "
                                 "instrumentClass string, region string, isActive boolean")
    req = spark.createDataFrame([(1, ["INST_A", "missing", "A"]), (2, ["INST_A"])],
                                "requestId int, refs array<string>")
    comp, rejects = catalog.compare_instruments(req, inst, refs_col="refs")
    assert [(r.position, r.instrumentId) for r in comp.orderBy("position").collect()] == \
        [(0, "INST_A"), (2, "INST_A")]
    assert [r.requestId for r in rejects.collect()] == [2]


def test_resolver_tiers(spark):
    inst = spark.createDataFrame(
        [("INST_1", "ABC", "Alpha Corp", True), ("INST_2", "abd", "Beta Holdings", True),
         ("INST_3", "XYZ", "Alpha Beta", True), ("INST_4", "OLD", "Gone Inc", False)],
        "instrumentId string, symbol string, name string, isActive boolean")
    refs = spark.createDataFrame([("INST_99",), ("abc",), ("ABD",), ("beta",), ("gone",), ("zz",)],
                                 "ref string")
    got = {r.ref: (r.instrumentId, r.tier) for r in resolve.resolve_instruments(refs, inst).collect()}
    assert got == {"INST_99": ("INST_99", 1), "abc": ("INST_1", 2), "ABD": ("INST_2", 3),
                   "beta": ("INST_2", 4), "gone": (None, None), "zz": (None, None)}


def test_default_source(spark):
    inst = spark.createDataFrame([("I1",), ("I2",), ("I3",)], "instrumentId string")
    ser = spark.createDataFrame([("I1", "DS_b"), ("I1", "DS_a"), ("I2", "DS_a")],
                                "instrumentId string, dataSourceId string")
    src = spark.createDataFrame([("DS_a", "other"), ("DS_b", "yahoo"), ("DS_c", "yahoo")],
                                "dataSourceId string, providerType string")
    got = {r.instrumentId: (r.dataSourceId, r.how)
           for r in resolve.default_source(inst, ser, src).collect()}
    assert got == {"I1": ("DS_b", "preferred"), "I2": ("DS_a", "first"),
                   "I3": ("DS_b", "fallback_preferred")}


def test_explode_attribute_types(spark):
    a = spark.createDataFrame([("I1", '{"s": "x", "n": 3, "f": 1.0, "b": true, "l": [1], '
                                      '"d": {"a": 1}, "z": null}')],
                              "instrumentId string, attributes string")
    got = {r.attributeName: (r.attributeValue, r.attributeType)
           for r in ingest.explode_attributes(a).collect()}
    assert got == {"s": ("x", "str"), "n": ("3", "int"), "f": ("1.0", "float"),
                   "b": ("true", "bool"), "l": ("[1]", "list"), "d": ('{"a":1}', "dict"),
                   "z": ("null", "NoneType")}


def test_validate_series_rejects(spark):
    raw = spark.createDataFrame(
        [("I1", "S1", "2024-01-01T00:00:00", {"close": 1.0}),
         (None, "S1", "2024-01-01T00:00:00", {"close": 1.0}),
         ("I1", "S1", "2024-01-01T00:00:00", {}),
         ("I1", "S1", "2024-01-01T00:00:00", {"close": float("nan")})],
        "instrumentId string, dataSourceId string, dataTimestamp string, "
        "indicators map<string,double>")
    valid, rejects = ingest.validate_series(raw, "2024-02-01")
    assert valid.count() == 1
    assert sorted(r.reject_reason for r in rejects.collect()) == \
        ["missing indicators", "missing instrumentId", "non-finite close"]
    s = _one(ingest.ingest_summary(valid, rejects))
    assert (s.ingestedCount, s.totalAttempted, s.errorCount, s.status) == (1, 4, 3, "success")


def test_surrogate_keys_are_deterministic(spark):
    df = spark.createDataFrame([("A",), ("A",), ("B",)], "k string")
    ids = [r.id for r in ingest.assign_keys(df, "X_", ["k"], "id").collect()]
    assert ids[0] == ids[1] != ids[2]
    ords = ingest.assign_keys(df, "X_", ["k"], "id", ordinal=True).select("id").distinct().count()
    assert ords == 3


def test_export_iso_text(spark):
    df = spark.createDataFrame([("a", dt.datetime(2024, 1, 2, 3, 4, 5)),
                                ("b", dt.datetime(2024, 1, 2, 3, 4, 5, 120))],
                               "k string, t timestamp_ntz")
    got = {r.k: r.t for r in ingest.export_frame(df).collect()}
    assert got == {"a": "2024-01-02T03:04:05", "b": "2024-01-02T03:04:05.000120"}


@pytest.mark.parametrize("days", [0, -1])
def test_trend_rejects_non_positive_days(spark, days):
    with pytest.raises(ValueError):
        series.trend(_series(spark, [1.0, 2.0]), days=days)


def _python_fold(rows):
    """Reference fold of (key, ts, seq, op) rows, straight from the rules."""
    out, by_key = [], {}
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        by_key.setdefault(r[0], []).append(r)
    for k, ops in by_key.items():
        state, versions = None, []
        for _, t, s, op in ops:
            if state is None:
                if op != "register":
                    continue
                state = True
                versions.append([k, t, None, True])
                continue
            if op == "register":
                continue
            new = op != "delete"
            if new != state:
                versions[-1][2] = t
                versions.append([k, t, None, new])
            state = new
        out.extend(tuple(v) for v in versions)
    return sorted(out)


def test_fold_hot_key_matches_python_reference(spark):
    import random
    rng = random.Random(3)
    rows, t = [], T0
    for i in range(3000):                      # one hot key: most of the feed
        t += dt.timedelta(seconds=rng.randint(1, 900))
        key = "HOT" if rng.random() < 0.8 else f"K{rng.randint(0, 30)}"
        rows.append((key, t, i, rng.choice(["register", "delete", "delete", "restore"])))
    feed = spark.createDataFrame(rows, "instrumentId string, ts timestamp_ntz, event_id long, op string")
    for per_bucket in (50, 10**6):
        got = temporal.apply_changes(feed, rows_per_bucket=per_bucket).select(
            "instrumentId", "validFrom", "validTo", "isActive").collect()
        assert sorted(tuple(r) for r in got) == _python_fold(rows)


def test_copy_ordinals_are_dense_per_key(spark):
    rows = [("A",)] * 500 + [("B",)] * 3 + [("C",)]
    df = spark.createDataFrame(rows, "k string").repartition(7)
    got = ingest.with_copy_ordinal(df, ["k"]).groupBy("k").agg(
        F.sort_array(F.collect_list("_ordinal")).alias("o")).collect()
    assert {r.k: r.o for r in got} == {"A": list(range(1, 501)), "B": [1, 2, 3], "C": [1]}


def test_approx_median_option(spark):
    s = _series(spark, [float(i) for i in range(1, 102)])
    exact = _one(series.series_stats(s, row_cap=None)).medianPrice
    approx = _one(series.series_stats(s, row_cap=None, median="approx")).medianPrice
    assert exact == 51.0 and abs(approx - 51.0) <= 1.0


def test_keys_narrow_to_wanted_pairs(spark):
    s = _series(spark, [1.0, 2.0]).unionByName(_series(spark, [5.0, 7.0], pair=("I2", "S1")))
    keys = spark.createDataFrame([("I2", "S1"), ("I2", "S1")], "instrumentId string, dataSourceId string")
    r = _one(series.series_stats(s, keys=keys))
    assert (r.instrumentId, r.maxPrice) == ("I2", 7.0)
    only = spark.createDataFrame([("I1",)], "instrumentId string")
    assert _one(series.trend(s, keys=only)).instrumentId == "I1"


def test_as_of_left_keeps_unmatched_points(spark):
    v = temporal.apply_changes(_feed(spark, ["register", "delete"]))
    pts = spark.createDataFrame(
        [("I1", T0 + dt.timedelta(minutes=30), 1), ("I1", T0 - dt.timedelta(hours=1), 2),
         ("I1", None, 3), ("I9", T0, 4)], "instrumentId string, at timestamp_ntz, pid int")
    got = {r.pid: r.isActive for r in temporal.as_of(v, pts, at="at", how="left").collect()}
    assert got == {1: True, 2: None, 3: None, 4: None}
    assert [r.pid for r in temporal.as_of(v, pts, at="at").collect()] == [1]


def test_resolve_sources_rules(spark):
    src = spark.createDataFrame([("DS_1", "Alpha Feed", "alpha"), ("DS_2", "Beta Data Link", "beta")],
                                "dataSourceId string, providerName string, providerType string")
    refs = spark.createDataFrame([("DS_9",), ("ALPHA",), ("data",), ("beta data link",), ("zzz",)],
                                 "ref string")
    got = {r.ref: (r.dataSourceId, r.resolved) for r in resolve.resolve_sources(refs, src).collect()}
    assert got == {"DS_9": ("DS_9", True), "ALPHA": ("DS_1", True), "data": ("DS_2", True),
                   "beta data link": ("DS_2", True), "zzz": ("zzz", False)}
    exact = {r.ref: r.resolved for r in resolve.resolve_sources(refs, src, mode="exact").collect()}
    assert exact == {"DS_9": True, "ALPHA": True, "data": False, "beta data link": True, "zzz": False}


def test_source_status_no_data(spark):
    src = spark.createDataFrame([("DS_1", "a", "x"), ("DS_2", "b", "y")],
                                "dataSourceId string, providerName string, providerType string")
    ser = spark.createDataFrame([("I1", "DS_1")], "instrumentId string, dataSourceId string")
    got = {r.dataSourceId: r.status for r in catalog.source_status(src, ser).collect()}
    assert got == {"DS_1": "Active", "DS_2": "No data"}


def test_instrument_details_empty_arrays(spark):
    inst = spark.createDataFrame([("I1", "A", True), ("I2", "B", False)],
                                 "instrumentId string, symbol string, isActive boolean")
    attrs = spark.createDataFrame([], "instrumentId string, attributeName string, "
                                      "attributeValue string, attributeType string")
    ser = spark.createDataFrame([], "instrumentId string, dataSourceId string")
    src = spark.createDataFrame([("DS_1", "a")], "dataSourceId string, providerName string")
    r = _one(catalog.instrument_details(inst, attrs, ser, src))
    assert (r.instrumentId, r.attributes, r.dataSources) == ("I1", [], [])


def test_list_instruments_pages(spark):
    inst = spark.createDataFrame([(f"I{i:02d}", f"S{i}", "n", "c", "US", "USD", i % 4 != 3)
                                  for i in range(20)],
                                 "instrumentId string, symbol string, name string, "
                                 "instrumentClass string, region string, currency string, "
                                 "isActive boolean")
    page = catalog.list_instruments(inst, offset=5, limit=5).collect()
    active_ids = [f"I{i:02d}" for i in range(20) if i % 4 != 3]
    assert [r.assetId for r in page] == active_ids[5:10]
    assert "currency" in catalog.list_instruments(inst, tool=True).columns


def test_register_sources_first_per_type(spark):
    new = spark.createDataFrame([("A", "t1", "e", "d", 2), ("B", "t1", "e", "d", 1),
                                 ("C", "t2", "e", "d", 3), ("D", None, "e", "d", 0)],
                                "providerName string, providerType string, apiEndpoint string, "
                                "description string, seq int")
    existing = spark.createDataFrame([("t2",)], "providerType string")
    r = _one(ingest.register_sources(new, existing, order=["seq"]))
    assert (r.providerName, r.providerType) == ("B", "t1") and r.dataSourceId.startswith("DS_")


def test_append_series_counts_rows_written_once(spark):
    from tickvault.session import scratch_path
    raw = spark.createDataFrame(
        [("I1", "S1", f"2024-0{m}-0{d}T00:00:00", {"close": float(d)})
         for m in (1, 2) for d in range(1, 10)],
        "instrumentId string, dataSourceId string, dataTimestamp string, "
        "indicators map<string,double>")
    valid, _ = ingest.validate_series(raw, "2024-03-01")
    path = scratch_path(spark, "t-append")
    assert ingest.append_series(valid, path) == 18
    back = spark.read.parquet(path)
    assert back.count() == 18 and back.select("ts_month").distinct().count() == 2


def test_conform_fills_and_orders_columns(spark):
    from tickvault.schemas import SERIES, conform
    df = spark.createDataFrame([("I1", 2.5, 7)], "instrumentId string, close double, extra int")
    out = conform(df, SERIES, keep_extra=True)
    assert out.columns == SERIES.fieldNames() + ["extra"]
    r = out.first()
    assert (r.instrumentId, r.close, r.seriesId, r.extra) == ("I1", 2.5, None, 7)


def test_mean_of_tiny_and_huge_prices(spark):
    tiny = _one(series.series_stats(_series(spark, [0.00001234] * 3)))
    assert tiny.avgPrice == pytest.approx(0.00001234, rel=1e-15)
    huge = _series(spark, [1e25, 3e25])
    assert _one(series.series_stats(huge)).avgPrice == 2e25
    assert _one(series.trend(huge, days=1)).recentAvg is not None


def test_pair_without_a_close_is_insufficient(spark):
    r = _one(series.trend(_series(spark, [None, None])))
    assert (r["count"], r.trend) == (0, "insufficient")


def test_export_keeps_null_fields(spark, tmp_path):
    path = str(tmp_path / "export")
    ingest.export_documents(spark.createDataFrame([("a", None)], "id string, validTo string"), path)
    assert spark.read.text(path).first()[0] == '{"id":"a","validTo":null}'


def test_late_delete_is_not_known_before_it_is_recorded(spark):
    """A delete valid on 3 January but recorded on the 10th does not hide that of the 5th."""
    feed = spark.createDataFrame(
        [("K", "2024-01-01 00:00:00", "2024-01-01 00:00:00", 1, "register"),
         ("K", "2024-01-03 00:00:00", "2024-01-10 00:00:00", 2, "delete"),
         ("K", "2024-01-05 00:00:00", "2024-01-05 00:00:00", 3, "delete")],
        "instrumentId string, ts string, recordedAt string, event_id long, op string").selectExpr(
        "instrumentId", "cast(ts as timestamp_ntz) ts", "cast(recordedAt as timestamp_ntz) recordedAt", "event_id", "op")
    points = spark.sql("SELECT 'K' AS instrumentId, 's' AS seriesId, timestamp_ntz'2024-01-06 00:00:00' AS dataTimestamp")
    known = temporal.known_versions(feed, "2024-01-07 00:00:00")
    assert [r.isActive for r in temporal.as_of(known, points).collect()] == [False]


def test_holdings_without_cost_or_portfolio_are_kept(spark):
    day = dt.date(2024, 1, 1)
    df = spark.createDataFrame(
        [("P", "I", 1.0, None, day), ("P", "I", 1.0, None, day), (None, "I", 2.0, 3.0, None)],
        "portfolioId string, instrumentId string, quantity double, averageCost double, acquiredDate date")
    out = ingest.add_holdings(df).collect()
    assert len(out) == 3 and len({r.holdingId for r in out}) == 3
    counts = [r.holdingCount for r in catalog.portfolio_holdings(df).collect()]
    assert sorted(counts) == [1, 2, 2]


def test_compare_long_form_keeps_null_request(spark):
    inst = spark.createDataFrame([("INST_A", "A", "a", "stock", "US", True)],
                                 "instrumentId string, symbol string, name string, "
                                 "instrumentClass string, region string, isActive boolean")
    req = spark.createDataFrame([(None, 0, "INST_A"), (None, 1, "A"), (7, 0, "A")],
                                "requestId int, position int, ref string")
    comp, rejects = catalog.compare_instruments(req, inst)
    assert sorted(r.position for r in comp.collect()) == [0, 1]
    assert [r.requestId for r in rejects.collect()] == [7]
    none = spark.createDataFrame([(1, None), (2, [])], "requestId int, refs array<string>")
    comp, rejects = catalog.compare_instruments(none, inst, refs_col="refs")
    assert comp.count() == 0 and sorted(r.requestId for r in rejects.collect()) == [1, 2]


@pytest.mark.parametrize("name", ["plain", "folders"])
def test_csv_files_of_one_feed_order_columns_differently(spark, tmp_path, name):
    head = {"A.csv": "Date,Open,Close\n2024-01-02,10,20\n2024-01-03,11,\n",
            "B.csv": "date, Close ,Open,Adj. Close\n2024-01-02,20,10,21\n\n2024-01-04,30\n",
            "C.csv": "no header here\n", "D.csv": ""}
    for f, text in head.items():
        d = tmp_path / (f"file={f}" if name == "folders" else "")
        d.mkdir(exist_ok=True)
        (d / (f if name == "plain" else "part-0.csv")).write_text(text)
    files = spark.createDataFrame([(f, f[0]) for f in head], "file_name string, symbol string")
    inst = spark.createDataFrame([(f[0], f"INST_{f[0]}") for f in head], "symbol string, instrumentId string")
    rows = vendor.scan_vendor_csv(spark, [vendor.Feed("f", str(tmp_path), vendor.EQUITIES_COLUMNS)], files, inst,
                                  file_name_col="file" if name == "folders" else None)
    got = sorted((r.symbol, r.dataTimestamp.day, r.open, r.close) for r in rows.collect())
    assert got == [("A", 2, 10.0, 20.0), ("B", 2, 10.0, 21.0), ("B", 4, 30.0, 30.0)]


def test_bundled_vendor_files_keep_their_own_headers(spark, tmp_path):
    files = {"A.csv": ["Date,Open,Close", "2024-01-02,10,20", "2024-01-03,11,"], "C.csv": ["no header here,1"],
             "B.csv": ["date, Close ,Open,Adj. Close", "2024-01-02,20,10,21", "2024-01-04,30"]}
    records = [f"{f},{line}" for f, lines in files.items() for line in lines]
    (tmp_path / "part-0.csv").write_text("\n".join(records[::-1]) + "\n")
    (tmp_path / "part-1.csv").write_text("A.csv,2024-01-05,12,13\n")
    names = spark.createDataFrame([(f, f[0]) for f in files], "file_name string, symbol string")
    inst = spark.createDataFrame([(f[0], f"INST_{f[0]}") for f in files], "symbol string, instrumentId string")
    feed = vendor.Feed("f", str(tmp_path), vendor.EQUITIES_COLUMNS, bundled=True)
    rows = vendor.scan_vendor_csv(spark, [feed], names, inst)
    got = sorted((r.symbol, r.file_name, r.dataTimestamp.day, r.open, r.close) for r in rows.collect())
    assert got == [("A", "A.csv", 2, 10.0, 20.0), ("A", "A.csv", 5, 12.0, 13.0), ("B", "B.csv", 2, 10.0, 21.0),
                   ("B", "B.csv", 4, 30.0, 30.0)]


def test_vendor_files_are_stored_in_few_files(spark, tmp_path):
    import datetime as dt

    from tickvault.plans import roundtrip_queries
    rows = [(i, dt.datetime(2024, 1, 1), i, "view" if i % 2 else "click", 1.5, '{"k": 1}') for i in range(300)]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
                          ).write.parquet(str(tmp_path / "events.parquet"))
    roundtrip_queries._write_vendor_files(spark, str(tmp_path), str(tmp_path / "out"))
    stored = [p for p in (tmp_path / "out").rglob("part-*.csv")]
    assert 0 < len(stored) < 50
    assert len({line.split(",")[0] for p in stored for line in p.read_text().splitlines()}) == 300


@pytest.mark.parametrize("sep", [",", "|"])
def test_wide_vendor_file_is_read_to_its_last_column(spark, tmp_path, sep):
    many = [f"x{k}" for k in range(70)]
    (tmp_path / "A.csv").write_text("\n".join(sep.join(x) for x in (
        [*many, "open", f'"low{sep}"', "Date", "close"], ["7"] * 70 + ["1.5", "3", "2024-01-05", "2.5"])) + "\n")
    (tmp_path / "B.csv").write_text(sep.join(["Date", "close"]) + "\n" + sep.join(["2024-01-05", "4.5"]) + "\n")
    files = spark.createDataFrame([("A.csv", "A"), ("B.csv", "B")], "file_name string, symbol string")
    inst = spark.createDataFrame([("A", "i1"), ("B", "i2")], "symbol string, instrumentId string")
    feed = vendor.Feed("f", str(tmp_path), vendor.EQUITIES_COLUMNS, {"sep": sep})
    rows = {r.symbol: (r.open, r.close) for r in vendor.scan_vendor_csv(spark, [feed], files, inst).collect()}
    assert rows == {"A": (1.5, 2.5), "B": (4.5, 4.5)}


def test_contains_matches_brute_force(spark):
    import random
    rng = random.Random(3)
    names = ["".join(rng.choice("abß ") for _ in range(rng.randint(0, 30))) for _ in range(60)] + [None]
    texts = {"".join(rng.choice("abß ") for _ in range(rng.randint(0, 14))) for _ in range(200)}
    texts |= {n[i:i + 12] for n in names[:40] if n for i in range(3)}
    df = spark.createDataFrame([(f"I{i:02}", n) for i, n in enumerate(names)], "instrumentId string, name string")
    probes = spark.createDataFrame([(t,) for t in texts], "probe string")
    got = {r.probe: r.instrumentId for r in resolve.containing(probes, df, F.col("name"), "instrumentId").collect()}
    want = {t: min(hits) for t in texts if t
            for hits in [[f"I{i:02}" for i, n in enumerate(names) if n and t in n]] if hits}
    assert got == want


def test_resolver_starts_no_job_while_built(spark):
    inst = spark.createDataFrame([("INST_1", "A", "x" * 400, True)],
                                 "instrumentId string, symbol string, name string, isActive boolean")
    refs = spark.createDataFrame([("xxx",)], "ref string")
    spark.sparkContext.setJobGroup("build", "resolver")
    resolve.resolve_instruments(refs, inst)
    assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("build")) == []


def _buckets(spark, rows):
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, seq long")
    out = temporal.split_hot(df, temporal.hot_keys(df, "k", 10), "k", "ts", "seq", 10).collect()
    held = {}
    for r in sorted(out, key=lambda r: (r.ts, r.seq)):
        held.setdefault(r._b, []).append(r)
    assert list(held) == sorted(held)  # buckets follow the order of (ts, seq)
    return held


def test_hot_burst_within_a_second_is_split(spark):
    t = T0 + dt.timedelta(hours=1)
    held = _buckets(spark, [("H", t + dt.timedelta(microseconds=i), i) for i in range(1000)])
    assert len(held) >= 100 and max(map(len, held.values())) <= 10


def test_changes_at_one_instant_are_split(spark):
    held = _buckets(spark, [("H", T0, i) for i in range(1000)] + [("H", T0 + dt.timedelta(days=i), i) for i in range(1, 30)])
    at_once = {b: rows for b, rows in held.items() if rows[0].ts == T0}
    assert len(at_once) == 100 and max(map(len, at_once.values())) == 10


def test_dense_half_of_a_wide_time_range_is_split(spark):
    rows = [("H", T0 + dt.timedelta(days=i), i) for i in range(500)]
    rows += [("H", T0 + dt.timedelta(days=90, microseconds=i), i) for i in range(500)]
    assert max(map(len, _buckets(spark, rows).values())) <= 20


def test_the_largest_keys_are_split_up_to_their_bound(spark, monkeypatch):
    df = spark.createDataFrame([("A" if i < 60 else f"K{i % 8}", T0, i) for i in range(100)],
                               "k string, ts timestamp_ntz, seq long")
    assert temporal.hot_keys(df, "k", 1).count() == 9
    monkeypatch.setattr(temporal, "MAX_HOT_KEYS", 1)
    assert [r.k for r in temporal.hot_keys(df, "k", 1).collect()] == ["A"]
    assert temporal.hot_keys(df, "k", 60) is None


def test_trend_counts_equal_records_once_each(spark):
    rows = [("I", "S", T0, "old", 10.0)] + [("I", "S", T0 + dt.timedelta(days=1), "same", 10.0)] * 3
    df = spark.createDataFrame(rows, "instrumentId string, dataSourceId string, dataTimestamp timestamp_ntz, seriesId string, close double")
    r = _one(series.trend(df, days=2))
    assert (r["count"], r.recentAvg, r.olderAvg, r.trend, r.changePercent) == (4, 10.0, 10.0, "stable", 0.0)


@pytest.mark.parametrize("n", [2, 999])
def test_rank_selection_finds_both_medians(spark, n):
    import random
    import statistics
    prices = [round(random.Random(n).gauss(0, 1) ** 3, 6) for _ in range(n)]
    prices += prices[: n // 3] + [prices[0]] * (n // 2)  # one price holds a third of the rows
    rows = [("H", "S", T0, f"s{i}", p) for i, p in enumerate(prices)] + [(None, "S", T0, f"c{i}", float(i)) for i in range(3)]
    df = spark.createDataFrame(rows, "instrumentId string, dataSourceId string, dataTimestamp timestamp_ntz, seriesId string, close double")
    for per_range in (10, 10 ** 6):
        got = {r.instrumentId: r for r in series.series_stats(df, rows_per_range=per_range).collect()}
        assert got["H"].medianPrice == statistics.median(prices) and got[None].medianPrice == 1.0
        tool = {r.instrumentId: r for r in series.series_stats_tool(df, rows_per_range=per_range).collect()}
        assert tool["H"].medianPrice == statistics.median_high(prices)


def test_append_by_load_is_seen_once_and_only_when_published(spark):
    from tickvault.operators.commits import published
    path = scratch_path(spark, "t-loads")
    row = spark.createDataFrame([("s", "I", "S", T0, 1.0)], "seriesId string, instrumentId string, dataSourceId string, dataTimestamp timestamp_ntz, close double")
    assert [ingest.append_series(row, path, "a"), ingest.append_series(row, path, "a")] == [1, 1]
    ingest._write_series(row, f"{path}/load=load-b", "overwrite")  # a load that failed before it was published
    assert ingest.read_series(spark, path).count() == 1 and set(published(spark, path)) == {"load-a"}
    assert ingest.append_series(row, path, "b") == 1 and ingest.read_series(spark, path).count() == 2
    assert ingest.append_series(row.limit(0), path, "none") == 0 and ingest.read_series(spark, path).count() == 2
    with pytest.raises(ValueError):
        ingest.append_series(row, path, "../x")


def test_merged_batches_equal_the_fold_and_leave_other_buckets_alone(spark):
    import random
    from tickvault.operators import version_store
    rnd, root = random.Random(5), scratch_path(spark, "t-store")
    rows = [(f"K{rnd.randrange(6)}", T0 + dt.timedelta(hours=rnd.randrange(12)), i,
             rnd.choice(["register", "delete", "restore"])) for i in range(240)]
    rnd.shuffle(rows)
    schema = "instrumentId string, ts timestamp_ntz, event_id long, op string"
    feed = spark.createDataFrame(rows, schema)
    parts = [rows[:100], [], rows[100:180], [r for r in rows[180:] if r[0] == "K1"], [r for r in rows[180:] if r[0] != "K1"]]
    for i, part in enumerate(parts):
        before = set(version_store.read_versions(spark, root).inputFiles()) if i else set()
        version_store.merge_changes(spark.createDataFrame(part, schema), root, f"b{i}", buckets=4)
        after = set(version_store.read_versions(spark, root).inputFiles())
        if i == 1:
            assert after == before
        if i == 3:  # one key: the files of the other buckets stay
            assert len({f.split("bucket=")[1][0] for f in after - before}) == 1 and before & after
    want = temporal.apply_changes(feed)
    got = version_store.read_versions(spark, root).select(*want.columns)
    key = lambda r: (r.instrumentId, r.validFrom, r.event_id)
    assert sorted(got.collect(), key=key) == sorted(want.collect(), key=key)


def test_row_identity_tells_copies_apart_without_a_shuffle(spark):
    path = scratch_path(spark, "t-rows")
    spark.createDataFrame([("P", "I", 1.0, 2.0, T0)] * 5, "portfolioId string, instrumentId string, quantity double, averageCost double, "
                          "acquiredDate timestamp_ntz").coalesce(1).write.parquet(path)
    out = ingest.add_holdings(ingest.with_row_identity(spark.read.parquet(path)), row_id="rowId")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("FileScan") == 1 and "ExistingRDD" not in plan
    assert len({r.holdingId for r in out.collect()}) == 5


def test_open_indicators_are_split_and_malformed_lines_kept(spark, tmp_path):
    from tickvault.schemas import RAW_SERIES_RECORD
    good = '{"instrumentId":"I","dataSourceId":"S","dataTimestamp":"2024-01-01","indicators":%s}'
    lines = [good % '{"close":1.5,"rating":"AA"}', good % '{"close":1.5,"rating":"AB"}',
             good % '{"rating":"1D","n":"2","b":true,"z":null}', good % '{"close":"NaN"}', good % "{}", "no record {"]
    (tmp_path / "in.json").write_text("\n".join(lines))
    raw = spark.read.schema(RAW_SERIES_RECORD).json(str(tmp_path))
    valid, rejects = ingest.validate_series(raw, "2024-02-01 00:00:00")
    rows = sorted(valid.collect(), key=lambda r: (r.close is None, r.texts["rating"]))
    assert [(r.close, r.extras, r.texts) for r in rows] == [
        (1.5, {}, {"rating": "AA"}), (1.5, {}, {"rating": "AB"}),
        (None, {"n": 2.0}, {"rating": "1D", "b": "true", "z": None})]
    assert len({r.seriesId for r in rows}) == 3
    assert sorted((r.reject_reason, r._corrupt_record) for r in rejects.collect()) == [
        ("malformed record", "no record {"), ("missing indicators", None), ("non-finite close", None)]


def test_external_json_keeps_text_and_nested_values(spark):
    p = spark.createDataFrame([('{"symbol":"A","close":1,"pe":3,"rating":"AA","deep":{"x":1}}',)], "payload string")
    r = _one(vendor.normalise_external_json(p, "2024-02-01 00:00:00")[0])
    assert r.extras == {"pe": 3.0} and r.texts == {"rating": "AA", "deep": '{"x":1}'}


def test_cuts_of_a_hot_key_are_searched_once_a_row(spark):
    from tickvault.operators import temporal
    rows = spark.range(400).selectExpr("'a' as k", "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id) as t", "id as s")
    hot = temporal.hot_keys(rows, "k", 20)
    split = temporal.split_hot(rows, hot, "k", "t", "s", 20).select("k", "s", "_b")
    plan = split._jdf.queryExecution().optimizedPlan().toString()
    # two searches (for the sizes of buckets, for the rows): the steps of the cuts, named twice in a
    # search beside the slice of the cuts
    assert plan.count("filter(") <= 8
    sizes = [r["count"] for r in split.groupBy("_b").count().collect()]
    assert sum(sizes) == 400 and max(sizes) <= 20


def test_copies_are_counted_without_a_stored_numbering(spark, monkeypatch):
    """Rows without a column beside their key: no checkpoint and no window, the same ids as by numbering."""
    from tickvault.functions.columns import surrogate_key
    day, nan = dt.date(2024, 1, 1), float("nan")
    some = [("P", "I", 1.0, None, day)] * 3 + [(None, None, None, None, None)] * 2 + [("P", "I", nan, 2.0, day)] * 2 + [("Q", "I", 1.0, 2.0, day)]
    rows = some + [("P", "HOT", 0.5, 2.0, None)] * 23 + [("P", "Z", 0.0, 0.0, day)] * 2 + [("P", "Z", 0.0, -0.0, day)]
    schema = "portfolioId string, instrumentId string, quantity double, averageCost double, acquiredDate date"
    df = spark.createDataFrame(rows, schema).repartition(5)
    numbers = spark.createDataFrame([(*r, i) for i in range(1, 24) for r in {str(r): r for r in rows}.values()], schema + ", _ordinal long")
    ids = {r.id for r in numbers.select(surrogate_key("HOLD_", *df.columns, "_ordinal").alias("id")).collect()}
    for copies in (4, 11, 1 << 12):
        monkeypatch.setattr(ingest, "COPIES", copies)
        out = ingest.add_holdings(df.withColumn("note", F.lit("no part of the key")))
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "_split" not in plan and "Join" not in plan
        got = out.collect()
        assert sorted(str(tuple(r)[1:]) for r in got) == sorted(map(str, rows))
        assert len({r.holdingId for r in got}) == len(rows)
        assert {r.holdingId for r in got} <= ids


def test_copies_that_differ_beside_their_key_keep_their_rows(spark):
    day = dt.date(2024, 1, 1)
    rows = [("P", "I", float(i % 3), float(i), day) for i in range(12)]
    df = spark.createDataFrame(rows, "portfolioId string, instrumentId string, quantity double, averageCost double, acquiredDate date")
    got = ingest.add_holdings(df, natural_key=["portfolioId", "quantity"]).collect()
    assert sorted(tuple(r)[1:] for r in got) == sorted(rows) and len({r.holdingId for r in got}) == 12


def test_ids_of_several_rows_are_counted(spark, monkeypatch):
    """The query on ids of which one stands for several rows, and one has another form."""
    from tickvault.plans import ingest_queries
    day = dt.date(2024, 1, 1)
    rows = [(i, "P", "I", float(n), None, day) for n, i in enumerate(["HOLD_0123456789AB"] * 3 + ["HOLD_0123456789AC", "HOLD_xyz", "HOLD_xyz", "LOT_0123456789AB"])]
    held = spark.createDataFrame(rows, "holdingId string, portfolioId string, instrumentId string, quantity double, averageCost double, acquiredDate date")
    monkeypatch.setattr(ingest_queries.driver, "holdings", lambda spark, sf: held.drop("holdingId"))
    monkeypatch.setattr(ingest_queries.ops, "add_holdings", lambda df: held)
    got = {r.quantity: (r.idFormed, r.rowsWithId) for r in ingest_queries.q_add_holdings(spark, "").collect()}
    assert got == {0.0: (True, 3), 1.0: (True, 3), 2.0: (True, 3), 3.0: (True, 1), 4.0: (False, 2), 5.0: (False, 2), 6.0: (False, 1)}
