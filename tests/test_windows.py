import pytest
from pyspark.sql import functions as F
from frames import DROP, END, SETUP, events, samples, seconds

from callcause.operators import windows as W
from callcause.profile import Profile
from callcause.session import settle

P = Profile(slice_seconds=7)


def spans(frame):
    return sorted((r.WorkOrderId, r.Failed_Event_Number, seconds(r[W.START]), seconds(r[W.END]))
                  for r in frame.collect())


@pytest.mark.parametrize("chunk,longest", [(None, 1), (3, 1), ("auto", 1_000), ("auto", 2)])
def test_window_starts_at_the_marker_before(spark, chunk, longest):
    log = events(spark, [(0, SETUP), (2, "ping"), (10, DROP), (20, "Voice Drop"), (30, END), (31, "Setup Start"),
                         (45, DROP), (50, None)])
    found = W.failure_windows(log, P.with_(chunk_seconds=chunk, max_series_rows=longest).sized(log, settle))
    assert ("_slice" in found._jdf.queryExecution().toString()) is (chunk == 3 or longest == 2)
    assert spans(found) == [(1, 1, 0, 10), (1, 2, 10, 20), (1, 3, 30, 45)]


def test_first_marker_has_no_start_and_work_orders_do_not_mix(spark):
    log = events(spark, [(1, SETUP, 1), (2, DROP, 2), (3, SETUP, 2), (8, DROP, 1), (9, DROP, 2)])
    assert spans(W.failure_windows(log, P)) == [(1, 1, 1, 8), (2, 1, None, 2), (2, 2, 3, 9)]


def test_marker_text_is_a_setting(spark):
    log = events(spark, [(0, SETUP), (5, "Data Traffic Fail"), (6, DROP)])
    fails = W.failure_windows(log, P.with_(marker="Traffic Fail")).collect()
    assert [(r.Failed_Event_Type, seconds(r[W.START])) for r in fails] == [("Data Traffic Fail", 0)]


def rows_of(frame):
    return sorted((r.Failed_Event_Number, seconds(r.Time)) for r in frame.collect() if r.Time is not None)


@pytest.fixture(scope="module")
def log(spark):
    return events(spark, [(0, SETUP), (10, DROP), (20, DROP), (30, END), (41, DROP), (50, SETUP)])


@pytest.fixture(scope="module")
def probes(spark):
    return samples(spark, [(t, 1, 1, -100.0, 5.0) for t in (-1, 0, 5, 10, 15, 20, 25, 30, 41, 42)]
                   + [(5, 1, 1, -90.0, 1.0, 2)])


INNER = [(1, 0), (1, 5), (1, 10), (2, 10), (2, 15), (2, 20), (3, 30), (3, 41)]


def test_both_ends_belong_to_a_window_and_shared_borders_to_two(log, probes):
    windows = W.failure_windows(log, P)
    assert rows_of(W.window_rows(windows, probes, P)) == INNER
    assert rows_of(W.window_rows_keyed(windows, probes, P)) == INNER


@pytest.mark.parametrize("chunk", [None, 4])
def test_linear_form_agrees(log, probes, chunk):
    found = W.window_rows_linear(log, probes, P.with_(chunk_seconds=chunk))
    assert rows_of(found) == INNER
    joined = W.window_rows(W.failure_windows(log, P), probes, P)
    columns = sorted(joined.columns)
    assert found.select(columns).exceptAll(joined.select(columns)).count() == 0


def test_linear_form_where_markers_share_instants(spark):
    """Several failures on one instant, a failure without a start, rows before, on and after every marker."""
    log = events(spark, [(0, DROP), (5, SETUP), (5, DROP), (5, DROP), (9, "x"), (10, DROP), (10, END), (10, DROP), (20, DROP),
                         (None, DROP), (30, END), (30, DROP), (40, "x")])
    probes = samples(spark, [(t, n, 1, -100.0, 5.0) for n, t in enumerate([-1, 0, 1, 5, 5, 7, 10, 15, 20, 25, 30, 35, None])])
    joined = W.window_rows(W.failure_windows(log, P), probes, P)
    found = W.window_rows_linear(log, probes, P)
    assert joined.count() >= 10
    assert found.select(joined.columns).exceptAll(joined).count() == 0 and joined.exceptAll(found.select(joined.columns)).count() == 0


def test_linear_form_deals_crowded_instants(spark):
    """Many windows and rows of one key on each of forty instants: no row carries the windows of its instant, and no task has all pairs."""
    log = events(spark, [(t, text) for t in range(0, 400, 10) for text in (SETUP, *[DROP] * 30, END, *["Voice Drop"] * 5)])
    probes = samples(spark, [(t - n % 2, n, 1, -100.0, 5.0) for t in range(0, 400, 10) for n in range(40)])
    found = W.window_rows_linear(log, probes, P)
    assert "collect_list" not in found._jdf.queryExecution().toString()
    joined = W.window_rows(W.failure_windows(log, P), probes, P)
    assert joined.count() >= 40 * 20 * 34
    assert found.select(joined.columns).exceptAll(joined).count() == 0 and joined.exceptAll(found.select(joined.columns)).count() == 0
    tasks = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert max(tasks) < 0.7 * sum(tasks)


def test_linear_form_without_keys(spark):
    log = events(spark, [(0, SETUP, None), (5, DROP, None), (5, DROP, None), (0, SETUP, 1, None), (5, DROP, 1, None), (0, SETUP), (5, DROP), (5, DROP)])
    probes = samples(spark, [(t, 1, 1, -100.0, 5.0, *key) for t in (3, 5) for key in ((None,), (1, None), (1, 1), (None, None))])
    for profile, count in ((P, 3), (P.with_(join_keys=("Device",)), 6)):
        joined = W.window_rows(W.failure_windows(log.filter("WorkOrderId is not null"), profile), probes, profile)
        found = W.window_rows_linear(log, probes, profile)
        assert found.count() == count and found.select(joined.columns).exceptAll(joined).count() == 0


def test_a_dense_slice_is_spread_over_parts_and_shares(spark):
    """Two hundred thousand rows in one slice of one key, half of them on one instant."""
    rows = settle(spark.range(200_000).selectExpr(
        "1 as WorkOrderId", "1 as Device", "id as n", "timestamp_micros(1704067200000000 + case when id % 2 = 0 then 3000000 else id * 30 end) as Time"))
    log = events(spark, [(t / 10, SETUP if t % 5 == 0 else DROP) for t in range(70)])
    windows = settle(W.failure_windows(log, P))
    profile = P.with_(max_slice_rows=5_000)
    found = W.window_rows(windows, rows, profile, keep=settle)
    plain = W.window_rows(windows, rows, P)
    key = ["Failed_Event_Number", "n"]
    assert found.count() == plain.count() > 150_000 and found.select(key).exceptAll(plain.select(key)).count() == 0
    dense = W.find_cuts(rows.withColumn("_slice", F.lit(0)), ["Device", "WorkOrderId", "_slice"], ("Time",), 5_000, settle)
    dealt = W._dealt(rows.withColumn("_slice", F.lit(0)), dense).groupBy("_part", "_share").count().collect()
    assert len(dealt) >= 40 and max(r["count"] for r in dealt) <= 6_500


@pytest.mark.parametrize("width", [1, 13, 10_000])
def test_slice_width_does_not_matter(log, probes, width):
    profile = P.with_(slice_seconds=width)
    assert rows_of(W.window_rows(W.failure_windows(log, P), probes, profile)) == INNER


def test_left_form_keeps_windows_without_rows(spark):
    log = events(spark, [(0, DROP), (5, SETUP), (9, DROP), (20, DROP)])
    probes = samples(spark, [(7, 1, 1, 0.0, 0.0)])
    found = W.window_rows(W.failure_windows(log, P), probes, P, "left").collect()
    assert sorted((r.Failed_Event_Number, seconds(r.Time)) for r in found if r.Time) == [(2, 7)]
    assert sorted(r.Failed_Event_Number for r in found if r.Time is None) == [1, 3]


def test_device_alone_lets_other_work_orders_in(log, probes):
    windows = W.failure_windows(log, P)
    wide = P.with_(join_keys=("Device",))
    assert rows_of(W.window_rows(windows, probes, wide)) == sorted([*INNER, (1, 5)])
    assert rows_of(W.window_rows_linear(log, probes, wide)) == sorted([*INNER, (1, 5)])


def test_event_messages_are_the_events_of_the_window(log):
    found = W.event_messages(log, P)
    assert rows_of(found) == [(1, 0), (1, 10), (2, 10), (2, 20), (3, 30), (3, 41)]


def test_no_nested_loop_and_no_python_in_the_plan(log, probes):
    plan = W.window_rows(W.failure_windows(log, P), probes, P, "left")
    text = plan._jdf.queryExecution().toString()
    assert "NestedLoop" not in text and "CartesianProduct" not in text and "Python" not in text
