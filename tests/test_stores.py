"""Stores: results by day, probe tables by device group, decoded messages."""

from dataclasses import replace

import pytest
from frames import DROP, SETUP, accesses, at, blers, config, events_with_context, report, samples, signals, sync, wide_signals

from callcause import schemas as S
from callcause.operators import relations, signalling as G
from callcause.plans import updates
from callcause.plans.diagnosis import ProbeTables, diagnose
from callcause.profile import Profile
from callcause.session import new_path, settle
from callcause.sources import store

P = Profile(slice_seconds=50)
DAY = 86_400


def tables(spark, log, meas=(), sig=((1, "5GNR x", 1, None),)):
    return ProbeTables(events_with_context(spark, log), samples(spark, meas), signals(spark, sig),
                       accesses(spark, []), blers(spark, []))


def files(spark, place):
    import glob
    return {path: path for path in glob.glob(place.removeprefix("file:") + "/*/*.parquet")}


LOG = [(10, SETUP, 1, 0.0), (50, DROP, 2, 0.0), (DAY + 10, SETUP, 3, 0.0), (DAY + 40, DROP, 4, 0.0),
       (20, SETUP, 5, 0.0, 2), (60, DROP, 6, 0.0, 2), (DAY + 20, DROP, 7, 0.0, 2), (2 * DAY + 5, DROP, 8, 0.0, 2)]


def as_rows(frame):
    return sorted(str(r) for r in frame.select(*sorted(frame.columns)).collect())


def test_new_rows_of_one_day_rewrite_that_day_alone(spark):
    place = new_path(spark, "days")
    updates.write_days(diagnose(tables(spark, LOG), P), place)
    before = files(spark, place)
    assert len({path.split("/")[-2] for path in before}) == 3
    more = [(2 * DAY + 30, DROP, 9, 0.0, 2), (2 * DAY + 31, DROP, 10, 0.0, 3)]
    days = updates.renew_days(tables(spark, LOG + more), tables(spark, more, sig=()), place, P)
    assert [str(r[0]) for r in days.collect()] == ["2024-01-03"]
    kept = {path for path in files(spark, place) if "2024-01-03" not in path}
    assert kept == {path for path in before if "2024-01-03" not in path}
    expected = updates.by_day(diagnose(tables(spark, LOG + more), P))
    assert as_rows(updates.read_days(spark, place).select(expected.columns)) == as_rows(expected)


def test_a_late_row_renews_all_later_days_of_its_series(spark):
    """An early failure of one series shifts the numbers of its later ones; other series stay."""
    place = new_path(spark, "days")
    updates.write_days(diagnose(tables(spark, LOG), P), place)
    more = [(30, DROP, 11, 0.0, 2), (None, DROP, 12, 0.0, 1)]
    updates.renew_days(tables(spark, LOG + more), tables(spark, more, sig=()), place, P)
    expected = updates.by_day(diagnose(tables(spark, LOG + more), P))
    assert as_rows(updates.read_days(spark, place).select(expected.columns)) == as_rows(expected)


def test_a_day_without_rows_goes(spark):
    place = new_path(spark, "days")
    first = [(10, SETUP, 1, 0.0), (DAY + 5, DROP, 2, 0.0)]
    updates.write_days(diagnose(tables(spark, first), P), place)
    changed = [(10, SETUP, 1, 0.0), (2 * DAY, DROP, 2, 0.0)]
    updates.renew_days(tables(spark, changed), tables(spark, [(20, "x", 3, 0.0)], sig=()), place, P)
    assert [str(r.Failure_Day) for r in updates.read_days(spark, place).collect()] == ["2024-01-03"]


def test_chosen_devices_read_their_groups_alone(spark):
    place = new_path(spark, "store")
    log = [(t, text, d, 0.0, 1, d) for d in range(40) for t, text in ((0, SETUP), (50, DROP))]
    whole = tables(spark, log, [(5, 1, 1, -120.0, 1.0, 1, d) for d in range(40)])
    store.write_store(whole, place, P, groups=16)
    devices = spark.createDataFrame([(d, "DL" if d in (3, 4) else "UL") for d in range(40)], "Device int, ServiceName string")
    found = store.stored_devices(store.open_store(spark, place), devices.filter("ServiceName = 'DL'"), P, groups=16)
    assert sorted((r.Device, r.WorkOrderId) for r in found.measurements.collect()) == [(3, 1), (4, 1)]
    plan = found.measurements._jdf.queryExecution()
    assert "dynamicpruning" in plan.executedPlan().toString()
    scan = found.measurements
    scan.collect()
    leaves = scan._jdf.queryExecution().executedPlan().collectLeaves()
    read = [leaf.metrics().get("numPartitions").get().value() for leaf in (leaves.apply(i) for i in range(leaves.size()))
            if leaf.metrics().contains("numPartitions")]
    assert not read or max(read) <= 2
    assert sorted(r.Device for r in diagnose(found, P).collect()) == [3, 4]


def test_one_store_of_decoded_messages_serves_both_jobs(spark):
    rows = [(1, "5GNR rrcSetupRequest", 1, 9, None), (2, S.RECONFIGURATION, 1, 9, config()), (3, S.REPORT, 1, 9, report()),
            (4, S.REPORT, 1, 9, report(cells=None)), (5, S.RECONFIGURATION, 1, 9, sync(2)), (6, S.REPORT, 1, 9, "{broken"),
            (7, S.RECONFIGURATION_COMPLETE, 2, 9, None), (8, "LTE measurementReport", 1, 9, report()), (9, None, 1, 9, None)]
    raw = wide_signals(spark, rows)
    decoded = settle(G.decode(raw, P))
    assert as_rows(G.narrow(decoded, P)) == as_rows(G.narrow(raw, P))
    found = relations.suspected_missing_relations(decoded, P)
    assert as_rows(found) == as_rows(relations.suspected_missing_relations(raw, P))
    assert "from_json" not in relations.decode_messages(relations.event_token(decoded, P), P)._jdf.queryExecution().toString()
    whole = tables(spark, LOG)
    one = diagnose(replace(whole, signalling=decoded), P)
    assert as_rows(one) == as_rows(diagnose(replace(whole, signalling=raw), P))
