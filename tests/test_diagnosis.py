import random

import pytest
from frames import (DROP, SETUP, accesses, at, blers, events_with_context, report, samples,
                    seconds, signals, sync)
from pyspark.sql import functions as F

from callcause import schemas as S
from callcause.operators import handover as H, signalling as G, windows as W
from callcause.plans import diagnosis as D
from callcause.plans.services import diagnose_services
from callcause.profile import Profile

P = Profile(slice_seconds=40)


def probe_tables(spark, log=None, meas=(), sig=(), rach=(), phy=()):
    log = log or [(0, SETUP, 1, 0.5), (100, DROP, 2, 1.5)]
    return D.ProbeTables(events_with_context(spark, log), samples(spark, meas), signals(spark, sig),
                         accesses(spark, rach), blers(spark, phy))


def analysis(tables, profile=P, keep=None):
    return [r.Analysis for r in D.diagnose(tables, profile, keep).orderBy(W.END, "WorkOrderId").collect()]


BAD = (1, 7, -120.0, 4.0)
CALM = [(10, "5GNR x", 1, None)]
FINE = [(1, 1, 7, -80.0, 4.0)]


def test_tags_follow_their_times(spark):
    bler_first = probe_tables(spark, meas=[(20, *BAD)], sig=CALM, phy=[(10, 90.0)])
    radio_first = probe_tables(spark, meas=[(20, *BAD)], sig=CALM, phy=[(30, 90.0)])
    assert analysis(bler_first) == ["High Physical DL BLER, Poor RF condition"]
    assert analysis(radio_first) == ["Poor RF condition, High Physical DL BLER"]


def test_equal_times_follow_the_fixed_order(spark):
    tables = probe_tables(spark, meas=[(20, *BAD)], sig=[(20, "AT&T", 1, None)], phy=[(20, 90.0)])
    assert analysis(tables) == ["Poor RF condition, UE on Roaming, High Physical DL BLER"]


def test_nothing_found_and_nothing_logged(spark):
    assert analysis(probe_tables(spark, meas=FINE, sig=CALM)) == ["Unidentified"]
    assert analysis(probe_tables(spark, log=[(5, DROP, 1, 0.0)])) == ["Lost UE, Missing Signalling"]


STORY = dict(
    meas=[(60, *BAD)],
    sig=[(5, S.REESTABLISH_REQUEST, 1, None), (50, S.REPORT, 1, report()), (30, "T-Mobile", 1, None)],
    rach=[(40, 0, None), (41, None, None)], phy=[(70, 50.0)])


def test_v1_keeps_a_fixed_order_and_more_evidence(spark):
    tables = probe_tables(spark, **STORY)
    v2 = D.diagnose(tables, P, None).first()
    assert v2.Analysis == ("rrcReestablishment Failure, UE on Roaming, RACH failure, Handover failure, "
                           "Missing neighbor relation, Poor RF condition, High Physical DL BLER")
    v1 = D.diagnose(tables, P.with_(version="v1"), None).first()
    assert v1.Analysis == ("Poor RF condition, UE on Roaming, Handover failure, RACH failure, "
                           "rrcReestablishment Failure")
    calm = probe_tables(spark, meas=FINE, sig=[*CALM, (0.5, S.REPORT, 1, report())])
    v2, v1 = (D.diagnose(calm, P.with_(version=v), None).first() for v in ("v2", "v1"))
    assert (v1.NR5G_PCC_RSRP_Avg, v1.NR5G_PCC_PCI_Last, v1.NR5G_PCC_RSRP_Last) == (-80.0, "7", -80.0)
    assert (v2.NR5G_PCC_RSRP_Avg, v2.NR5G_PCC_PCI_Last, v2.Analysis) == (None, None, "Unidentified")


def pingpong_rows():
    return [row for start in (10, 13, 16) for row in (
        (start, S.RECONFIGURATION, 1, sync(2)), (start + 1, S.RECONFIGURATION_COMPLETE, 3, None),
        (start + 2, "systemInformationBlockType1", 3, None))]


def test_pingpong_spelling_and_switch(spark):
    tables = probe_tables(spark, meas=FINE, sig=pingpong_rows())
    assert analysis(tables) == ["PingPong Handover"]
    assert analysis(tables, P.with_(version="v1")) == ["Ping_Pong Handover"]
    assert analysis(tables, P.with_(legacy_pingpong_v2=True)) == ["Unidentified"]


def test_context_is_one_row_per_window(spark):
    log = [(0, SETUP, 1, 0.5), (100, DROP, 9, 1.5), (100, "other", 4, 2.5), (50, "other", 3, 3.5)]
    rows = D.reference_columns(W.failure_windows(events_with_context(spark, log), P),
                               events_with_context(spark, log), P).collect()
    assert [(seconds(r.Time), r.MsgId, r.Latitude) for r in rows] == [(100, 4, 2.5)]


def test_keeping_frames_changes_nothing_and_columns_fit_the_schema(spark):
    tables = probe_tables(spark, **STORY)
    plain, kept = D.diagnose(tables, P, None), D.diagnose(tables, P)
    assert plain.exceptAll(kept).count() == 0 and kept.count() == 1
    assert sorted(kept.columns) == sorted(f.name for f in S.DIAGNOSIS_V2)
    v1 = D.diagnose(tables, P.with_(version="v1"), None)
    assert sorted(v1.columns) == sorted(f.name for f in S.DIAGNOSIS_V1)


@pytest.mark.parametrize("partitions,adaptive", [(1, True), (4, False), (64, True)])
def test_order_and_partitions_do_not_matter(spark, partitions, adaptive):
    expected = analysis(probe_tables(spark, **STORY))
    before = {n: spark.conf.get(n) for n in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        shuffled = {name: rows[::-1] for name, rows in STORY.items()}
        assert analysis(probe_tables(spark, **shuffled)) == expected
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def test_services_together_and_stacked_agree(spark):
    log = [(t, text, n, 0.0, 1, device) for device in (1, 2, 3, 4) for n, (t, text) in
           enumerate([(0, SETUP), (10 + device, DROP)])]
    tables = probe_tables(spark, log=log, meas=[(11, *BAD, 1, 2)], sig=CALM)
    devices = spark.createDataFrame([("DL", 1), ("DL", 2), ("UL", 3), ("VOICE", 4)], "ServiceName string, Device int")
    one = diagnose_services(tables, devices, ["DL", "UL"], P)
    two = diagnose_services(tables, devices, ["DL", "UL"], P, stacked=True)
    assert sorted(r.Device for r in one.collect()) == [1, 2, 3]
    assert one.exceptAll(two).count() == 0 and two.exceptAll(one).count() == 0


def test_no_nested_loops_and_no_python_in_the_diagnosis(spark):
    plan = D.diagnose(probe_tables(spark, **STORY), P)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan


def test_many_windows_are_joined_by_shuffle(spark):
    tables = probe_tables(spark, **STORY)
    expected = analysis(tables)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        found = D.diagnosis_v2(D.joined_facts(tables, P), P)
        plan = found._jdf.queryExecution().executedPlan().toString()
        joins = [line for line in plan.splitlines() if "Join" in line and "_slice" in line]
        assert joins and all("SortMergeJoin" in line for line in joins)
        assert [r.Analysis for r in found.collect()] == expected
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def _shuffled(rows, seed):
    rows = list(rows)
    random.Random(seed).shuffle(rows)
    return rows


@pytest.mark.parametrize("chunk", [None, 5])
def test_equal_instants_in_any_input_order(spark, chunk):
    """Everything happens in a few instants; message numbers, or the rows themselves, order it."""
    source = random.Random(3)
    log = [(source.choice([0, 10, 20]), source.choice([SETUP, DROP, '"Call End"', "other"]), n, float(n)) for n in range(30)]
    sig = [(source.choice([0, 5, 10, 15]), event, source.randrange(3), text) for event, text in
           [(S.REPORT, report()), (S.RECONFIGURATION, sync(2)), (S.RECONFIGURATION_COMPLETE, None),
            ("systemInformationBlockType1", None), (S.REESTABLISH_REQUEST, None)] * 8]
    meas = [(source.choice([0, 5, 10]), 1, source.randrange(3), -100.0 - n, 1.0) for n in range(20)]
    answers = []
    for seed in (1, 2):
        tables = probe_tables(spark, log=_shuffled(log, seed), meas=_shuffled(meas, seed), sig=_shuffled(sig, seed))
        rows = D.diagnose(tables, P.with_(chunk_seconds=chunk), None).collect()
        answers.append(sorted(map(str, rows)))
    assert answers[0] == answers[1] and len(answers[0]) > 3


@pytest.mark.parametrize("version,seed", [("v2", 1), ("v2", 2), ("v1", 3)])
def test_the_stream_and_the_joins_agree(spark, version, seed):
    """Shared instants, several keys, markers without a time, and windows without a start."""
    source = random.Random(seed)
    times = [0, 3, 3, 5, 8, 10, 12, 15, 15, 20, None]
    log = [(source.choice(times), source.choice([SETUP, DROP, '"Call End"', "other"]), n, float(n), source.choice([1, 2])) for n in range(50)]
    sig = [(source.choice(times[:-1]) + source.random(), event, source.randrange(3), text, source.choice([1, 2])) for event, text in
           [(S.REPORT, report()), (S.REPORT, report()), (S.RECONFIGURATION, sync(2)), (S.RECONFIGURATION_COMPLETE, None),
            ("systemInformationBlockType1", None), (S.REESTABLISH_REQUEST, None), ("MCC : 310 T-Mobile", None)] * 12]
    meas = [(source.choice(times), 1, source.randrange(3), -100.0 - n, 1.0, source.choice([1, 2])) for n in range(40)]
    rach = [(source.choice(times), source.choice([0, 1, None]), source.choice([0, 1, None]), source.choice([1, 2])) for _ in range(30)]
    tables = probe_tables(spark, log=log, meas=meas, sig=sig, rach=rach, phy=[(t, 5.0 + n) for n, t in enumerate(times)])
    profile = P.with_(version=version)
    finish = D.diagnosis_v2 if version == "v2" else D.diagnosis_v1

    def rows(found):
        return {(r.WorkOrderId, r.Failed_Event_Number): r for r in found.collect()}

    one = rows(D.diagnose(tables, profile))
    assert one == rows(finish(D.joined_facts(tables, profile), profile)) and len(one) > 8
    assert one == rows(D.diagnose(tables, profile.with_(max_series_rows=20)))


def test_the_stream_needs_one_exchange_and_no_join(spark):
    found = D.diagnose(probe_tables(spark, **STORY), P)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", False)
        plan = found.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_a_window_with_a_successful_handover_is_never_stuck(spark):
    """So the success is left out where only the tag counts: it cannot change a row."""
    source = random.Random(7)
    rows = []
    for _ in range(40):
        start = source.randrange(5, 90)
        rows += [(start, S.RECONFIGURATION, 1, sync(2)), (start + 1, S.RECONFIGURATION_COMPLETE, source.choice([2, 3]), None),
                 (start + 2, "systemInformationBlockType1", 2, None), (source.randrange(100), S.REPORT, 1, report())]
    found = probe_tables(spark, meas=[(60, *BAD)], sig=rows)
    windows = W.failure_windows(found.events, P)
    tagged = G.tagged_signalling(windows, found.signalling, P)
    stretch = H.last_stretch_facts(windows, G.signalling_facts(tagged, P), found.measurements, P)
    success = H.handover_success(tagged, P)
    assert success.count() == 1
    assert stretch.filter(H.stuck_on_cell(P, exact=False)).join(success, list(P.event_key)).count() == 0


def test_one_instant_with_several_tags_of_unknown_time_first(spark):
    frame = spark.createDataFrame([(None, at(5))], "a timestamp, b timestamp")
    tags = D.ordered_tags([(F.lit(True), F.col("b"), "one"), (F.lit(True), F.col("a"), "two"),
                           (F.lit(False), F.col("a"), "three"), (F.lit(True), F.col("b"), "four")])
    assert frame.select(tags.alias("t")).first().t == "two, one, four"
