import pytest
from frames import (DROP, SETUP, accesses, blers, config, events, one_window, report, samples, seconds,
                    signals, sync)

from callcause import schemas as S
from callcause.operators import access, handover, radio as R, signalling as G, windows as W
from callcause.profile import Profile

P = Profile(slice_seconds=50)
V1 = P.with_(version="v1")


def radio_tags(spark, values, profile=P):
    meas = samples(spark, [(10 + i, 1, 1, rsrp, sinr) for i, (rsrp, sinr) in enumerate(values)])
    facts = R.radio_facts(one_window(spark, profile), meas, profile)
    return R.radio_condition(facts, profile).collect(), R.lost_signal(facts, profile).collect()


@pytest.mark.parametrize("values,poor", [
    ([(-110.01, 5.0)], True), ([(-100.0, -0.01)], True), ([(-110.0, 0.0)], False),
    ([(-110.004, 1.0)], False), ([(-120.0, 10.0), (-90.0, 10.0)], False), ([(None, -1.0)], True)])
def test_poor_radio_compares_rounded_averages(spark, values, poor):
    tagged, lost = radio_tags(spark, values)
    assert bool(tagged) is poor and not lost


def test_poor_radio_evidence_and_time(spark):
    meas = samples(spark, [(5, 20, 9, -100.0, 3.0), (7, 3, 10, -130.0, 3.0), (9, 20, 9, -120.0, None),
                           (200, 1, 1, -1.0, 1.0)])
    facts = R.radio_facts(one_window(spark, P), meas, P)
    row = R.radio_condition(facts, P).first()
    assert (row[R.CHANNELS], row[R.CELLS]) == ("3, 20", "9, 10")
    assert (row[R.RSRP_AVG], row[R.RSRP_MIN], row[R.SINR_AVG], row[R.SINR_MIN]) == (-116.67, -130.0, 3.0, 3.0)
    assert seconds(row[R.TAG_TIME]) == 7 and row[R.TAG] == S.POOR_RADIO


def test_lost_signal_needs_both_averages_missing(spark):
    for values in ([], [(None, None)]):
        tagged, lost = radio_tags(spark, values)
        assert not tagged and [seconds(r[R.TAG_TIME]) for r in lost] == [0]
    assert radio_tags(spark, [(-90.0, None)])[1] == []


def test_v1_names_lost_signal_in_the_radio_column(spark):
    (row,), _ = radio_tags(spark, [], V1)
    assert row[R.TAG] == S.LOST_SIGNAL and row[R.CELLS] == ""


def test_null_start_is_lost_and_unsignalled_at_no_time(spark):
    windows = W.failure_windows(events(spark, [(5, DROP)]), P)
    meas, sig = samples(spark, [(5, 1, 1, -1.0, 1.0)]), signals(spark, [(5, S.REPORT, 1, None)])
    lost = R.lost_signal(R.radio_facts(windows, meas, P), P).first()
    facts = G.signalling_facts(G.tagged_signalling(windows, sig, P), P)
    missing = G.missing_signalling(windows, facts, P).first()
    assert lost[R.TAG_TIME] is None and missing[R.TAG_TIME] is None


def facts_of(spark, rows, profile=P):
    windows = one_window(spark, profile)
    tagged = G.tagged_signalling(windows, signals(spark, rows), profile)
    return windows, tagged, G.signalling_facts(tagged, profile)


def test_missing_signalling(spark):
    windows, _, facts = facts_of(spark, [(101, "x", 1, None)])
    assert [seconds(r[R.TAG_TIME]) for r in G.missing_signalling(windows, facts, P).collect()] == [0]
    windows, _, facts = facts_of(spark, [(50, None, None, None)])
    assert G.missing_signalling(windows, facts, P).count() == 0


def test_roaming_and_network_code(spark):
    text = "x" * 34 + "MCC : 310 MNC : 260 and so on until the end"
    rows = [(3, text, 1, None), (4, "on AT&T", 1, None), (2, "T-Mobile", 1, None)]
    row = G.roaming(facts_of(spark, rows)[2], P).first()
    assert seconds(row[R.TAG_TIME]) == 2 and row.MCC_MNC == text[34:34 + 37]
    facts = facts_of(spark, rows[:1])[2]
    assert G.roaming(facts, P).count() == 0
    kept = G.roaming(facts, V1).first()
    assert kept.MCC_MNC == text[34:71] and kept[R.TAG] is None


@pytest.mark.parametrize("event,message,expected", [
    (S.REPORT, report(), ("Check1", "Check1")), (S.REPORT, report(cells=None), (None, "")),
    (S.RECONFIGURATION, sync(11), ("Check2", "Check2")),
    (S.RECONFIGURATION, config(with_sync=True), ("Check2", "Check2_6")),
    (S.RECONFIGURATION, config(), (None, "6")), (S.RECONFIGURATION, config(offset=None), (None, "")),
    (S.RECONFIGURATION, "{broken", (None, "")), (S.RECONFIGURATION, None, (None, "")),
    (S.RECONFIGURATION_COMPLETE, sync(3), (None, None))])
def test_message_class(spark, event, message, expected):
    row = G.narrow(signals(spark, [(1, event, 1, message)]), P).first()
    assert (row[G.CHECK], row[G.CLASS]) == expected
    assert row[G.TARGET] == (11 if message and "physCellId\": 11" in message else None)


SIB = "BCCH systemInformationBlockType1"


@pytest.mark.parametrize("chunk", [None, 1])
@pytest.mark.parametrize("cells,done", [((11, 11), True), ((11, 12), False), ((11,), False)])
def test_handover_success_needs_two_rows_on_the_target(spark, cells, done, chunk):
    rows = [(1, S.RECONFIGURATION, 5, sync(11)), (2, S.REPORT, 9, report())]
    rows += [(3 + i, event, cell, None)
             for i, (event, cell) in enumerate(zip((S.RECONFIGURATION_COMPLETE, SIB), cells))]
    profile = P.with_(chunk_seconds=chunk)
    assert handover.handover_success(facts_of(spark, rows, profile)[1], profile).count() == int(done)


POOR = [(40, 1, 7, -120.0, 4.0), (60, 1, 7, -120.0, 4.0), (5, 1, 9, -60.0, 20.0)]


def stuck(spark, rows, meas, profile=P):
    windows, tagged, facts = facts_of(spark, rows, profile)
    stretch = handover.last_stretch_facts(windows, facts, samples(spark, meas), profile)
    success = handover.handover_success(tagged, profile)
    failed = handover.handover_failure(stretch, success, profile).collect()
    return failed, handover.missing_neighbour(stretch, profile).collect(), (windows, facts)


REPORTS = [(10, S.REPORT, 1, report()), (30, S.REPORT, 1, report())]


def test_handover_failure_and_missing_neighbour(spark):
    failed, missing, (windows, facts) = stuck(spark, REPORTS, POOR)
    assert [(seconds(r[R.TAG_TIME]), r[R.CELL_LAST], r[R.RSRP_LAST], r[R.SINR_LAST]) for r in failed] \
        == [(10, "7", -120.0, 4.0)]
    assert [seconds(r[R.TAG_TIME]) for r in missing] == [10]
    # The separate form of the sub-window agrees with the one-pass form.
    sub = R.subwindow_radio(G.last_report_subwindow(windows, facts, P), samples(spark, POOR), P).first()
    assert (seconds(sub[R.LAST_REPORT]), sub[R.CELL_LAST], sub[R.RSRP_LAST], sub.One_Cell, sub.Poor_Last) \
        == (30, "7", -120.0, True, True)


def test_a_command_other_cells_or_good_radio_clear_it(spark):
    for rows, meas in [
            (REPORTS + [(20, S.RECONFIGURATION, 1, sync(3))], POOR),
            (REPORTS, POOR + [(50, 1, 8, -120.0, 4.0)]),
            (REPORTS, [(50, 1, 7, -80.0, 4.0)]),
            (REPORTS, []),
            ([(10, S.REPORT, 1, report(cells=None))], POOR)]:
        failed, missing, _ = stuck(spark, rows, meas)
        assert not failed and not missing


def test_success_hides_the_failure_but_not_the_missing_neighbour(spark):
    # The text names no sync, so the row has no class although the target is there.
    quiet = sync(11).replace("reconfigurationWithSync", "reconfigurationwithsync")
    rows = REPORTS + [(20, S.RECONFIGURATION, 5, quiet)]
    assert stuck(spark, rows, POOR)[0]
    cells = [(50, 1, 2, -120.0, 4.0), (51, 1, 1, -120.0, 4.0)]
    assert not stuck(spark, REPORTS, cells)[0]
    assert stuck(spark, REPORTS, cells, P.with_(legacy_single_pci=True))[0]


def test_only_the_missing_neighbour_compares_unrounded(spark):
    failed, missing, _ = stuck(spark, REPORTS, [(40, 1, 7, -110.004, 4.0)])
    assert not failed and missing


def test_plain_reconfigurations_count_only_when_empty_checks_do(spark):
    rows = REPORTS + [(20, S.RECONFIGURATION, 1, config(offset=None))]
    assert stuck(spark, rows, POOR)[0]
    assert not stuck(spark, rows, POOR, P.with_(ignore_empty_checks=False))[0]
    assert not stuck(spark, rows, POOR, V1)[0]


@pytest.mark.parametrize("rows,tagged", [
    ([(1, 0, None), (2, None, None)], True), ([(2, None, 1), (1, 0, 5)], True), ([(1, 0, None)], False),
    ([(1, 0, None), (2, 5, 5), (3, None, 0)], False), ([(1, 0, 0), (2, None, None)], False),
    ([(1, None, None)], False)])
def test_rach_failure(spark, rows, tagged):
    for order in (rows, rows[::-1]):
        facts = access.rach_facts(one_window(spark, P), accesses(spark, order), P)
        found = access.rach_failure(facts, P).collect()
        assert [seconds(r[R.TAG_TIME]) for r in found] == ([1] if tagged else [])


def handover_rows(start):
    return [(start, S.RECONFIGURATION, 1, sync(2)), (start + 1, S.RECONFIGURATION_COMPLETE, 2, None),
            (start + 2, SIB, 2, None)]


@pytest.mark.parametrize("starts,tagged", [((10, 15, 20), True), ((10, 15, 20.001), False), ((10, 15), False),
                                           ((10, 13, 40, 44), False), ((10, 40, 43, 46), True)])
def test_pingpong_is_three_handovers_with_short_gaps(spark, starts, tagged):
    rows = [row for start in starts for row in handover_rows(start)]
    for chunk in (None, 4):
        profile = P.with_(chunk_seconds=chunk)
        _, tagged_rows, facts = facts_of(spark, rows, profile)
        found = handover.pingpong_handover(tagged_rows, facts, profile).collect()
        assert [(seconds(r[R.TAG_TIME]), r[R.TAG]) for r in found] \
            == ([(10, "PingPong Handover")] if tagged else [])


def test_pingpong_does_not_cross_windows_and_v1_spells_it_differently(spark):
    log = events(spark, [(0, SETUP), (14, DROP), (100, DROP)])
    rows = signals(spark, [row for start in (10, 15, 20) for row in handover_rows(start)])
    windows = W.failure_windows(log, V1)
    tagged = G.tagged_signalling(windows, rows, V1)
    assert handover.pingpong_windows(tagged, V1).count() == 0
    _, tagged, facts = facts_of(spark, [row for s in (10, 15, 20) for row in handover_rows(s)], V1)
    assert handover.pingpong_handover(tagged, facts, V1).first()[R.TAG] == "Ping_Pong Handover"


ASK, ANSWER, OTHER = S.REESTABLISH_REQUEST, "5GNR rrcSetup", "5GNR rrcReestablishment"
DONE, SETUP_DONE = S.REESTABLISH_COMPLETE, "LTE rrcSetupComplete"


@pytest.mark.parametrize("texts,failed,succeeded", [
    ([ASK], 1, 0), ([ASK, ANSWER], 1, 0), ([ASK, ANSWER, DONE], 0, 1), ([ASK, OTHER, SETUP_DONE], 0, 1),
    ([ASK, DONE], 0, 0), ([ANSWER, DONE], 0, 0), ([DONE], 0, 0), (["x", None], 0, 0)])
def test_reestablishment(spark, texts, failed, succeeded):
    for order in (texts, texts[::-1]):
        facts = facts_of(spark, [(i, text, 1, None) for i, text in enumerate(order)])[2]
        assert G.reestablish_failure(facts, P).count() == failed
        assert G.reestablish_success(facts, P).count() == succeeded


def test_high_bler(spark):
    windows = one_window(spark, P)
    for values, tagged in (([10.01], True), ([10.0], False), ([None, 20.0, 5.0], True), ([None], False)):
        facts = R.bler_facts(windows, blers(spark, [(i, v) for i, v in enumerate(values)]), P)
        assert R.high_bler(facts, P).count() == int(tagged)
