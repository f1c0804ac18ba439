import pytest
from frames import config, report, seconds, sync, wide_signals
from pyspark.sql import functions as F

from callcause import schemas as S
from callcause.operators import relations as X
from callcause.profile import Profile

P = Profile()
SETUP = "5GNR rrcSetupRequest"


def tokens(spark, rows):
    return X.event_token(wide_signals(spark, rows), P)


def decoded(spark, rows):
    return X.with_neighbours(X.decode_messages(tokens(spark, rows), P), P)


def missing(spark, rows, profile=P, keep=None):
    found = X.suspected_missing_relations(wide_signals(spark, rows), profile, keep)
    return sorted(((seconds(r.Time), r.WorkOrderId, r.S_PCI, r.S_Freq, r.T_PCI, r.T_Freq)
                   for r in found.collect()), key=str)


def test_event_token_keeps_three_kinds_and_survives_short_texts(spark):
    rows = [(1, SETUP, 1, 1, None), (2, "short", 1, 1, None), (3, None, 1, 1, None), (4, S.REPORT, 1, 1, None),
            (5, "5GNR rrcReconfigurationComplete", 1, 1, None), (6, S.RECONFIGURATION, 1, 1, None)]
    assert [r.RRC_NR5G_event for r in tokens(spark, rows).orderBy("Time").collect()] \
        == ["rrcSetupRequest", "measurementReport", "rrcReconfiguration"]


def test_sessions_count_setups_and_start_unknown(spark):
    rows = [(1, S.REPORT, 1, 1, None), (2, SETUP, 1, 1, None), (3, S.REPORT, 1, 1, None), (4, SETUP, 1, 1, None),
            (2, S.REPORT, 1, 1, None, 2)]
    found = X.rrc_sessions(tokens(spark, rows), P).collect()
    assert sorted((r.WorkOrderId, seconds(r.Time), r[X.SESSION]) for r in found) \
        == [(1, 1, None), (1, 2, 1), (1, 3, 1), (1, 4, 2), (2, 2, None)]


def test_decoding(spark):
    rows = [(1, S.REPORT, 1, 1, report(3, (40, 41))), (2, S.REPORT, 1, 1, report(3, None)),
            (3, S.RECONFIGURATION, 1, 1, config()), (4, S.RECONFIGURATION, 1, 1, sync(11, 5)),
            (5, S.RECONFIGURATION, 1, 1, "{nonsense"), (6, S.REPORT, 1, 1, "{nonsense")]
    found = {seconds(r.Time): r for r in decoded(spark, rows).collect()}
    assert sorted(found) == [1, 3, 4, 5]
    assert (found[1].report_meas_id, found[1].neighbour_pcis) == (3, [40, 41])
    assert (found[3].meas_ids, found[3].meas_object_ids) == ([2, 3], [1, 1])
    assert (found[3].object_ids, found[3].object_frequencies) == ([1], [129870])
    assert (found[4].target_pci, found[4].target_frequency) == (11, 5)
    assert found[5].target_pci is None and found[5].meas_ids is None


def test_a_report_answered_at_once_proves_the_relation(spark):
    rows = [(1, S.REPORT, 40, 7, report()), (2, S.RECONFIGURATION, 40, 7, sync(11)),
            (3, S.REPORT, 41, 7, report()), (4, S.RECONFIGURATION, 41, 7, config()),
            (5, S.RECONFIGURATION, 41, 7, sync(12))]
    found = X.relation_success(X.next_targets(decoded(spark, rows), P), P).collect()
    assert [(r.S_PCI, r.S_Freq, r.T_PCI, r.T_Freq, r.Relation) for r in found] \
        == [(40, 7, 11, 129870, "1_1_40_7_11_129870")]


CHAIN = [(1, SETUP, 40, 7, None), (2, S.RECONFIGURATION, 40, 7, config()), (3, S.REPORT, 40, 7, report())]


@pytest.mark.parametrize("chunk", [None, 1])
def test_the_frequency_travels_to_the_report(spark, chunk):
    profile = P.with_(chunk_seconds=chunk)
    assert missing(spark, CHAIN, profile) == [(3, 1, 40, 7, 41, 129870)]


@pytest.mark.parametrize("configs,frequency", [
    ([config(ids=((9, 1),))], None), ([config(objects=())], None), ([config(ids=(), objects=())], None),
    ([config(), config(objects=((1, 5),))], 5),
    ([config(ids=(), objects=((1, 8),)), config(objects=())], 8),
    ([config(objects=((1, 6),)), "{broken"], 6)])
def test_lookup_edges(spark, configs, frequency):
    rows = [CHAIN[0], *[(2 + i / 10, S.RECONFIGURATION, 40, 7, text) for i, text in enumerate(configs)], CHAIN[2]]
    assert missing(spark, rows) == [(3, 1, 40, 7, 41, frequency)]


def test_unknown_frequency_takes_the_last_known_one(spark):
    rows = [*CHAIN, (4, S.REPORT, 40, 7, report(cells=(40,))), (5, S.REPORT, 40, 7, report(cells=(50,)))]
    assert missing(spark, rows) == [(3, 1, 40, 7, 41, 129870), (5, 1, 40, 7, 50, 129870)]


def test_sessions_without_a_report_are_left_out(spark):
    rows = [(0, SETUP, 1, 1, None), (0.5, S.RECONFIGURATION, 1, 1, config()), *CHAIN]
    kept = X.session_has_report(
        X.not_succeeded(X.numbered_rows(decoded(spark, rows), P), P), P)
    assert sorted(seconds(r.Time) for r in kept.collect()) == [1, 2, 3]


def test_proven_relations_are_removed(spark):
    proof = [(10, S.REPORT, 40, 7, report(cells=(41,))), (11, S.RECONFIGURATION, 40, 7, sync(41))]
    assert missing(spark, [*CHAIN, *proof]) == []
    other = [(10, S.REPORT, 40, 7, report(cells=(41,)), 2), (11, S.RECONFIGURATION, 40, 7, sync(41), 2)]
    assert missing(spark, [*CHAIN, *other]) == [(3, 1, 40, 7, 41, 129870)]


def test_a_null_frequency_matches_only_a_null_frequency(spark):
    bare = [(1, S.REPORT, 40, 7, report(cells=(41,)))]
    proof = [(10, S.REPORT, 40, 7, report(cells=(41,))), (11, S.RECONFIGURATION, 40, 7, sync(41))]
    gone = sync(41).replace("absoluteFrequencySSB", "other")
    # The first report has no earlier configuration, so its frequency is unknown.
    assert missing(spark, [*bare, (2, SETUP, 1, 1, None), *proof]) == [(1, 1, 40, 7, 41, None)]
    proof[1] = (11, S.RECONFIGURATION, 40, 7, gone)
    assert missing(spark, [*bare, (2, SETUP, 1, 1, None), *proof]) == []


def test_result_has_the_context_and_no_serving_cell(spark):
    found = X.suspected_missing_relations(wide_signals(spark, CHAIN), P, None)
    assert found.columns == ["Time", "Device", "WorkOrderId", "BandId", "MsgId", "Latitude", *X.RELATION]
    assert found.filter(F.col("S_PCI") == F.col("T_PCI")).count() == 0


def test_no_nested_loops_and_no_python(spark):
    plan = X.suspected_missing_relations(wide_signals(spark, CHAIN), P)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan
