"""Named queries. Each takes a session and a folder of parquet tables."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from callcause import schemas as S
from callcause.functions.values import look_up
from callcause.operators import access, handover, radio, relations, signalling, windows
from callcause.plans import diagnosis, updates
from callcause.plans.diagnosis import ProbeTables
from callcause.plans.services import diagnose_services
from callcause.profile import Profile
from callcause.session import new_path, settle
from callcause.sources import event_log, sinks, store, tables

# The event log spans weeks and its events are hours apart, so gaps and slices are wide here.
# Six digits keep rounding equal in other engines.
PROFILE = Profile(slice_seconds=5 * 86_400, digits=6, bler_ceiling=60.0)
# The same with every series cut into slices, as it is for very long ones.
SLICED = PROFILE.with_(chunk_seconds=5 * 86_400)
PROFILE_V1 = PROFILE.with_(version="v1")
FAIL = PROFILE.with_(marker="Traffic Fail")
FAIL_V1 = FAIL.with_(version="v1")
# Long series get cuts of their own, and dense time slices are split, both at sizes that these tables reach.
CUT = PROFILE.with_(max_series_rows=40, max_slice_rows=20)
# Rounding as results are stored, and so coarse that a rounded average often lies across a floor.
TWO_DIGITS, TENS = PROFILE.with_(digits=2), PROFILE.with_(digits=-1)
BY_DEVICE = PROFILE.with_(join_keys=("Device",))

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def _read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, folder, "events")


def _tables(spark: SparkSession, folder: str) -> ProbeTables:
    return event_log.probe_tables(_events(spark, folder))


def _calls(spark: SparkSession, folder: str) -> DataFrame:
    return event_log.call_events(_events(spark, folder))


def _measurements(spark: SparkSession, folder: str) -> DataFrame:
    return event_log.measurements(_events(spark, folder))


def _signalling(spark: SparkSession, folder: str) -> DataFrame:
    return event_log.signalling(_events(spark, folder))


def _probe_rows(spark: SparkSession, folder: str) -> DataFrame:
    return event_log.probe_rows(_events(spark, folder))


def _windows(spark: SparkSession, folder: str, profile: Profile = PROFILE) -> DataFrame:
    return windows.failure_windows(_calls(spark, folder), profile)


def _kept_windows(spark: SparkSession, folder: str, profile: Profile = PROFILE) -> DataFrame:
    """Windows that a query reads more than once."""
    return settle(_windows(spark, folder, profile))


def _tagged(spark: SparkSession, folder: str, profile: Profile = PROFILE) -> DataFrame:
    found = _windows(spark, folder, profile)
    return signalling.tagged_signalling(found, _signalling(spark, folder), profile)


def _signalling_facts(spark: SparkSession, folder: str, profile: Profile = PROFILE) -> DataFrame:
    return signalling.signalling_facts(_tagged(spark, folder, profile), profile)


def _windows_and_facts(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    found = _kept_windows(spark, folder)
    tagged = signalling.tagged_signalling(found, _signalling(spark, folder), PROFILE)
    return found, signalling.signalling_facts(tagged, PROFILE)


def _radio_facts(spark: SparkSession, folder: str, profile: Profile = PROFILE) -> DataFrame:
    found = _kept_windows(spark, folder, profile)
    return radio.radio_facts(found, _measurements(spark, folder), profile)


# --- windows and interval joins -------------------------------------------------

@query
def failure_windows(spark, folder):
    return _windows(spark, folder)


@query
def failure_windows_sliced(spark, folder):
    return _windows(spark, folder, SLICED)


@query
def failure_windows_cut(spark, folder):
    calls = settle(_calls(spark, folder))
    return windows.failure_windows(calls, CUT.sized(calls, settle))


@query
def failure_windows_tied(spark, folder):
    """With times cut to the hour, so that many events share an instant and their number orders them."""
    return windows.failure_windows(event_log.call_events(event_log.hourly(_events(spark, folder))), PROFILE)


@query
def failure_windows_traffic_fail(spark, folder):
    return _windows(spark, folder, FAIL)


@query
def window_rows_left(spark, folder):
    return windows.window_rows(_kept_windows(spark, folder), _probe_rows(spark, folder), PROFILE, "left", keep=settle)


@query
def window_rows_inner(spark, folder):
    return windows.window_rows(_windows(spark, folder), _probe_rows(spark, folder), PROFILE)


@query
def window_rows_bucketed(spark, folder):
    narrow = PROFILE.with_(slice_seconds=43_200)
    return windows.window_rows(_kept_windows(spark, folder), _probe_rows(spark, folder), narrow, "left", keep=settle)


@query
def window_rows_keyed(spark, folder):
    return windows.window_rows_keyed(_windows(spark, folder), _probe_rows(spark, folder), PROFILE)


@query
def window_rows_linear(spark, folder):
    return windows.window_rows_linear(_calls(spark, folder), _probe_rows(spark, folder), PROFILE)


@query
def window_rows_linear_sliced(spark, folder):
    return windows.window_rows_linear(_calls(spark, folder), _probe_rows(spark, folder), SLICED)


@query
def window_rows_dense(spark, folder):
    """With time slices of one key that hold too many rows cut at the times of these."""
    return windows.window_rows(_kept_windows(spark, folder), _probe_rows(spark, folder), CUT, keep=settle)


def _crowded(spark, folder):
    log = event_log.crowded(_events(spark, folder))
    return event_log.call_events(log), event_log.probe_rows(log)


@query
def window_rows_hot(spark, folder):
    """With a third of all rows on one key and many rows on one instant, dealt over shares of it."""
    calls, rows = _crowded(spark, folder)
    return windows.window_rows(settle(windows.failure_windows(calls, CUT)), rows, CUT, keep=settle)


@query
def window_rows_linear_tied(spark, folder):
    """The same without an interval join."""
    return windows.window_rows_linear(*_crowded(spark, folder), PROFILE)


@query
def window_rows_linear_by_device(spark, folder):
    return windows.window_rows_linear(_calls(spark, folder), _probe_rows(spark, folder), BY_DEVICE)


@query
def window_rows_by_device(spark, folder):
    return windows.window_rows(_windows(spark, folder), _probe_rows(spark, folder), BY_DEVICE)


@query
def event_messages(spark, folder):
    found = _calls(spark, folder).select("Time", "WorkOrderId", "Device", "Event_CallEvent")
    return windows.event_messages(found, PROFILE, settle)


# --- detectors --------------------------------------------------------------------

@query
def radio_condition(spark, folder):
    return radio.radio_condition(_radio_facts(spark, folder), PROFILE)


@query
def radio_condition_v1(spark, folder):
    return radio.radio_condition(_radio_facts(spark, folder), PROFILE_V1)


@query
def lost_signal(spark, folder):
    return radio.lost_signal(_radio_facts(spark, folder), PROFILE)


@query
def missing_signalling(spark, folder):
    return signalling.missing_signalling(
        *_windows_and_facts(spark, folder), PROFILE)


@query
def roaming(spark, folder):
    return signalling.roaming(_signalling_facts(spark, folder), PROFILE)


@query
def roaming_v1(spark, folder):
    return signalling.roaming(_signalling_facts(spark, folder), PROFILE_V1)


@query
def message_class(spark, folder):
    rows = signalling.message_class(_signalling(spark, folder), PROFILE)
    return rows.select("Device", "WorkOrderId", "Time", "RRC_NR5G_event", signalling.CHECK)


@query
def event_a3_config(spark, folder):
    rows = signalling.narrow(_signalling(spark, folder), PROFILE)
    return rows.select("Device", "WorkOrderId", "Time", signalling.TARGET, signalling.OFFSET,
                       signalling.CLASS)


@query
def handover_success(spark, folder):
    return handover.handover_success(settle(_tagged(spark, folder)), PROFILE)


@query
def handovers(spark, folder):
    return handover.handovers(settle(_tagged(spark, folder)), PROFILE)


@query
def last_report_subwindow(spark, folder):
    return signalling.last_report_subwindow(*_windows_and_facts(spark, folder), PROFILE)


@query
def subwindow_radio(spark, folder):
    found = settle(last_report_subwindow(spark, folder))
    return radio.subwindow_radio(found, _measurements(spark, folder), PROFILE)


@query
def subwindow_radio_v1(spark, folder):
    found = settle(last_report_subwindow(spark, folder))
    return radio.subwindow_radio(found, _measurements(spark, folder), PROFILE_V1)


def _stretch(spark, folder, found, tagged, profile):
    facts = settle(signalling.signalling_facts(tagged, profile))
    return handover.last_stretch_facts(found, facts, _measurements(spark, folder), profile)


def _handover_failure(spark, folder, profile):
    found = _kept_windows(spark, folder, profile)
    tagged = settle(signalling.tagged_signalling(found, _signalling(spark, folder), profile))
    success = handover.handover_success(tagged, profile)
    return handover.handover_failure(_stretch(spark, folder, found, tagged, profile), success, profile)


def _missing_neighbour(spark, folder, profile):
    found = _kept_windows(spark, folder, profile)
    tagged = signalling.tagged_signalling(found, _signalling(spark, folder), profile)
    return handover.missing_neighbour(_stretch(spark, folder, found, tagged, profile), profile)


@query
def handover_failure(spark, folder):
    return _handover_failure(spark, folder, PROFILE)


@query
def handover_failure_tens(spark, folder):
    """Averages rounded to tens: some that lie below a floor no longer do."""
    return _handover_failure(spark, folder, TENS)


@query
def missing_neighbour(spark, folder):
    return _missing_neighbour(spark, folder, PROFILE)


@query
def missing_neighbour_tens(spark, folder):
    """Compares averages as they are, whatever the rounding, so it finds windows that a handover failure misses."""
    return _missing_neighbour(spark, folder, TENS)


@query
def rach_failure(spark, folder):
    facts = access.rach_facts(_windows(spark, folder), event_log.rach(_events(spark, folder)), PROFILE)
    return access.rach_failure(facts, PROFILE)


@query
def pingpong_handover(spark, folder):
    tagged = settle(_tagged(spark, folder))
    facts = signalling.signalling_facts(tagged, PROFILE)
    return handover.pingpong_handover(tagged, facts, PROFILE)


@query
def reestablish_failure(spark, folder):
    return signalling.reestablish_failure(_signalling_facts(spark, folder), PROFILE)


@query
def reestablish_success(spark, folder):
    return signalling.reestablish_success(_signalling_facts(spark, folder), PROFILE)


@query
def high_bler(spark, folder):
    facts = radio.bler_facts(_windows(spark, folder), event_log.physical(_events(spark, folder)), PROFILE)
    return radio.high_bler(facts, PROFILE)


@query
def reference_columns(spark, folder):
    return diagnosis.reference_columns(_windows(spark, folder), _calls(spark, folder), PROFILE)


# --- diagnoses --------------------------------------------------------------------

@query
def diagnosis_v2(spark, folder):
    return diagnosis.diagnose(_tables(spark, folder), PROFILE)


@query
def diagnosis_v2_sliced(spark, folder):
    return diagnosis.diagnose(_tables(spark, folder), SLICED)


@query
def diagnosis_v2_two_digits(spark, folder):
    return diagnosis.diagnose(event_log.probe_tables(event_log.shifted(_events(spark, folder))), TWO_DIGITS)


@query
def diagnosis_v2_tens(spark, folder):
    return diagnosis.diagnose(_tables(spark, folder), TENS)


@query
def diagnosis_v2_by_device(spark, folder):
    """With rows of the other work orders of a device in its windows."""
    return diagnosis.diagnose(_tables(spark, folder), BY_DEVICE)


@query
def diagnosis_v2_broken(spark, folder):
    """With every fifth message broken off."""
    whole = _tables(spark, folder)
    return diagnosis.diagnose(replace(whole, signalling=event_log.broken_signalling(_events(spark, folder))), PROFILE)


def _decoded_store(spark, folder):
    """One store of decoded messages, sorted by series and time, for both jobs."""
    rows = signalling.decode(_signalling(spark, folder), PROFILE)
    return settle(rows.repartition(*PROFILE.keys).sortWithinPartitions(*PROFILE.keys, "Time"))


@query
def diagnosis_v2_decoded(spark, folder):
    return diagnosis.diagnose(replace(_tables(spark, folder), signalling=_decoded_store(spark, folder)), PROFILE)


@query
def suspected_missing_relations_decoded(spark, folder):
    return relations.suspected_missing_relations(_decoded_store(spark, folder), PROFILE)


@query
def diagnosis_v2_stored_devices(spark, folder):
    """The devices of two services from a store by device group, which reads their groups alone."""
    place = new_path(spark, "store")
    store.write_store(_tables(spark, folder), place, PROFILE, groups=16)
    devices = event_log.device_services(_events(spark, folder)).filter(F.col("ServiceName").isin("IPERF3_DL", "IPERF3_UL"))
    return diagnosis.diagnose(store.stored_devices(store.open_store(spark, place), devices, PROFILE, groups=16), PROFILE)


@query
def diagnosis_v2_cut(spark, folder):
    return diagnosis.diagnose(_tables(spark, folder), CUT)


@query
def diagnosis_v2_counting_empty_checks(spark, folder):
    return diagnosis.diagnose(_tables(spark, folder), PROFILE.with_(ignore_empty_checks=False))


@query
def diagnosis_v2_without_pingpong(spark, folder):
    return diagnosis.diagnose(_tables(spark, folder), PROFILE.with_(legacy_pingpong_v2=True))


@query
def diagnosis_v2_one_cell_by_text(spark, folder):
    return diagnosis.diagnose(_tables(spark, folder), PROFILE.with_(legacy_single_pci=True))


@query
def diagnosis_v2_low_bler_ceiling(spark, folder):
    return diagnosis.diagnose(_tables(spark, folder), PROFILE.with_(bler_ceiling=10.0))


@query
def diagnosis_v1(spark, folder):
    return diagnosis.diagnose(_tables(spark, folder), PROFILE_V1)


@query
def diagnosis_v2_traffic_fail(spark, folder):
    return diagnosis.diagnose(_tables(spark, folder), FAIL)


@query
def diagnosis_v1_traffic_fail(spark, folder):
    return diagnosis.diagnose(_tables(spark, folder), FAIL_V1)


@query
def multi_device_union(spark, folder):
    devices = event_log.device_services(_events(spark, folder))
    return diagnose_services(_tables(spark, folder), devices, ["IPERF3_DL", "IPERF3_UL"], PROFILE)


@query
def multi_device_stacked(spark, folder):
    devices = event_log.device_services(_events(spark, folder))
    return diagnose_services(_tables(spark, folder), devices, ["IPERF3_DL", "IPERF3_UL"], PROFILE,
                             stacked=True)


# --- relations ----------------------------------------------------------------------

_PLACE = ("Device", "WorkOrderId", "Time", "RRC_NR5G_event")


def _tokens(spark, folder):
    return relations.event_token(_signalling(spark, folder), PROFILE)


def _decoded(spark, folder):
    decoded = relations.decode_messages(_tokens(spark, folder), PROFILE)
    return relations.with_neighbours(settle(decoded), PROFILE)


def _failed_rows(spark, folder):
    ordered = settle(relations.numbered_rows(_decoded(spark, folder), PROFILE))
    return relations.not_succeeded(ordered, PROFILE)


def _grouped(spark, folder):
    kept = settle(relations.session_has_report(_failed_rows(spark, folder), PROFILE))
    grouped = relations.report_groups(kept, PROFILE)
    return relations.carry_back_meas_id(grouped, PROFILE)


@query
def event_token(spark, folder):
    return _tokens(spark, folder).select(*_PLACE)


@query
def rrc_sessions(spark, folder):
    return relations.rrc_sessions(_tokens(spark, folder), PROFILE).select(*_PLACE, relations.SESSION)


@query
def decode_reports(spark, folder):
    rows = relations.decode_reports(_tokens(spark, folder), PROFILE)
    return rows.select(*_PLACE, "report_meas_id",
                       F.concat_ws(",", F.col("neighbour_pcis").cast("array<string>")).alias("neighbours"))


@query
def decode_reconfig(spark, folder):
    rows = relations.decode_reconfig(_tokens(spark, folder), PROFILE)
    lists = ["meas_ids", "meas_object_ids", "object_ids", "object_frequencies"]
    return rows.select(*_PLACE, "target_pci", "target_frequency",
                       *[F.concat_ws(",", F.col(n).cast("array<string>")).alias(n) for n in lists])


@query
def relation_success(spark, folder):
    return relations.relation_success(relations.next_targets(_decoded(spark, folder), PROFILE), PROFILE)


@query
def session_has_report(spark, folder):
    kept = relations.session_has_report(_failed_rows(spark, folder), PROFILE)
    return kept.select(*_PLACE, relations.SESSION)


@query
def report_groups(spark, folder):
    kept = settle(relations.session_has_report(_failed_rows(spark, folder), PROFILE))
    return relations.report_groups(kept, PROFILE).select(*_PLACE, relations.GROUP)


@query
def carry_back_meas_id(spark, folder):
    return _grouped(spark, folder).select(*_PLACE, relations.GROUP, relations.CARRIED_ID)


@query
def config_lookup(spark, folder):
    return relations.config_lookup(_grouped(spark, folder), PROFILE)


@query
def shift_to_report(spark, folder):
    rows = settle(_grouped(spark, folder))
    shifted = relations.shift_to_report(rows, relations.config_lookup(rows, PROFILE), PROFILE)
    return shifted.select(*_PLACE, "T_Freq")


@query
def explode_neighbours(spark, folder):
    rows = relations.decode_reports(_tokens(spark, folder), PROFILE)
    return relations.explode_neighbours(rows, PROFILE).select(*_PLACE, "RRC_NR5G_pci", "T_PCI")


@query
def forward_fill(spark, folder):
    """Price of the last purchase, carried to every later event of a user."""
    rows = _calls(spark, folder).select(
        "Device", "WorkOrderId", "Time", "Event_CallEvent",
        F.when(F.col("Event_CallEvent") == PROFILE.end_text, F.col("Latitude")).alias("T_Freq"))
    return relations.forward_fill(rows, PROFILE)


@query
def forward_fill_tied(spark, folder):
    rows = event_log.call_events(event_log.hourly(_events(spark, folder))).select(
        "Device", "WorkOrderId", "Time", "MsgId", "Event_CallEvent",
        F.when(F.col("Event_CallEvent") == PROFILE.end_text, F.col("Latitude")).alias("T_Freq"))
    return relations.forward_fill(rows, PROFILE)


@query
def array_lookup(spark, folder):
    """Line number and quantity of each order's third part, by position in parallel arrays."""
    lines = (_read(spark, folder, "lineitem").groupBy("l_orderkey")
             .agg(F.sort_array(F.collect_list(F.struct("l_partkey", "l_linenumber", "l_quantity")))
                  .alias("lines")))
    part = F.get(F.col("lines.l_partkey"), F.lit(2))
    return lines.select(
        "l_orderkey", part.alias("l_partkey"),
        look_up(part, F.col("lines.l_partkey"), F.col("lines.l_linenumber")).alias("l_linenumber"),
        look_up(part, F.col("lines.l_partkey"), F.col("lines.l_quantity")).alias("l_quantity"))


@query
def suspected_missing_relations(spark, folder):
    return relations.suspected_missing_relations(_signalling(spark, folder), PROFILE)


@query
def suspected_missing_relations_tied(spark, folder):
    rows = event_log.signalling(event_log.hourly(_events(spark, folder)))
    return relations.suspected_missing_relations(rows, PROFILE)


@query
def suspected_missing_relations_sliced(spark, folder):
    return relations.suspected_missing_relations(_signalling(spark, folder), SLICED)


@query
def suspected_missing_relations_broken(spark, folder):
    return relations.suspected_missing_relations(event_log.broken_signalling(_events(spark, folder)), PROFILE)


@query
def suspected_missing_relations_cut(spark, folder):
    return relations.suspected_missing_relations(_signalling(spark, folder), CUT)


# --- sources and sinks ----------------------------------------------------------------

@query
def table_scan(spark, folder):
    return tables.read_table(spark, os.path.join(folder, "orders.parquet"),
                             ["o_orderkey", "o_custkey", "o_orderpriority"])


@query
def device_lookup(spark, folder):
    """Events of the customers of one market segment."""
    found = tables.find_devices(_read(spark, folder, "customer"), "BUILDING", "c_mktsegment", "c_custkey")
    rows = _events(spark, folder).select("event_id", "user_id", "event_type", "value")
    return tables.only_devices(rows, found, "user_id")


@query
def device_lookup_first(spark, folder):
    found = tables.find_devices(_read(spark, folder, "customer"), "BUILDING", "c_mktsegment",
                                "c_custkey", first_only=True)
    rows = _read(spark, folder, "orders").select("o_orderkey", "o_custkey")
    return tables.only_devices(rows, found, "o_custkey")


def _radio_output(spark, folder):
    found = _radio_facts(spark, folder)
    # A NaN stands for a value that cannot be computed.
    spread = F.when(F.col(radio.RSRP_AVG).isNull(), F.lit(float("nan"))).otherwise(F.col(radio.RSRP_AVG))
    return found.withColumn(radio.RSRP_AVG, spread)


@query
def output_projection(spark, folder):
    shaped = sinks.output_projection(_radio_output(spark, folder), S.DIAGNOSIS_V2, sinks.MICROSECOND_TEXT)
    return shaped.select(
        "Failed_Event_Number", "Failed_Event_Type", "Event_Analysis_Start_Time",
        "Event_Analysis_End_Time", "WorkOrderId", "Device", radio.RSRP_AVG, radio.CELLS)


@query
def output_projection_v1(spark, folder):
    """The older text form keeps the date alone."""
    return sinks.times_as_text(_windows(spark, folder), sinks.DATE_TEXT)


@query
def output_table_v2(spark, folder):
    """All columns of the newer diagnosis as they are stored, times as text."""
    return sinks.output_projection(diagnosis_v2(spark, folder), S.DIAGNOSIS_V2, sinks.MICROSECOND_TEXT)


@query
def output_table_v1(spark, folder):
    return sinks.output_projection(diagnosis_v1(spark, folder), S.DIAGNOSIS_V1, sinks.DATE_TEXT)


@query
def output_table_relations(spark, folder):
    return sinks.output_projection(suspected_missing_relations(spark, folder), S.MISSING_RELATION, sinks.MICROSECOND_TEXT)


@query
def sink_roundtrip(spark, folder):
    place = new_path(spark, "sink")
    sinks.write_table(_windows(spark, folder), place)
    return spark.read.parquet(place)


@query
def sink_renewed_days(spark, folder):
    """The first half of the log diagnosed and stored by day, then the rest added: all days as in one run."""
    place, log = new_path(spark, "sink"), _events(spark, folder)
    half = log.agg(F.expr("percentile(event_id, 0.5)")).first()[0]
    early = event_log.probe_tables(log.filter(F.col("event_id") <= half))
    late = event_log.probe_tables(log.filter(F.col("event_id") > half))
    updates.write_days(diagnosis.diagnose(early, PROFILE), place)
    updates.renew_days(event_log.probe_tables(log), late, place, PROFILE)
    return updates.read_days(spark, place).withColumn(updates.DAY, F.col(updates.DAY).cast("string"))


@query
def sink_roundtrip_csv(spark, folder):
    place = new_path(spark, "sink")
    found = sinks.times_as_text(_windows(spark, folder))
    sinks.write_csv(found, place)
    return spark.read.schema(found.schema).csv(place, header=True)
