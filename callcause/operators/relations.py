"""Neighbour relations: reported cells, proven handover targets, and the difference."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, Window, functions as F

from callcause import schemas as S
from callcause.functions.messages import decode_downlink, decode_uplink
from callcause.functions.values import look_up, second_word
from callcause.operators.signalling import CHECK, OFFSET, is_decoded
from callcause.operators.sequence import (Following, LastKnown, NextKnown, Previous, RunningSum, Step,
                                          scan)
from callcause.profile import Profile
from callcause.session import settle

Keep = Callable[[DataFrame], DataFrame] | None

SESSION, GROUP, CARRIED_ID = "Session", "Report_Group", "Carried_MeasId"
RELATION = ("S_PCI", "S_Freq", "T_PCI", "T_Freq")
# Measurement identifiers are positive; this stands for a row that has none.
_NO_ID = -1


def _is(profile: Profile, token: str):
    return F.col(profile.columns.rrc_event) == token


def event_token(signalling: DataFrame, profile: Profile) -> DataFrame:
    """Reduce the event text to its second word; keep setups, reconfigurations and reports."""
    event = profile.columns.rrc_event
    kept = (S.SETUP_TOKEN, S.RECONFIGURATION_TOKEN, S.REPORT_TOKEN)
    return (signalling.withColumn(event, second_word(F.col(event)))
            .filter(F.col(event).isin(*kept)))


def session_steps(profile: Profile) -> Mapping[str, Step]:
    return {SESSION: RunningSum(F.when(_is(profile, S.SETUP_TOKEN), F.lit(1).cast("long")))}


def rrc_sessions(tokens: DataFrame, profile: Profile) -> DataFrame:
    """Number the sessions of a series; rows before the first setup have none."""
    return scan(tokens, profile.series(), session_steps(profile))


def decode_messages(tokens: DataFrame, profile: Profile) -> DataFrame:
    """Decode both kinds of messages, each row once, and drop the message text.

    Reports get measurement id and neighbour cells; reconfigurations get target
    cell, target frequency and measurement lists. Tables that ``signalling.decode``
    has decoded stay as they are.
    """
    if is_decoded(tokens):
        return tokens.drop(CHECK, OFFSET)
    return decode_reconfig(_decode_reports(tokens, profile), profile).drop(profile.columns.rrc_message)


def _decode_reports(tokens: DataFrame, profile: Profile) -> DataFrame:
    return decode_uplink(tokens, profile.columns.rrc_message, _is(profile, S.REPORT_TOKEN))


def with_neighbours(decoded: DataFrame, profile: Profile) -> DataFrame:
    """Drop reports that name no neighbour."""
    return decoded.filter(~_is(profile, S.REPORT_TOKEN) | F.col("neighbour_pcis").isNotNull())


def decode_reports(tokens: DataFrame, profile: Profile) -> DataFrame:
    """Add measurement id and neighbour cells of reports; drop reports without neighbours."""
    return with_neighbours(_decode_reports(tokens, profile), profile)


def decode_reconfig(tokens: DataFrame, profile: Profile) -> DataFrame:
    """Add target cell, target frequency and measurement lists of reconfigurations."""
    wanted = ["target_pci", "target_frequency", "meas_ids", "meas_object_ids",
              "object_ids", "object_frequencies"]
    return decode_downlink(tokens, profile.columns.rrc_message,
                           _is(profile, S.RECONFIGURATION_TOKEN), wanted)


def target_steps() -> Mapping[str, Step]:
    return {"Next_Target_PCI": Following(F.col("target_pci")),
            "Next_Target_Freq": Following(F.col("target_frequency"))}


def next_targets(decoded: DataFrame, profile: Profile) -> DataFrame:
    """Add the target cell and frequency of the next row."""
    return scan(decoded, profile.series(), target_steps())


def numbered_rows(decoded: DataFrame, profile: Profile) -> DataFrame:
    """Sessions and next targets in one pass."""
    return scan(decoded, profile.series(), {**session_steps(profile), **target_steps()})


def _succeeded(profile: Profile):
    return _is(profile, S.REPORT_TOKEN) & F.col("Next_Target_PCI").isNotNull()


def relation_success(with_targets: DataFrame, profile: Profile) -> DataFrame:
    """Distinct relations whose report was answered at once by a handover command."""
    c = profile.columns
    relation = [*profile.keys, *RELATION]
    return (with_targets.filter(_succeeded(profile))
            .select(*profile.keys, F.col(c.rrc_cell).alias("S_PCI"),
                    F.col(c.rrc_frequency).alias("S_Freq"),
                    F.col("Next_Target_PCI").alias("T_PCI"),
                    F.col("Next_Target_Freq").alias("T_Freq"))
            .distinct()
            .withColumn("Relation", F.concat_ws("_", *_text_order(relation))))


def _text_order(relation: list[str]) -> list[str]:
    first = [name for name in ("WorkOrderId", "Device") if name in relation]
    return first + [name for name in relation if name not in first]


def not_succeeded(with_targets: DataFrame, profile: Profile) -> DataFrame:
    return with_targets.filter(~_succeeded(profile)).drop("Next_Target_PCI", "Next_Target_Freq")


def _session_number():
    return F.coalesce(F.col(SESSION), F.lit(0).cast("long"))


def _sighting_steps() -> Mapping[str, Step]:
    """Session of the nearest row with a measurement id, on either side."""
    seen = F.when(F.col("report_meas_id").isNotNull(), _session_number())
    return {"_seen_before": LastKnown(seen), "_seen_after": NextKnown(seen)}


def _session_seen():
    here = _session_number()
    return (F.coalesce(F.col("_seen_before") == here, F.lit(False))
            | F.coalesce(F.col("_seen_after") == here, F.lit(False)))


def session_has_report(failed: DataFrame, profile: Profile) -> DataFrame:
    """Keep the sessions that hold at least one measurement id.

    Sessions are stretches of a series, so the nearest id on either side tells:
    no join, and no frame over a whole session.
    """
    return (scan(failed, profile.series(), _sighting_steps()).filter(_session_seen())
            .drop("_seen_before", "_seen_after"))


def group_steps(profile: Profile) -> Mapping[str, Step]:
    adds = F.when(_is(profile, S.RECONFIGURATION_TOKEN), 0).otherwise(1).cast("long")
    return {GROUP: RunningSum(adds)}


def report_groups(rows: DataFrame, profile: Profile) -> DataFrame:
    """Number the groups: a report or setup with the reconfigurations after it."""
    return scan(rows, profile.series(), group_steps(profile))


def carry_steps(profile: Profile) -> Mapping[str, Step]:
    head_id = F.coalesce(F.col("report_meas_id"), F.lit(_NO_ID).cast("long"))
    return {CARRIED_ID: NextKnown(F.when(~_is(profile, S.RECONFIGURATION_TOKEN), head_id))}


def _carried_id():
    return F.nullif(F.col(CARRIED_ID), F.lit(_NO_ID).cast("long"))


def carry_back_meas_id(rows: DataFrame, profile: Profile) -> DataFrame:
    """Give every row the measurement id of the report that ends its group."""
    return (scan(rows, profile.series(), carry_steps(profile))
            .withColumn(CARRIED_ID, _carried_id()))


def config_lookup(rows: DataFrame, profile: Profile) -> DataFrame:
    """Frequency of each group: measurement id to object id to frequency, last known of each."""
    c = profile.columns
    group = [*profile.keys, GROUP]
    order = F.struct(c.time, *profile.ties_of(rows, *group))
    arrays = ["meas_ids", "meas_object_ids", "object_ids", "object_frequencies"]
    configs = (rows.filter(F.col("meas_ids").isNotNull() | F.col("object_ids").isNotNull())
               .select(*group, order.alias("_order"), CARRIED_ID, *arrays)
               .withColumn("_object", look_up(F.col(CARRIED_ID), F.col("meas_ids"),
                                              F.col("meas_object_ids"))))

    def last_by_group(frame: DataFrame, value: str, name: str) -> DataFrame:
        known = frame.filter(F.col(value).isNotNull())
        # Of rows that nothing else orders the greater value counts.
        return known.groupBy(*group).agg(F.max_by(value, F.struct("_order", value)).alias(name))

    objects = last_by_group(configs, "_object", "_group_object")
    found = configs.join(objects, group, "inner").withColumn(
        "_frequency", look_up(F.col("_group_object"), F.col("object_ids"), F.col("object_frequencies")))
    return last_by_group(found, "_frequency", "T_Freq")


def shift_to_report(rows: DataFrame, frequencies: DataFrame, profile: Profile) -> DataFrame:
    """Reports with the frequency of the group that they end."""
    group = [*profile.keys, GROUP]
    ended = frequencies.withColumn(GROUP, F.col(GROUP) + 1)
    return rows.filter(_is(profile, S.REPORT_TOKEN)).join(ended, group, "left")


def _other_cells(profile: Profile):
    serving = F.col(profile.columns.rrc_cell).cast("long")
    return F.filter("neighbour_pcis", lambda cell: cell != serving)


def explode_neighbours(reports: DataFrame, profile: Profile) -> DataFrame:
    """One row per reported cell that is not the serving cell."""
    return (reports.withColumn("T_PCI", F.explode(_other_cells(profile)))
            .drop("neighbour_pcis"))


def forward_fill(reports: DataFrame, profile: Profile) -> DataFrame:
    """Carry the last known target frequency along a series; rows of one instant share it."""
    return scan(reports, profile.series(), {"_filled": LastKnown(F.col("T_Freq"), peers=True)}).drop(
        "T_Freq").withColumnRenamed("_filled", "T_Freq")


def reported_relations(failed: DataFrame, profile: Profile, keep: Keep = None) -> DataFrame:
    """Reported cells of the rows that led to no handover, with serving and target frequency."""
    rows = (scan(failed, profile.series(),
                 {**_sighting_steps(), **group_steps(profile), **carry_steps(profile)})
            .filter(_session_seen()).withColumn(CARRIED_ID, _carried_id()))
    if keep is not None:
        rows = keep(rows)
    reports = shift_to_report(
        rows.drop("meas_ids", "meas_object_ids", "object_ids", "object_frequencies"),
        config_lookup(rows, profile), profile)
    # Reports of the serving cell alone leave no row, so they take no part in the fill.
    reports = reports.filter(F.size(_other_cells(profile)) > 0)
    return _named(reports, profile)


def _named(reports: DataFrame, profile: Profile) -> DataFrame:
    """One row per reported cell, frequencies carried on, with the names of a relation."""
    c = profile.columns
    named = (forward_fill(reports, profile)
             .transform(lambda df: explode_neighbours(df, profile))
             .withColumnsRenamed({c.rrc_cell: "S_PCI", c.rrc_frequency: "S_Freq"}))
    context = [name for name in S.CONTEXT_COLUMNS if name in named.columns]
    return named.select(c.time, *profile.keys, *[n for n in context if n not in profile.keys], *RELATION)


def without_proven(reported: DataFrame, proven: DataFrame, profile: Profile) -> DataFrame:
    """Reported relations that no handover has proven; nulls equal nulls."""
    names = [*profile.keys, *RELATION]
    known = proven.select(*[F.col(name).alias(f"_p_{name}") for name in names])
    same = [F.col(name).eqNullSafe(F.col(f"_p_{name}")) for name in names]
    condition = same[0]
    for part in same[1:]:
        condition = condition & part
    return reported.join(known, condition, "left_anti")


def streamed_relations(failed: DataFrame, profile: Profile) -> DataFrame:
    """``reported_relations`` for series that fit a task: no join and nothing stored.

    A group's frequency is the last known value in a frame over the group, and
    the report that ends a group stands right after its last row. All frames lie
    within the series, so the rows are exchanged once.
    """
    c = profile.columns
    rows = (scan(failed, profile.series(),
                 {**_sighting_steps(), **group_steps(profile), **carry_steps(profile)})
            .filter(_session_seen()).withColumn(CARRIED_ID, _carried_id()))
    order = [c.time, *profile.ties_of(rows, GROUP)]

    def last_of_group(frame: DataFrame, value: str, name: str) -> DataFrame:
        # Of rows that nothing else orders the greater value counts.
        group = Window.partitionBy(*profile.keys, GROUP).orderBy(*order, value)
        whole = group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return frame.withColumn(name, F.last(value, ignorenulls=True).over(whole))

    rows = rows.withColumn("_object", look_up(F.col(CARRIED_ID), F.col("meas_ids"), F.col("meas_object_ids")))
    rows = last_of_group(rows, "_object", "_group_object").withColumn(
        "_frequency", look_up(F.col("_group_object"), F.col("object_ids"), F.col("object_frequencies")))
    rows = last_of_group(rows, "_frequency", "_group_frequency").drop(
        "_object", "_group_object", "_frequency", "meas_ids", "meas_object_ids", "object_ids", "object_frequencies")
    shifted = scan(rows, profile.series(), {"T_Freq": Previous(F.col("_group_frequency"))}).drop("_group_frequency")
    reports = shifted.filter(_is(profile, S.REPORT_TOKEN) & (F.size(_other_cells(profile)) > 0))
    return _named(reports, profile)


def suspected_missing_relations(signalling: DataFrame, profile: Profile, keep: Keep = settle) -> DataFrame:
    """Neighbour cells that were reported but never handed over to.

    ``keep`` stores the decoded rows, so that no message is parsed twice, and
    their series are counted once. Series that fit a task go through frames
    alone; longer ones are cut, and the rows that several branches read are
    stored as well. None recomputes the rows and counts nothing.
    """
    store = keep or (lambda df: df)
    decoded = store(decode_messages(event_token(signalling, profile), profile))
    if keep is not None:
        profile = profile.sized(decoded, keep)
    ordered = numbered_rows(with_neighbours(decoded, profile), profile)
    if profile.cuts is None and profile.fixed_slice is None:
        reported = streamed_relations(not_succeeded(ordered, profile), profile)
    else:
        ordered = store(ordered)
        reported = reported_relations(not_succeeded(ordered, profile), profile, store)
    return without_proven(reported, relation_success(ordered, profile), profile)
