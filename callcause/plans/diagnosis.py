"""One diagnosis per failed event, from all probe tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from callcause import schemas as S
from callcause.functions.values import is_true
from callcause.operators import access, handover, radio as R, signalling as G
from callcause.operators.windows import END, KIND, NUMBER, START, failure_windows
from callcause.plans.merged import merged_facts, merged_rows
from callcause.profile import Profile
from callcause.session import settle


@dataclass(frozen=True)
class ProbeTables:
    """Inputs of a diagnosis, one frame per message family."""

    events: DataFrame
    measurements: DataFrame
    signalling: DataFrame
    rach: DataFrame
    physical: DataFrame | None = None


def reference_columns(windows: DataFrame, events: DataFrame, profile: Profile) -> DataFrame:
    """Context of the event row at the end of each window, one row per window.

    Of several rows on that instant the one with the smallest message id counts.
    """
    c = profile.columns
    names = [n for n in S.CONTEXT_COLUMNS if n in events.columns and n not in profile.keys]
    order = [F.col(c.message_id).isNull().alias("_unnumbered"), c.message_id] \
        if c.message_id in events.columns else []
    rest = [name for name in names if name != c.message_id]
    rows = events.select(*profile.keys, F.col(c.time).alias(END), *names)
    first = F.min(F.struct(*order, *rest)).alias("_context")
    return (windows.select(*profile.event_key, END).join(rows, [*profile.keys, END], "inner")
            .groupBy(*profile.event_key).agg(F.max(END).alias(c.time), first)
            .select(*profile.event_key, c.time,
                    *[F.col(f"_context.{name}").alias(name) for name in names]))


def ordered_tags(findings: Sequence[tuple[Column, Column, str]]) -> Column:
    """Tags whose condition holds, by time (unknown first), then in the given order, as one text."""
    entries = F.array(*[
        F.when(condition, F.struct(time.alias("time"), F.lit(rank).alias("rank"),
                                   F.lit(tag).alias("tag")))
        for rank, (condition, time, tag) in enumerate(findings, 1)])
    present = F.array_sort(F.filter(entries, lambda entry: entry.isNotNull()))
    return _or_unidentified(F.concat_ws(", ", F.transform(present, lambda entry: entry.tag)))


def _or_unidentified(text: Column) -> Column:
    return F.when(text == "", S.UNIDENTIFIED).otherwise(text)


def window_facts(tables: ProbeTables, profile: Profile,
                 keep: Callable[[DataFrame], DataFrame] | None = settle) -> DataFrame:
    """All facts about every window in one row.

    All tables go through one tagged stream with one exchange (see
    ``plans.merged``). ``keep`` stores that stream, so that no message is parsed
    twice, and its series are counted once: series too long for one task, like
    windows that rows of other work orders may enter, take interval joins
    instead. None stores and counts nothing.
    """
    if profile.join_keys != profile.keys or profile.fixed_slice is not None:
        return joined_facts(tables, profile, keep)
    merged = merged_rows(tables, profile)
    if keep is not None:
        merged = keep(merged)
        cut = profile.sized(merged, keep)
        if cut.cuts is not None:
            return joined_facts(tables, cut, keep)
    return merged_facts(merged, profile)


def joined_facts(tables: ProbeTables, profile: Profile,
                 keep: Callable[[DataFrame], DataFrame] | None = settle) -> DataFrame:
    """The same by an interval join of each table, then one aggregate by window and a join by its key.

    ``keep`` stores the windows and the signalling rows inside them, which
    several branches use, and the facts that the radio pass joins to, so that the
    planner knows their size; with ``max_slice_rows`` each table's time slices
    are counted. None leaves all to be recomputed.
    """
    key = list(profile.event_key)
    if keep is None:
        windows = failure_windows(tables.events, profile)
        tagged = G.tagged_signalling(windows, tables.signalling, profile)
        facts = windows.join(G.signalling_facts(tagged, profile), key, "left")
    else:
        windows = keep(failure_windows(tables.events, profile))
        tagged = keep(G.tagged_signalling(windows, tables.signalling, profile, keep))
        facts = keep(windows.join(G.signalling_facts(tagged, profile), key, "left"))
        profile = profile.sized(tagged, keep, profile.event_key)
    facts = R.radio_facts(facts, tables.measurements, profile, keep)
    branches = [
        access.rach_facts(windows, tables.rach, profile, keep),
        handover.pingpong_windows(tagged, profile).withColumn("Pingpong", F.lit(True)),
        reference_columns(windows, tables.events, profile),
    ]
    if profile.version == "v1":
        # A window that a handover worked in holds a handover command, so it is never stuck on a
        # cell; v2 asks for nothing else, v1 leaves out evidence of such windows.
        branches.append(handover.handover_success(tagged, profile).withColumn("Handed_Over", F.lit(True)))
    if profile.version == "v2" and tables.physical is not None:
        branches.append(R.bler_facts(windows, tables.physical, profile, keep))
    for branch in branches:
        facts = facts.join(branch, key, "left")
    return facts


def diagnose(tables: ProbeTables, profile: Profile,
             keep: Callable[[DataFrame], DataFrame] | None = settle) -> DataFrame:
    """The diagnosis table of the profile's version."""
    facts = window_facts(tables, profile, keep)
    return diagnosis_v2(facts, profile) if profile.version == "v2" else diagnosis_v1(facts, profile)


def _only(condition: Column, *names: str) -> list[Column]:
    return [F.when(condition, F.col(name)).alias(name) for name in names]


def _leading(facts: DataFrame, profile: Profile) -> list[str]:
    time = profile.columns.time
    context = [n for n in S.CONTEXT_COLUMNS if n in facts.columns]
    return [NUMBER, KIND, START, END, time, *profile.keys, *[n for n in context if n not in profile.keys]]


_LAST = (R.CELL_LAST, R.RSRP_LAST, R.SINR_LAST)
_RADIO = (R.CHANNELS, R.CELLS, R.RSRP_AVG, R.RSRP_MIN, R.SINR_AVG, R.SINR_MIN)


def diagnosis_v2(facts: DataFrame, profile: Profile) -> DataFrame:
    """Tags in the order they occurred; evidence only next to the tag it supports."""
    poor, failed = R.is_poor(profile), handover.stuck_on_cell(profile, exact=False)
    roaming = F.col("Roaming_Time").isNotNull()
    start, reported = F.col(START), F.col("First_Report_Time")
    findings = [
        (poor, F.col("Poor_Time"), S.POOR_RADIO),
        (R.is_lost(), start, S.LOST_SIGNAL),
        (F.col("Signalling_Rows").isNull(), start, S.MISSING_SIGNALLING),
        (roaming, F.col("Roaming_Time"), S.ROAMING),
        (failed, reported, S.HANDOVER_FAILURE),
        (is_true(access.is_rach_failure()), F.col("Rach_Time"), S.RACH_FAILURE),
        (F.col("Pingpong").isNotNull(), F.col("First_Sync_Time"), S.PINGPONG),
        (G.is_reestablish_failure(), F.col("Reestablish_Time"), S.REESTABLISH_FAILURE),
        (G.is_reestablish_success(), F.col("Reestablish_Time"), S.REESTABLISH_SUCCESS),
        (handover.stuck_on_cell(profile, exact=True), reported, S.MISSING_NEIGHBOUR),
    ]
    bler = []
    if R.BLER_AVG in facts.columns:
        high = is_true(F.col(R.BLER_AVG) > profile.bler_ceiling)
        findings.append((high, F.col("Bler_Time"), S.HIGH_BLER))
        bler = _only(high, R.BLER_AVG)
    if profile.legacy_pingpong_v2:
        findings = [finding for finding in findings if finding[2] != S.PINGPONG]
    return facts.select(
        *_leading(facts, profile), *_only(poor, *_RADIO), *_only(roaming, G.NETWORK_CODES),
        *_only(failed, *_LAST), *bler, ordered_tags(findings).alias("Analysis"))


def diagnosis_v1(facts: DataFrame, profile: Profile) -> DataFrame:
    """Tags in fixed order; evidence for every window that has it."""
    radio = F.when(R.is_poor(profile), S.POOR_RADIO).when(R.is_lost(), S.LOST_SIGNAL)
    tags = [
        radio,
        F.when(F.col("Roaming_Time").isNotNull(), S.ROAMING),
        F.when(F.col("Signalling_Rows").isNull(), S.MISSING_SIGNALLING),
        F.when(handover.stuck_on_cell(profile, exact=False), S.HANDOVER_FAILURE),
        F.when(is_true(access.is_rach_failure()), S.RACH_FAILURE),
        F.when(F.col("Pingpong").isNotNull(), profile.pingpong_tag),
        F.when(G.is_reestablish_failure(), S.REESTABLISH_FAILURE),
        F.when(G.is_reestablish_success(), S.REESTABLISH_SUCCESS),
    ]
    stretch = F.col(R.LAST_REPORT).isNotNull() & F.col("Handed_Over").isNull()
    return facts.select(
        *_leading(facts, profile), *_RADIO, G.NETWORK_CODES, *_only(stretch, *_LAST),
        _or_unidentified(F.concat_ws(", ", *tags)).alias("Analysis"))
