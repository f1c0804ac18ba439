"""Handover detectors: sequences of signalling rows inside a window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from callcause import schemas as S
from callcause.functions.values import is_true
from callcause.operators import radio as R
from callcause.operators import signalling as G
from callcause.operators.sequence import Following, scan
from callcause.profile import Profile


def handover_success(tagged: DataFrame, profile: Profile) -> DataFrame:
    """Windows in which the ordered target cell serves the next two handover rows."""
    c = profile.columns
    event, cell = F.col(c.rrc_event), F.col(c.rrc_cell).cast("long")
    steps = tagged.filter(
        event.isin(S.RECONFIGURATION, S.RECONFIGURATION_COMPLETE) | event.rlike(S.SYSTEM_INFORMATION))
    ahead = scan(steps, profile.series(profile.event_key), {"_cell1": Following(cell), "_cell2": Following(cell, 2)})
    target = F.col(G.TARGET)
    return (ahead.filter((target == F.col("_cell1")) & (target == F.col("_cell2")))
            .select(*profile.event_key).distinct())


def handovers(tagged: DataFrame, profile: Profile) -> DataFrame:
    """Start times of completed handovers: sent, received and completed in three rows on end."""
    return _handovers(tagged, profile).select(*profile.event_key, profile.columns.time)


def _handovers(tagged: DataFrame, profile: Profile) -> DataFrame:
    """The same with the tie columns, which order handovers of one instant."""
    c = profile.columns
    event = F.col(c.rrc_event)
    step = (F.when(F.col(G.CHECK) == G.SYNC_CHECK, "sent")
            .when(event == S.RECONFIGURATION_COMPLETE, "received")
            .when(event.rlike(S.SYSTEM_INFORMATION), "completed"))
    steps = (tagged.withColumn("_step", step).filter(F.col("_step").isNotNull())
             .select(*profile.event_key, c.time, *profile.ties_of(tagged), "_step"))
    ahead = scan(steps, profile.series(profile.event_key), {"_step1": Following(F.col("_step")),
                                              "_step2": Following(F.col("_step"), 2)})
    return ahead.filter((F.col("_step") == "sent") & (F.col("_step1") == "received")
                        & (F.col("_step2") == "completed")).drop("_step", "_step1", "_step2")


def pingpong_windows(tagged: DataFrame, profile: Profile) -> DataFrame:
    """Windows with three handovers in which both gaps are short."""
    time = profile.columns.time
    ahead = scan(_handovers(tagged, profile), profile.series(profile.event_key),
                 {"_time1": Following(F.col(time)), "_time2": Following(F.col(time), 2)})

    def seconds(later: str, earlier: str) -> Column:
        return F.col(later).cast("double") - F.col(earlier).cast("double")

    limit = profile.pingpong_seconds
    return (ahead.filter((seconds("_time1", time) <= limit) & (seconds("_time2", "_time1") <= limit))
            .select(*profile.event_key).distinct())


def pingpong_handover(tagged: DataFrame, facts: DataFrame, profile: Profile) -> DataFrame:
    """One row per window that ping-pongs, tagged at its first handover command."""
    key = list(profile.event_key)
    times = facts.select(*key, F.col("First_Sync_Time").alias(R.TAG_TIME))
    return (pingpong_windows(tagged, profile).join(times, key, "inner")
            .withColumn(R.TAG, F.lit(profile.pingpong_tag)))


def stuck_on_cell(profile: Profile, exact: bool) -> Column:
    """Only neighbour reports in the window, one serving cell and poor radio since the last of them."""
    return is_true(G.only_reports() & R.one_cell(profile) & R.poor_last(profile, exact))


def _stuck(facts: DataFrame, profile: Profile, exact: bool, tag: str) -> DataFrame:
    evidence = [] if exact else [R.CELL_LAST, R.RSRP_LAST, R.SINR_LAST]
    return facts.filter(stuck_on_cell(profile, exact)).select(
        *profile.event_key, *evidence, F.col("First_Report_Time").alias(R.TAG_TIME),
        F.lit(tag).alias(R.TAG))


def last_stretch_facts(windows: DataFrame, facts: DataFrame, meas: DataFrame,
                       profile: Profile) -> DataFrame:
    """Windows with signalling facts and the radio summary up to the failure in one row."""
    key = list(profile.event_key)
    reported = windows.join(
        facts.select(*key, G.LAST_REPORT, "First_Report_Time", "Other_Class"), key, "inner")
    return R.radio_facts(reported, meas, profile)


def handover_failure(stretch: DataFrame, success: DataFrame, profile: Profile) -> DataFrame:
    """Reports without a handover command while radio got poor, and no handover that worked."""
    found = _stuck(stretch, profile, False, S.HANDOVER_FAILURE)
    return found.join(success, list(profile.event_key), "left_anti")


def missing_neighbour(stretch: DataFrame, profile: Profile) -> DataFrame:
    """The same on unrounded averages, whether or not a handover worked."""
    return _stuck(stretch, profile, True, S.MISSING_NEIGHBOUR)
