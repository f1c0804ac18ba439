"""Detectors on radio measurements and block-error samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from callcause import schemas as S
from callcause.functions.values import first_time, set_text
from callcause.operators.windows import END, START, Keep, window_rows
from callcause.profile import Profile

TAG, TAG_TIME = "Tag_Name", "Tag_Time"
LAST_REPORT = "Last_Report_Time"
CHANNELS, CELLS = "NR5G_PCC_NARFCN", "NR5G_PCC_PCI"
RSRP_AVG, RSRP_MIN = "NR5G_PCC_RSRP_Avg", "NR5G_PCC_RSRP_Min"
SINR_AVG, SINR_MIN = "NR5G_PCC_SINR_Avg", "NR5G_PCC_SINR_Min"
CELL_LAST, RSRP_LAST, SINR_LAST = "NR5G_PCC_PCI_Last", "NR5G_PCC_RSRP_Last", "NR5G_PCC_SINR_Last"
RSRP_LAST_EXACT, SINR_LAST_EXACT = "RSRP_Last_Exact", "SINR_Last_Exact"
CELL_COUNT_LAST = "Cell_Count_Last"
BLER_AVG = "PHYDL_NR5G_PCC_BLER_Avg"


def poor_radio(rsrp: Column, sinr: Column, profile: Profile) -> Column:
    """Either value below its floor; a missing value is not below anything."""
    return (F.coalesce(rsrp < profile.rsrp_floor, F.lit(False))
            | F.coalesce(sinr < profile.sinr_floor, F.lit(False)))


def _probe(meas: DataFrame, profile: Profile) -> DataFrame:
    c = profile.columns
    return meas.select(*profile.keys, c.time, c.channel, c.cell, c.rsrp, c.sinr)


def _whole_window(profile: Profile) -> list[Column]:
    c = profile.columns
    rsrp, sinr = F.col(c.rsrp), F.col(c.sinr)
    return [
        F.collect_set(c.channel).alias(CHANNELS),
        F.collect_set(c.cell).alias(CELLS),
        F.round(F.avg(rsrp), profile.digits).alias(RSRP_AVG),
        F.round(F.min(rsrp), profile.digits).alias(RSRP_MIN),
        F.round(F.avg(sinr), profile.digits).alias(SINR_AVG),
        F.round(F.min(sinr), profile.digits).alias(SINR_MIN),
        first_time(poor_radio(rsrp, sinr, profile), c.time).alias("Poor_Time"),
    ]


def _last_stretch(profile: Profile, inside: Column) -> list[Column]:
    c = profile.columns

    def only(name: str) -> Column:
        return F.when(inside, F.col(name))

    return [
        F.collect_set(only(c.cell)).alias(CELL_LAST),
        F.avg(only(c.rsrp)).alias(RSRP_LAST_EXACT),
        F.avg(only(c.sinr)).alias(SINR_LAST_EXACT),
    ]


def _finish_last(facts: DataFrame, profile: Profile) -> DataFrame:
    return facts.withColumns({
        CELL_COUNT_LAST: F.coalesce(F.size(CELL_LAST), F.lit(0)),
        CELL_LAST: set_text(F.col(CELL_LAST)),
        RSRP_LAST: F.round(RSRP_LAST_EXACT, profile.digits),
        SINR_LAST: F.round(SINR_LAST_EXACT, profile.digits),
    })


def radio_facts(windows: DataFrame, meas: DataFrame, profile: Profile, keep: Keep = None) -> DataFrame:
    """Radio summary of every window, windows without samples included.

    When the windows carry the time of their last neighbour report, the same pass
    over the samples also summarises the stretch from there to the failure. The
    windows are read twice, so they should be stored. ``keep`` as in ``window_rows``.
    """
    key = list(profile.event_key)
    with_last = LAST_REPORT in windows.columns
    measures = _whole_window(profile)
    if with_last:
        measures += _last_stretch(profile, F.col(profile.columns.time) >= F.col(LAST_REPORT))
    borders = [*key, START, END, *([LAST_REPORT] if with_last else [])]
    rows = window_rows(windows.select(*borders), _probe(meas, profile), profile, keep=keep)
    facts = windows.join(rows.groupBy(*key).agg(*measures), key, "left").withColumns({
        CHANNELS: set_text(F.col(CHANNELS)), CELLS: set_text(F.col(CELLS))})
    return _finish_last(facts, profile) if with_last else facts


def is_poor(profile: Profile) -> Column:
    return poor_radio(F.col(RSRP_AVG), F.col(SINR_AVG), profile)


def is_lost() -> Column:
    return F.col(RSRP_AVG).isNull() & F.col(SINR_AVG).isNull()


def radio_condition(facts: DataFrame, profile: Profile) -> DataFrame:
    """Poor radio. v2 keeps the tagged windows; v1 keeps all and names lost signal in the same column."""
    evidence = [*profile.event_key, CHANNELS, CELLS, RSRP_AVG, RSRP_MIN, SINR_AVG, SINR_MIN]
    if profile.version == "v1":
        tag = F.when(is_poor(profile), S.POOR_RADIO).when(is_lost(), S.LOST_SIGNAL)
        return facts.select(*evidence, tag.alias(TAG))
    return facts.filter(is_poor(profile)).select(
        *evidence, F.col("Poor_Time").alias(TAG_TIME), F.lit(S.POOR_RADIO).alias(TAG))


def lost_signal(facts: DataFrame, profile: Profile) -> DataFrame:
    """Windows without any radio value, tagged at their start."""
    return facts.filter(is_lost()).select(
        *profile.event_key, F.col(START).alias(TAG_TIME), F.lit(S.LOST_SIGNAL).alias(TAG))


def subwindow_radio(subwindows: DataFrame, meas: DataFrame, profile: Profile,
                    exact: bool = False) -> DataFrame:
    """Radio from the last neighbour report to the failure, with its two checks.

    ``exact`` compares averages that are not rounded. v2 drops rows that pass
    neither check.
    """
    key = list(profile.event_key)
    rows = window_rows(subwindows, _probe(meas, profile), profile, start=LAST_REPORT)
    found = rows.groupBy(*key).agg(*_last_stretch(profile, F.lit(True)))
    facts = _finish_last(subwindows.select(*key, LAST_REPORT, END).join(found, key, "left"), profile)
    suffix = (RSRP_LAST_EXACT, SINR_LAST_EXACT) if exact else (RSRP_LAST, SINR_LAST)
    checked = facts.select(
        *key, LAST_REPORT, CELL_LAST, F.col(suffix[0]).alias(RSRP_LAST),
        F.col(suffix[1]).alias(SINR_LAST),
        one_cell(profile).alias("One_Cell"), poor_last(profile, exact).alias("Poor_Last"))
    if profile.version == "v2":
        checked = checked.filter(F.col("One_Cell") | F.col("Poor_Last"))
    return checked


def one_cell(profile: Profile) -> Column:
    """A single serving cell since the last report."""
    if profile.legacy_single_pci:
        return F.length(CELL_LAST) < 5
    return F.col(CELL_COUNT_LAST) <= 1


def poor_last(profile: Profile, exact: bool) -> Column:
    names = (RSRP_LAST_EXACT, SINR_LAST_EXACT) if exact else (RSRP_LAST, SINR_LAST)
    return poor_radio(F.col(names[0]), F.col(names[1]), profile)


def bler_facts(windows: DataFrame, phydl: DataFrame, profile: Profile, keep: Keep = None) -> DataFrame:
    """Average downlink block-error rate per window that has samples."""
    c = profile.columns
    samples = phydl.filter(F.col(c.bler).isNotNull()).select(*profile.keys, c.time, c.bler)
    slim = windows.select(*profile.event_key, START, END)
    return window_rows(slim, samples, profile, keep=keep).groupBy(*profile.event_key).agg(
        F.round(F.avg(c.bler), profile.digits).alias(BLER_AVG),
        first_time(F.col(c.bler) > profile.bler_ceiling, c.time).alias("Bler_Time"))


def high_bler(facts: DataFrame, profile: Profile) -> DataFrame:
    return facts.filter(F.col(BLER_AVG) > profile.bler_ceiling).select(
        *profile.event_key, BLER_AVG, F.col("Bler_Time").alias(TAG_TIME),
        F.lit(S.HIGH_BLER).alias(TAG))
