"""Analysis windows of failed events, and the probe rows that fall into them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, functions as F

from callcause.operators.cuts import Cuts, find_cuts, order_of, position
from callcause.operators.sequence import NextKnown, Previous, RunningSum, scan, time_slice
from callcause.profile import Profile

Keep = Callable[[DataFrame], DataFrame] | None

NUMBER = "Failed_Event_Number"
KIND = "Failed_Event_Type"
START = "Event_Analysis_Start_Time"
END = "Event_Analysis_End_Time"


def _failed(profile: Profile) -> Column:
    return F.col(profile.columns.call_event).contains(profile.marker)


def _marker_rows(events: DataFrame, profile: Profile) -> DataFrame:
    event = F.col(profile.columns.call_event)
    borders = event.isin(profile.setup_text, profile.end_text)
    return (events.filter(borders | _failed(profile))
            .select(*profile.keys, profile.columns.time, *profile.ties_of(events, profile.columns.call_event), event))


def failure_windows(events: DataFrame, profile: Profile) -> DataFrame:
    """One row per failed event: from the marker before it (null for the first) to its own time."""
    time = profile.columns.time
    failed = _failed(profile)
    numbered = scan(_marker_rows(events, profile), profile.series(), {
        START: Previous(F.col(time)),
        NUMBER: RunningSum(failed.cast("long")),
    })
    return numbered.filter(failed).select(
        *profile.keys, NUMBER, F.col(profile.columns.call_event).alias(KIND), START,
        F.col(time).alias(END),
    )


def window_rows(windows: DataFrame, rows: DataFrame, profile: Profile, how: str = "inner",
                start: str = START, end: str = END,
                keep: Keep = None) -> DataFrame:
    """Rows with ``start <= time <= end``, both ends included, next to their window.

    Every window is spread over the time slices it touches and meets the rows of
    the same key and slice in an equi join. A busy device is so split by time,
    and a window is never compared with rows of other slices.

    ``how="left"`` also keeps windows without rows. It reads the matched rows
    twice; ``keep`` may store them first, None computes them twice.

    With ``keep`` and ``max_slice_rows`` the rows of each slice are counted, and
    slices with more are cut at the times of their rows. A window then goes to
    the parts it touches, and to every share of an instant whose rows are dealt
    over several.
    """
    seconds, time = profile.slice_seconds, profile.columns.time
    first, last = time_slice(start, seconds), time_slice(end, seconds)
    spread = (windows.filter(F.col(start) <= F.col(end))
              .withColumn("_slice", F.explode(F.sequence(first, last))))
    probes = rows.filter(F.col(time).isNotNull()).withColumn("_slice", time_slice(time, seconds))
    on = [*profile.join_keys, "_slice"]
    if keep is not None and profile.max_slice_rows is not None:
        dense = find_cuts(probes.select(*on, time), on, (time,), profile.max_slice_rows, keep)
        if dense is not None:
            spread, probes = _in_parts(spread, dense, start, end), _dealt(probes, dense)
            on = [*on, "_part", "_share"]
    return _joined(windows, spread, probes, on, profile, how, start, end, keep)


def _dealt(probes: DataFrame, dense: Cuts) -> DataFrame:
    """Rows with their part of a dense slice, and their share of the part; rows equal in all columns stay together."""
    shares = F.coalesce(F.get("_splits", F.col("_part") - 1), F.lit(1))
    part = F.coalesce(position(F.col("_borders"), order_of(dense.order)), F.lit(0))
    whole = F.xxhash64(*[F.col(f.name) for f in probes.schema if f.dataType.simpleString().split("<")[0] not in ("map", "variant")])
    return (dense.place(probes).withColumn("_part", part)
            .withColumn("_share", F.when(shares > 1, F.pmod(whole, shares).cast("int")).otherwise(0)).drop("_borders", "_splits"))


def _in_parts(spread: DataFrame, dense: Cuts, start: str, end: str) -> DataFrame:
    """Windows once for every part of a dense slice that they touch, and every share of it."""
    def part_of(name: str) -> Column:
        return F.coalesce(position(F.col("_borders"), F.struct(F.col(name).alias("o0"))), F.lit(0))

    def shares(part: Column) -> Column:
        count = F.coalesce(F.get("_splits", part - 1), F.lit(1))
        return F.transform(F.sequence(F.lit(0), count - 1), lambda share: F.struct(part.alias("_part"), share.alias("_share")))

    places = F.flatten(F.transform(F.sequence(part_of(start), part_of(end)), shares))
    return (dense.place(spread).withColumn("_place", F.explode(places))
            .select("*", "_place.*").drop("_place", "_borders", "_splits"))


def event_messages(events: DataFrame, profile: Profile,
                   keep: Keep = None) -> DataFrame:
    """All call events inside each window, from its first marker to the failure."""
    windows = failure_windows(events, profile)
    return window_rows(keep(windows) if keep else windows, events, profile, "left", keep=keep)


def window_rows_keyed(windows: DataFrame, rows: DataFrame, profile: Profile, how: str = "inner",
                      start: str = START, end: str = END) -> DataFrame:
    """The same by key alone: every window of a key meets all its rows, so it is for keys that have few of either."""
    return _joined(windows, windows, rows, list(profile.join_keys), profile, how, start, end)


def _joined(windows: DataFrame, spread: DataFrame, probes: DataFrame, on: Sequence[str],
            profile: Profile, how: str, start: str, end: str,
            keep: Keep = None) -> DataFrame:
    time = profile.columns.time
    foreign = [key for key in profile.keys if key not in profile.join_keys]
    inside = F.col(time).between(F.col(start), F.col(end))
    matched = spread.join(probes.drop(*foreign), list(on), "inner").filter(inside).drop("_slice", "_part", "_share")
    if how != "left":
        return matched
    return with_empty_windows(windows, keep(matched) if keep else matched, profile)


def with_empty_windows(windows: DataFrame, matched: DataFrame, profile: Profile) -> DataFrame:
    """Add the windows that matched no row, with nulls on the row's side.

    The keys of the matched rows are made unique first, so one window with very
    many rows does not skew the join.
    """
    key = list(profile.event_key)
    empty = windows.join(matched.select(*key).distinct(), key, "left_anti")
    return matched.unionByName(empty, allowMissingColumns=True)


def window_rows_linear(events: DataFrame, rows: DataFrame, profile: Profile) -> DataFrame:
    """The inner form without an interval join: every row looks up the markers around it.

    Windows of one key lie end to end, so a row belongs to the window that closes
    on the next marker instant at or after it and, on a marker instant itself, to
    the window that opens there. Of the windows that close on one instant only
    the first is longer than the instant, so a marker instant carries two windows
    at most, and a row takes those around it in one pass over the series. Windows
    of one instant, of which there may be many, meet the rows of the same instant
    in an equi join by key and time, where every pair is a row of the result.

    Where rows of other work orders may enter a window (``join_keys`` shorter
    than ``keys``), they first go to every series of their device that has
    windows: there is one open window in each at most, except on an instant.
    Rows and events with a null key meet nothing.
    """
    time, keys = profile.columns.time, list(profile.keys)
    foreign = [key for key in keys if key not in profile.join_keys]
    own = [name for name in rows.columns if name not in (*keys, time)]
    for key in keys:
        events = events.filter(F.col(key).isNotNull())
    for key in profile.join_keys:
        rows = rows.filter(F.col(key).isNotNull())
    windows = failure_windows(events, profile).filter(F.col(START) <= F.col(END))
    rows = rows.filter(F.col(time).isNotNull()).drop(*foreign)
    # Dealt by instant, where they would stay together by key, and into a fixed number of parts, as the planner merges parts by
    # what they read and a few rows and windows make many pairs.
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    instant = windows.filter(F.col(START) == F.col(END)).withColumn(time, F.col(END)).repartition(parts, *profile.join_keys, time)
    within = rows.join(instant, [*profile.join_keys, time]).select(*keys, NUMBER, KIND, START, END, time, *own)
    if foreign:
        rows = rows.join(windows.select(*keys).distinct(), list(profile.join_keys))
    window = F.struct(NUMBER, KIND, START, END)
    none = F.lit(None)
    ends = F.array(F.struct(F.col(END).alias(time), window.alias("_closing"), none.alias("_opening")),
                   F.struct(F.col(START).alias(time), none.alias("_closing"), window.alias("_opening")))
    longer = windows.filter(F.col(START) < F.col(END)).select(*keys, F.inline(ends))
    instants = _marker_rows(events, profile).filter(F.col(time).isNotNull()).select(*keys, time)
    around = (instants.unionByName(longer, allowMissingColumns=True).groupBy(*keys, time)
              .agg(F.first("_closing", True).alias("_closing"), F.first("_opening", True).alias("_opening")))
    marked = around.select(*keys, time, F.lit(1).alias("_side"),
                           F.struct(F.col(time).alias("at"), "_closing", "_opening").alias("_around"))
    # An instant's markers stand after its rows, so that these find it as the next one.
    mixed = rows.withColumn("_side", F.lit(0)).unionByName(marked, allowMissingColumns=True)
    ahead = scan(mixed, replace(profile.series(), tie=("_side",), whole_instants=True), {"_next": NextKnown(F.col("_around"))})
    found = F.array(F.col("_next._closing"), F.when(F.col("_next.at") == F.col(time), F.col("_next._opening")))
    passed = (ahead.filter(F.col("_side") == 0).withColumn("_window", F.explode(found)).filter(F.col("_window").isNotNull())
              .select(*keys, "_window.*", time, *own))
    return passed.unionByName(within)
