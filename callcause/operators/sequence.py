"""Row-order operators (lag, lead, running sum, fills) for series of any length.

A plain window function sorts all rows of one key in one task, which is right
while every series fits there. A longer series is cut into slices: every
slice is its own window partition, and small carrier rows bring in what a slice
needs from its neighbours: the sum so far, the last known value, the previous
row, the rows that follow. Carriers are built from one summary row per slice, so
only summaries of a key ever meet in one task. Slices are of one width in time,
or lie between the borders of ``operators.cuts``, which only long series have.
All ways give the same result.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from callcause.operators.cuts import Cuts, order_of, position

_SLICE, _EDGE, _RANK, _TARGET = "_slice", "_edge", "_rank", "_target"
_BEFORE_ROWS, _AFTER_ROWS = -1, 1_000_000
_BEFORE_ALL_TIME = -(2 ** 62)
_WHOLE = -1


@dataclass(frozen=True)
class Series:
    """Rows of equal keys, ordered by time, then the tie columns that a frame has, then its other columns.

    So the order is total: rows that no column tells apart are interchangeable,
    and no result depends on the order in which rows come. ``chunk_seconds`` is
    the width of the time slices, None for no slices. ``cuts`` are the borders
    of the long series of a table that holds all rows, by the same keys, time
    and tie columns; they go before a width. With ``whole_instants`` no border
    parts the rows of one instant.
    """

    keys: tuple[str, ...]
    time: str
    tie: tuple[str, ...] = ()
    chunk_seconds: int | None = None
    cuts: Cuts | None = None
    whole_instants: bool = False


@dataclass(frozen=True)
class Previous:
    """Value on the row before."""

    value: Column


@dataclass(frozen=True)
class Following:
    """Value ``offset`` rows later."""

    value: Column
    offset: int = 1


@dataclass(frozen=True)
class RunningSum:
    """Sum from the start of the series up to and with this row; null while nothing was added."""

    value: Column


@dataclass(frozen=True)
class LastKnown:
    """Last non-null value up to and with this row; with ``peers``, up to the last row of the same instant."""

    value: Column
    peers: bool = False


@dataclass(frozen=True)
class NextKnown:
    """First non-null value on the rows after this one."""

    value: Column


Step = Previous | Following | RunningSum | LastKnown | NextKnown


def time_slice(time: str | Column, seconds: int) -> Column:
    """Number of the time slice a timestamp lies in."""
    column = F.col(time) if isinstance(time, str) else time
    return F.floor(F.unix_micros(column) / F.lit(seconds * 1_000_000)).cast("long")


def _orderable(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _orderable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_orderable(f.dataType) for f in kind)
    return not isinstance(kind, (T.MapType, T.VariantType, T.CalendarIntervalType))


def total_tie(df: DataFrame, keys: tuple[str, ...], time: str, tie: tuple[str, ...]) -> tuple[str, ...]:
    """The columns that order rows of one instant: the tie columns the frame has, then all others."""
    first = [name for name in tie if name in df.columns and name not in (*keys, time)]
    rest = [f.name for f in df.schema if f.name not in (*keys, time, *first) and _orderable(f.dataType)]
    return (*first, *rest)


def scan(df: DataFrame, series: Series, steps: Mapping[str, Step]) -> DataFrame:
    """Add one column per step. Runs no job."""
    seconds, cuts = series.chunk_seconds, series.cuts
    series = replace(series, tie=total_tie(df, series.keys, series.time, series.tie))
    inputs = {name: f"_in_{name}" for name in steps}
    rows = df.withColumns({inputs[name]: step.value for name, step in steps.items()})
    partition, order = list(series.keys), [series.time, *series.tie]
    if cuts is not None:
        peers = any(isinstance(step, LastKnown) and step.peers for step in steps.values())
        rows = cut_rows(rows, cuts, peers or series.whole_instants)
    elif seconds is not None:
        rows = rows.withColumn(_SLICE, F.coalesce(time_slice(series.time, seconds), F.lit(_BEFORE_ALL_TIME)))
    cut = cuts is not None or seconds is not None
    if cut:
        rows = rows.withColumn(_EDGE, F.lit(0))
        sliced = rows.filter(F.col(_SLICE) != _WHOLE) if cuts is not None else rows
        for carriers in _carriers(sliced, series, steps, inputs):
            rows = rows.unionByName(carriers, allowMissingColumns=True)
        partition, order = [*partition, _SLICE], [_EDGE, *order]

    forward = Window.partitionBy(*partition).orderBy(*order)
    backward = Window.partitionBy(*partition).orderBy(*[F.col(name).desc() for name in order])
    so_far = (Window.unboundedPreceding, Window.currentRow)
    results, shared = {}, []
    for name, step in steps.items():
        value = F.col(inputs[name])
        match step:
            case Previous():
                results[name] = F.lag(value, 1).over(forward)
            case Following(offset=offset):
                results[name] = F.lead(value, offset).over(forward)
            case RunningSum():
                results[name] = F.sum(value).over(forward.rowsBetween(*so_far))
            case LastKnown(peers=peers):
                results[name] = F.last(value, ignorenulls=True).over(forward.rowsBetween(*so_far))
                if peers:
                    shared.append(name)
            case NextKnown():
                earlier = backward.rowsBetween(Window.unboundedPreceding, -1)
                results[name] = F.last(value, ignorenulls=True).over(earlier)
    rows = rows.withColumns(results)
    if shared:  # the value that the last row of the instant has; the same exchange and sort serve it
        instant = Window.partitionBy(*partition, *order[:-len(series.tie) or None]).orderBy(*(series.tie or order))
        instant = instant.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        rows = rows.withColumns({name: F.last(F.col(name)).over(instant) for name in shared})
    if cut:
        rows = rows.filter(F.col(_EDGE) == 0)
    return rows.drop(_SLICE, _EDGE, *inputs.values())


def cut_rows(rows: DataFrame, cuts: Cuts, whole_instants: bool = False) -> DataFrame:
    """Add the slice of each row, -1 for series that stay whole.

    With ``whole_instants`` borders inside an instant do not count, so that its
    rows stay together.
    """
    placed = cuts.place(rows)
    names = [name for name in cuts.order if name in rows.columns]
    if whole_instants or len(names) < len(cuts.order):
        # Borders by time alone; the first of an instant opens it.
        borders, value = F.array_distinct(F.transform("_borders", lambda border: border.o0)), F.col(cuts.order[0])
        borders, value = F.transform(borders, lambda time: F.struct(time.alias("o0"))), F.struct(value.alias("o0"))
    else:
        borders, value = F.col("_borders"), order_of(cuts.order)
    slice_ = F.coalesce(position(borders, value).cast("long"), F.lit(_WHOLE).cast("long"))
    return placed.withColumn(_SLICE, slice_).drop("_borders", "_splits")


def _carriers(rows: DataFrame, series: Series, steps: Mapping[str, Step],
              inputs: Mapping[str, str]) -> list[DataFrame]:
    far = {name: step for name, step in steps.items() if isinstance(step, Following)}
    if max((step.offset for step in far.values()), default=1) == 1:
        far = {}
    near = {name: step for name, step in steps.items() if name not in far}
    found = []
    if near:
        found += _summary_carriers(rows, series, near, inputs)
    if far:
        found.append(_head_carriers(rows, series, far, inputs))
    return found


def _row_order(series: Series) -> Column:
    """Orderable value of a row; a plain long without tie columns, so that it hash-aggregates."""
    micros = F.coalesce(F.unix_micros(F.col(series.time)), F.lit(_BEFORE_ALL_TIME))
    return F.struct(micros, *series.tie) if series.tie else micros


def _summary_carriers(rows: DataFrame, series: Series, steps: Mapping[str, Step],
                      inputs: Mapping[str, str]) -> list[DataFrame]:
    order = _row_order(series)
    summaries, before, after = [], {}, {}
    by_slice = Window.partitionBy(*series.keys).orderBy(_SLICE)
    by_slice_back = Window.partitionBy(*series.keys).orderBy(F.col(_SLICE).desc())
    earlier = (Window.unboundedPreceding, -1)
    for name, step in steps.items():
        column = inputs[name]
        value = F.col(column)
        known = F.when(value.isNotNull(), order)
        match step:
            case Previous():
                summary = F.max_by(value, order)
                before[column] = F.lag(column, 1).over(by_slice)
            case RunningSum():
                summary = F.sum(value)
                before[column] = F.sum(column).over(by_slice.rowsBetween(*earlier))
            case LastKnown():
                summary = F.max_by(value, known)
                before[column] = F.last(column, ignorenulls=True).over(by_slice.rowsBetween(*earlier))
            case NextKnown():
                summary = F.min_by(value, known)
                after[column] = F.last(column, ignorenulls=True).over(by_slice_back.rowsBetween(*earlier))
            case Following():
                summary = F.min_by(value, order)
                after[column] = F.lead(column, 1).over(by_slice)
        summaries.append(summary.alias(column))
    place = [*series.keys, _SLICE]
    slices = rows.groupBy(*place).agg(*summaries)
    return [
        slices.select(*place, F.lit(edge).alias(_EDGE), *[c.alias(n) for n, c in carried.items()])
        for edge, carried in ((_BEFORE_ROWS, before), (_AFTER_ROWS, after)) if carried
    ]


def _head_carriers(rows: DataFrame, series: Series, steps: Mapping[str, Following],
                   inputs: Mapping[str, str]) -> DataFrame:
    """For every slice the few rows that follow it, taken from the first rows of later slices."""
    depth = max(step.offset for step in steps.values())
    columns = [inputs[name] for name in steps]
    place = [*series.keys, _SLICE]
    top = Window.partitionBy(*place).orderBy(series.time, *series.tie)
    # Spark turns the rank filter into a limit before the shuffle: at most ``depth`` rows per slice and task.
    heads = (rows.withColumn(_RANK, F.row_number().over(top)).filter(F.col(_RANK) <= depth)
             .select(*place, _RANK, *columns))
    by_head = Window.partitionBy(*series.keys).orderBy(_SLICE, _RANK)
    by_slice = Window.partitionBy(*series.keys).orderBy(_SLICE)
    following = [
        F.struct(F.lit(i + 1).alias(_EDGE), *[F.lead(c, i).over(by_head).alias(c) for c in columns])
        for i in range(depth)
    ]
    starts = (heads.withColumn("_following", F.array(*following)).filter(F.col(_RANK) == 1)
              .withColumn(_TARGET, F.lag(_SLICE, 1).over(by_slice))
              .filter(F.col(_TARGET).isNotNull()))
    return starts.select(*series.keys, F.col(_TARGET).alias(_SLICE), F.inline("_following"))
