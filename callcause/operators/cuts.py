"""Where long series are cut: borders for the hot keys of a stored table alone.

A key with at most ``max_rows`` rows has none and stays whole. The rows of the
others are dealt by ranges of key and order, which splits a hot key over many
tasks; within each task every ``max_rows``-th row is a border. So no slice has
more rows than that, be they a year or an instant apart, unless nothing in the
order tells them apart. Borders of a key become one sorted list, and a row finds
its slice by binary search in a column expression.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

# Lists of borders are handed to every task below this number of borders; above it Spark chooses the join.
HANDED_OUT = 200_000
_ORDER, _BORDER = "_order", "_border"


@dataclass(frozen=True)
class Cuts:
    """Borders by key: ``frame`` has the keys, ``_borders`` (sorted) and ``_splits`` (parts of the slice after each)."""

    keys: tuple[str, ...]
    order: tuple[str, ...]
    frame: DataFrame
    borders: int

    def place(self, rows: DataFrame, *more: Sequence[Column]) -> DataFrame:
        """Rows with the borders of their key, null for keys that stay whole."""
        borders = self.frame.select(*[F.col(key).alias(f"_cut_{key}") for key in self.keys], "_borders", "_splits")
        if self.borders <= HANDED_OUT:
            borders = F.broadcast(borders)
        same = [F.col(key).eqNullSafe(F.col(f"_cut_{key}")) for key in self.keys]
        condition = same[0]
        for part in same[1:]:
            condition = condition & part
        return rows.join(borders, condition, "left").drop(*[f"_cut_{key}" for key in self.keys])


def position(borders: Column, value: Column) -> Column:
    """How many of the sorted borders are at most the value, by binary search; null without borders."""
    def halve(state: Column, _: Column) -> Column:
        middle = F.shiftright(state.low + state.high, 1)
        return (F.when(state.low >= state.high, state)
                .when(F.get(borders, middle) <= value, F.struct((middle + 1).alias("low"), state.high.alias("high")))
                .otherwise(F.struct(state.low.alias("low"), middle.alias("high"))))

    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(borders) + 1)).cast("int"))
    start = F.struct(F.lit(0).alias("low"), F.size(borders).alias("high"))
    return F.when(borders.isNotNull(), F.aggregate(rounds, start, halve, lambda state: state.low))


def order_of(order: Sequence[str]) -> Column:
    return F.struct(*[F.col(name).alias(f"o{k}") for k, name in enumerate(order)])


def find_cuts(stored: DataFrame, keys: Sequence[str], order: Sequence[str], max_rows: int,
              keep: Callable[[DataFrame], DataFrame]) -> Cuts | None:
    """Cuts of a stored table, None if every series has at most ``max_rows`` rows.

    Counts the series once. Only if some are too long, their keys and orders are
    read again and dealt by range; hot keys are at most rows / max_rows.
    """
    keys = tuple(keys)
    hot = stored.groupBy(*keys).count().filter(F.col("count") > max_rows)
    many, total = hot.agg(F.count(F.lit(1)), F.sum("count")).first()
    if not many:
        return None
    hot = keep(hot.select(*[F.col(key).alias(f"_hot_{key}") for key in keys]))
    same = [F.col(key).eqNullSafe(F.col(f"_hot_{key}")) for key in keys]
    condition = same[0]
    for part in same[1:]:
        condition = condition & part
    rows = stored.join(F.broadcast(hot) if many <= HANDED_OUT else hot, condition, "left_semi").select(*keys, order_of(order).alias(_ORDER))
    dealt = (rows.repartitionByRange(max(1, min(-(-total // max_rows), 10_000)), *keys, _ORDER).sortWithinPartitions(*keys, _ORDER)
             .withColumn("_row", F.monotonically_increasing_id()))
    chunk = F.floor(F.col("_row") / max_rows)  # the upper bits of a row number name its partition
    chunks = dealt.groupBy(*keys, F.shiftright("_row", 33).alias("_part"), chunk.alias("_chunk")).agg(F.min(_ORDER).alias(_BORDER))
    # Several chunks from one border on are a slice of rows that the order cannot part.
    borders = chunks.groupBy(*keys, _BORDER).count()
    listed = F.sort_array(F.collect_list(F.struct(F.col(_BORDER), F.when(F.col("count") > 1, F.col("count") + 1).otherwise(1).alias("n"))))
    frame = keep(borders.groupBy(*keys).agg(listed.alias("_b")).select(
        *keys, F.col(f"_b.{_BORDER}").alias("_borders"), F.col("_b.n").alias("_splits")))
    found = frame.agg(F.sum(F.size("_borders"))).first()[0]
    return Cuts(keys, tuple(order), frame, found)
