"""Small column expressions shared by the detectors."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def is_true(condition: Column) -> Column:
    """The condition, with unknown taken as false."""
    return F.coalesce(condition, F.lit(False))


def ever(condition: Column) -> Column:
    """Aggregate: does any row of the group meet the condition?"""
    return F.bool_or(is_true(condition))


def first_time(condition: Column, time: str) -> Column:
    """Aggregate: the earliest time of a row that meets the condition."""
    return F.min(F.when(condition, F.col(time)))


def last_time(condition: Column, time: str) -> Column:
    """Aggregate: the latest time of a row that meets the condition."""
    return F.max(F.when(condition, F.col(time)))


def set_text(values: Column) -> Column:
    """A set as text: sorted, comma separated, empty for an empty or missing set."""
    return F.concat_ws(", ", F.sort_array(values).cast("array<string>"))


def empty_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def second_word(text: Column) -> Column:
    """Second space-separated word, null when there is none."""
    return F.get(F.split(text, " "), F.lit(1))


def look_up(key: Column, keys: Column, values: Column) -> Column:
    """Value at the first position of the key in a parallel array, null when it is not there."""
    return F.get(values, (F.array_position(keys, key) - 1).cast("int"))
