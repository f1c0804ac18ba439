"""Detector on random-access attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from callcause import schemas as S
from callcause.functions.values import ever, first_time, is_true
from callcause.operators.radio import TAG, TAG_TIME
from callcause.operators.windows import END, START, Keep, window_rows
from callcause.profile import Profile


def rach_facts(windows: DataFrame, rach: DataFrame, profile: Profile, keep: Keep = None) -> DataFrame:
    """Which kinds of random-access rows each window holds."""
    c = profile.columns
    reason = is_true(F.col(c.rach_reason) == 0)
    result = is_true(F.col(c.rach_result) == 0)
    slim = windows.select(*profile.event_key, START, END)
    rows = window_rows(slim, rach.select(*profile.keys, c.time, c.rach_reason, c.rach_result), profile, keep=keep)
    return rows.groupBy(*profile.event_key).agg(
        ever(reason & ~result).alias("Rach_Asked"),
        ever(result).alias("Rach_Answered"),
        ever(~reason & ~result).alias("Rach_Other"),
        first_time(reason, c.time).alias("Rach_Time"))


def is_rach_failure() -> Column:
    """Some request, some row that is neither, and no successful result."""
    return F.col("Rach_Asked") & F.col("Rach_Other") & ~F.col("Rach_Answered")


def rach_failure(facts: DataFrame, profile: Profile) -> DataFrame:
    return facts.filter(is_rach_failure()).select(
        *profile.event_key, F.col("Rach_Time").alias(TAG_TIME), F.lit(S.RACH_FAILURE).alias(TAG))
