"""Results kept by day, and renewed for what new rows can change.

A result table lies in folders by the day of the failure. New probe rows can
change the windows of their own series from the failure after the first of them
on; failures of a series are numbered, so all later ones may change as well. A
rerun therefore takes whole series, those with new rows, and rewrites the days
from their first new row on, with the rows of all other series as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from callcause.operators.windows import END
from callcause.plans.diagnosis import ProbeTables, diagnose
from callcause.profile import Profile
from callcause.session import settle
from callcause.sources import sinks

DAY = "Failure_Day"


def _streams(tables: ProbeTables) -> Iterable[DataFrame]:
    return [t for t in (tables.events, tables.measurements, tables.signalling, tables.rach, tables.physical) if t is not None]


def touched_series(new: ProbeTables, profile: Profile) -> DataFrame:
    """Keys of the series with new rows, and the time of the first (null if a new row has none).

    Where rows of other work orders may enter a window, they touch every series of their device.
    """
    keys, time = list(profile.join_keys), profile.columns.time
    first = [t.groupBy(*keys).agg(F.min(time).alias("_first"), F.max(F.col(time).isNull().cast("int")).alias("_timeless"))
             for t in _streams(new)]
    merged = reduce(DataFrame.unionByName, first).groupBy(*keys).agg(F.min("_first").alias("_first"), F.max("_timeless").alias("_timeless"))
    return merged.select(*keys, F.when(F.col("_timeless") == 0, F.col("_first")).alias("_first"))


def of_series(tables: ProbeTables, series: DataFrame, profile: Profile) -> ProbeTables:
    """All probe tables reduced to the given series."""
    names = series.select(*profile.join_keys)

    def kept(rows: DataFrame | None) -> DataFrame | None:
        return None if rows is None else rows.join(names, list(profile.join_keys), "left_semi")

    return ProbeTables(kept(tables.events), kept(tables.measurements), kept(tables.signalling), kept(tables.rach), kept(tables.physical))


def by_day(result: DataFrame) -> DataFrame:
    """The result with the day of the failure, null for failures without a time."""
    return result.withColumn(DAY, F.to_date(END))


def write_days(result: DataFrame, location: str) -> None:
    """Write a result by day; days that it does not hold stay as they are."""
    sinks.write_table(by_day(result), location, partition_by=[DAY], partitionOverwriteMode="dynamic")
    sinks.write_schema(by_day(result), location)


def read_days(spark: SparkSession, location: str) -> DataFrame:
    """A result that lies by day, with the day as a column."""
    return sinks.read_partitioned(spark, location)


def renew_days(tables: ProbeTables, new: ProbeTables, location: str, profile: Profile,
               keep: Callable[[DataFrame], DataFrame] = settle) -> DataFrame:
    """Bring a result by day up to date after rows were added; gives the days that were written anew.

    ``tables`` hold all rows, the new ones included. Only the series with new
    rows are analysed, and only days from the first new row of any of them on are
    read and rewritten: the fresh rows of these series, and the stored rows of
    all others. The folder of a day that no row is left of is removed.
    """
    spark, keys = tables.events.sparkSession, list(profile.join_keys)
    series = keep(touched_series(new, profile))
    fresh = keep(by_day(diagnose(of_series(tables, series, profile), profile, keep)))
    first, timeless, some = series.agg(F.min(F.to_date("_first")), F.max(F.col("_first").isNull().cast("int")), F.count(F.lit(1))).first()
    if not some:
        return fresh.select(DAY).distinct()
    # A failure without a time has no day, so its folder is renewed with all others.
    later = F.lit(True) if timeless or first is None else (F.col(DAY) >= F.lit(first)) | F.col(DAY).isNull()
    stored = read_days(spark, location).filter(later)
    others = stored.join(series.select(*keys), keys, "left_anti")
    renewed = keep(fresh.filter(later).unionByName(others.select(*fresh.columns)))
    renewed_days = keep(renewed.select(DAY).distinct())
    gone = stored.select(DAY).distinct().exceptAll(renewed_days.select(DAY))
    emptied = [row[0] for row in gone.collect()]  # days, so few
    sinks.write_table(renewed, location, partition_by=[DAY], partitionOverwriteMode="dynamic")
    for day in emptied:
        sinks.drop_partition(spark, location, DAY, day)
    return renewed_days
