"""A store of probe tables that lies by device group, so that a choice of devices reads only their groups.

The files of a group are sorted by series and time: statistics of their row
groups prune further by device and time.
"""

from __future__ import annotations

from dataclasses import fields, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from callcause.plans.diagnosis import ProbeTables
from callcause.profile import Profile
from callcause.sources import sinks

GROUP = "Device_Group"


def device_group(device: Column, groups: int) -> Column:
    """The group of a device; the same for whole numbers of any width. A missing device has group 0."""
    return F.coalesce(F.pmod(F.xxhash64(device.cast("long")), F.lit(groups)), F.lit(0)).cast("int")


def write_store(tables: ProbeTables, folder: str, profile: Profile, groups: int = 256) -> None:
    """Write each table below the folder by device group; a group that is too large for a task is written by several."""
    device, order = profile.columns.device, [*profile.keys, profile.columns.time]
    for field in fields(tables):
        rows = getattr(tables, field.name)
        if rows is not None:
            dealt = rows.withColumn(GROUP, device_group(F.col(device), groups)).hint("rebalance", GROUP)
            dealt.sortWithinPartitions(GROUP, *order).write.mode("overwrite").partitionBy(GROUP).parquet(f"{folder}/{field.name}")
            sinks.write_schema(rows.withColumn(GROUP, F.lit(0)), f"{folder}/{field.name}")


def open_store(spark: SparkSession, folder: str, version: str = "v2") -> ProbeTables:
    """The stored tables, each with the group of its devices; v1 has no use for the block-error table."""
    names = [f.name for f in fields(ProbeTables) if version == "v2" or f.name != "physical"]
    return ProbeTables(**{name: sinks.read_partitioned(spark, f"{folder}/{name}") for name in names})


def stored_devices(tables: ProbeTables, chosen: DataFrame, profile: Profile, groups: int = 256) -> ProbeTables:
    """The stored tables reduced to the chosen devices.

    The join has the group among its keys, so Spark prunes folders by the groups
    that the choice turns out to have, as long as it can broadcast the choice;
    beyond that it is an ordinary join.
    """
    device = profile.columns.device
    place = chosen.select(F.col("Device").alias(device)).distinct().withColumn(GROUP, device_group(F.col(device), groups))

    def kept(rows: DataFrame | None) -> DataFrame | None:
        return None if rows is None else rows.join(place, [GROUP, device], "left_semi").drop(GROUP)

    return replace(tables, **{f.name: kept(getattr(tables, f.name)) for f in fields(tables)})
