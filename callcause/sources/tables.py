"""Reading the probe tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from callcause import schemas as S
from callcause.plans.diagnosis import ProbeTables


def read_table(spark: SparkSession, location: str, columns: Sequence[str],
               source: str = "parquet", more: Sequence[str] = (), **options) -> DataFrame:
    """The named columns of a table, and those of ``more`` that it has.

    Rows come unordered; operators order what they need. Times without a zone
    are taken in the session's zone. A database table is named by ``location``,
    and the options tell where it is.
    """
    if source == "table":
        frame = spark.read.table(location)
    elif source == "jdbc":
        frame = spark.read.format(source).options(dbtable=location, **options).load()
    else:
        frame = spark.read.format(source).options(**options).load(location)
    extra = [name for name in more if name in frame.columns and name not in columns]
    return with_zone(frame.select(*columns, *extra))


def with_zone(df: DataFrame) -> DataFrame:
    """Times without a zone as timestamps of the session's zone."""
    naive = [f.name for f in df.schema if isinstance(f.dataType, T.TimestampNTZType)]
    return df.withColumns({name: F.col(name).cast("timestamp") for name in naive})


def read_jdbc(spark: SparkSession, url: str, table: str, columns: Sequence[str],
              lower: datetime, upper: datetime, partitions: int, time: str = "Time",
              **properties: str) -> DataFrame:
    """The named columns of a database table, read in parallel by ranges of the time column.

    The bounds only cut the ranges: rows outside fall into the first or last one.
    """
    return spark.read.jdbc(
        url, table, column=time, lowerBound=str(lower), upperBound=str(upper),
        numPartitions=partitions, properties=properties).select(*columns)


def find_devices(devices: DataFrame, service: str, service_column: str = "ServiceName",
                 device_column: str = "Device", first_only: bool = False) -> DataFrame:
    """Devices that run a service; ``first_only`` takes the smallest id of them."""
    found = devices.filter(F.col(service_column) == service)
    if first_only:
        return found.agg(F.min(device_column).alias("Device")).filter(F.col("Device").isNotNull())
    return found.select(F.col(device_column).alias("Device")).distinct()


def only_devices(rows: DataFrame, devices: DataFrame, device: str = "Device") -> DataFrame:
    """Rows of the given devices."""
    return rows.join(devices.select(F.col("Device").alias(device)).distinct(), device, "left_semi")


def of_devices(tables: ProbeTables, devices: DataFrame, device: str = "Device") -> ProbeTables:
    """All probe tables reduced to the given devices."""
    def kept(rows: DataFrame | None) -> DataFrame | None:
        return None if rows is None else only_devices(rows, devices, device)

    return ProbeTables(kept(tables.events), kept(tables.measurements), kept(tables.signalling),
                       kept(tables.rach), kept(tables.physical))


def place_of(folder: str, name: str, source: str) -> str:
    """Where a table of a set is: a file below the folder, or a name in the folder's database."""
    if source in ("table", "jdbc"):
        return f"{folder}.{name}" if folder else name
    return f"{folder.rstrip('/')}/{name}"


def read_probe_tables(spark: SparkSession, folder: str, source: str = "parquet", version: str = "v2",
                      tie: Sequence[str] = ("MsgId",), options: Mapping[str, str] | None = None) -> ProbeTables:
    """Probe tables stored under their usual names in one folder or database.

    Tie columns come along from the tables that have them. v1 has no use for the
    block-error table and does not read it.
    """
    def table(name: str, columns: Sequence[str]) -> DataFrame:
        return read_table(spark, place_of(folder, name, source), columns, source, tie, **(options or {}))

    return ProbeTables(
        events=table("Event_NR", S.EVENT_COLUMNS),
        measurements=table("MEAS_NR", S.MEASUREMENT_COLUMNS),
        signalling=table("Signalling", S.SIGNALLING_COLUMNS),
        rach=table("RACH_NR", S.RACH_COLUMNS),
        physical=table("PHYDL_NR", S.PHYSICAL_COLUMNS) if version == "v2" else None,
    )
