"""Shaping and writing results, straight from the executors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

# Text patterns of the two versions.
MICROSECOND_TEXT = "yyyy-MM-dd HH:mm:ss.SSSSSS"
DATE_TEXT = "yyyy-MM-dd"


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of the schema in its order and types; a missing column is null."""
    return df.select(*[
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema])


def times_as_text(df: DataFrame, pattern: str = MICROSECOND_TEXT,
                  columns: Sequence[str] | None = None) -> DataFrame:
    """Timestamps as text; all timestamp columns unless some are named."""
    if columns is None:
        columns = [f.name for f in df.schema if isinstance(f.dataType, T.TimestampType)]
    return df.withColumns({name: F.date_format(name, pattern) for name in columns})


def nan_to_null(df: DataFrame) -> DataFrame:
    """Replace NaN by null in all floating-point columns."""
    floating = (T.DoubleType, T.FloatType)
    return df.withColumns({
        f.name: F.when(~F.isnan(f.name), F.col(f.name))
        for f in df.schema if isinstance(f.dataType, floating)})


def output_projection(df: DataFrame, schema: T.StructType, pattern: str | None = None) -> DataFrame:
    """The result as it is stored: fixed schema, no NaN, times as text when a pattern is given."""
    shaped = nan_to_null(conform(df, schema))
    return times_as_text(shaped, pattern) if pattern else shaped


def write_table(df: DataFrame, location: str, target: str = "parquet", mode: str = "overwrite",
                partition_by: Sequence[str] = (), **options) -> None:
    """Write to files, or to a catalog table with ``target="table"``."""
    writer = df.write.mode(mode).options(**options)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if target == "table":
        writer.saveAsTable(location)
    elif target == "jdbc":
        writer.format(target).option("dbtable", location).save()
    else:
        writer.format(target).save(location)


def write_schema(df: DataFrame, location: str) -> None:
    """Keep the schema beside files that lie by a column: without rows there are none to tell it."""
    df.limit(0).coalesce(1).write.mode("overwrite").parquet(f"{location}/_schema")


def read_partitioned(spark: SparkSession, location: str) -> DataFrame:
    """A table that lies by a column, with or without rows."""
    return spark.read.schema(spark.read.parquet(f"{location}/_schema").schema).parquet(location)


def drop_partition(spark: SparkSession, location: str, column: str, value) -> None:
    """Remove one folder of files that lie by a column."""
    name = "__HIVE_DEFAULT_PARTITION__" if value is None else str(value)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{location.rstrip('/')}/{column}={name}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "overwrite", **properties: str) -> None:
    df.write.jdbc(url, table, mode=mode, properties=properties)


def write_csv(df: DataFrame, location: str, mode: str = "overwrite") -> None:
    """CSV files with a header line."""
    write_table(df, location, "csv", mode, header=True)


def preview(df: DataFrame, rows: int = 20) -> None:
    df.show(rows, truncate=False)
