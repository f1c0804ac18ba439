"""Where and how jobs keep frames that several branches read."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` (or the context's checkpoint folder) names; never one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return folder.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def _stored(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settle(df: DataFrame) -> DataFrame:
    """Compute a frame once and read it back from the shared folder.

    Lost executors cannot take it, its lineage ends here, and every reader
    fetches only the columns it needs. Unlike an eager checkpoint it costs one
    run of the plan, not two. The files stay; see ``workspace``.
    """
    return _stored(df, new_path(df.sparkSession, "settled"))


@contextmanager
def workspace(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A ``keep`` function like ``settle`` whose files go when the block ends; write the result inside it."""
    folder = new_path(spark, "run")
    try:
        yield lambda df: _stored(df, f"{folder}/{uuid.uuid4().hex}")
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
