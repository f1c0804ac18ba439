"""Tables, kept intermediate results and Arrow batches, as all operators here use them."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

# Rows in an Arrow batch, and bytes of text that one numpy step looks at; a longer text is a step of its own.
BATCH_ROWS = 1_000
STEP_BYTES = 1_000_000


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table, with Arrow batches small enough for long texts."""
    small_batches(spark)
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def small_batches(spark: SparkSession) -> None:
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; one of its own only in a local session that names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="callcause-llm-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


class Kept:
    """Frames written to the shared folder: computed once, safe from lost executors, lineage cut.

    ``drop`` deletes the files of frames that nothing reads any more.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def keep(self, df: DataFrame, label: str = "kept", partition: str | None = None) -> DataFrame:
        path = new_path(self.spark, label)
        writer = df.write.partitionBy(partition) if partition else df.write
        writer.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *frames: DataFrame) -> None:
        for frame in frames:
            for path in {name.split("://")[-1] for name in frame.inputFiles()}:
                for kept in self.paths:
                    if kept.split("://")[-1].lstrip("/") in path.lstrip("/"):
                        delete(self.spark, kept)
                        self.paths.remove(kept)
                        break

    def clear(self) -> None:
        """Delete the files of all frames."""
        while self.paths:
            delete(self.spark, self.paths.pop())


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def without(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The frame less the columns whose names the results of an operator take."""
    return df.drop(*[name for name in df.columns if name in set(names)])


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column end to end, and where each row starts and ends; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def steps(offsets: np.ndarray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of one row."""
    low, rows = 0, len(offsets) - 1
    while low < rows:
        high = int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1
        high = min(max(high, low + 1), rows)
        yield low, high
        low = high


def doc_batches(column: pa.Array, limit: int = STEP_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """Bytes and offsets of a string column in steps of about ``limit`` bytes, with the rows of each step."""
    data, offsets = texts(column)
    for low, high in steps(offsets, limit):
        yield data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low], low, high


def lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from its values end to end and the length of each row's list."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def map_batches(df: DataFrame, work: Callable[[pa.RecordBatch], dict[str, pa.Array]],
                fields: Sequence[T.StructField], keep: Sequence[str] | None = None) -> DataFrame:
    """Add columns that ``work`` makes of each Arrow batch, without any shuffle.

    ``keep`` names the input columns that stay (None: all). An input column of
    the same name as a new one gives way to it.
    """
    names = [f.name for f in fields]
    stays = [f for f in df.schema.fields if f.name not in names and (keep is None or f.name in keep)]
    stay_names = [f.name for f in stays]

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                made = work(batch)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(n) for n in stay_names] + [made[n] for n in names], stay_names + names)

    return df.mapInArrow(run, T.StructType([*stays, *fields]))


def text_column(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, F.col(name).cast("string"))


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner find the shuffle files of finished steps: it deletes what the driver no longer refers to."""
    gc.collect()
    spark._jvm.System.gc()
