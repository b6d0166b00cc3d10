"""Tables in the shared folder, and settings of a run."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlake.session import configure, cut_lineage, shared_folder


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    if spark.conf.get(_BATCH, None) is None:  # long texts fill a batch long before its rows do
        spark.conf.set(_BATCH, "4MB")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new place below the folder that all executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder once and read again.

    What reads it neither repeats the work nor depends on an executor's disk.
    The table stays until ``discard``: a frame that reads it may be used late.
    """
    return cut_lineage(df, name)


def discard(df: DataFrame) -> None:
    """Delete a stored table that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def parts(df: DataFrame) -> int:
    """How many partitions the session shuffles into."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def batches(rows: pa.RecordBatch, column: str, limit: int = 1 << 19) -> Iterator[tuple[int, list[bytes]]]:
    """UTF-8 texts of a batch in runs of about ``limit`` bytes, each with the place of its first row. Null is empty."""
    texts = rows.column(column).cast(pa.binary()).to_pylist()
    start = size = 0
    for i, text in enumerate(texts):
        texts[i] = text or b""
        size += len(texts[i])
        if size >= limit:
            yield start, texts[start:i + 1]
            start, size = i + 1, 0
    if start < len(texts):
        yield start, texts[start:]


def groups(got: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows of equal integer keys, of batches in which these are adjacent, as one table each."""
    held = None
    for batch in got:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        values = np.stack([held[k].to_numpy() for k in keys], 1)
        edges = [0, *(np.flatnonzero((values[1:] != values[:-1]).any(1)) + 1).tolist()]
        for start, end in zip(edges, edges[1:], strict=False):
            yield held.slice(start, end - start)
        held = held.slice(edges[-1])
    if held is not None and len(held):
        yield held
