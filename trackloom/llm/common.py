"""Helpers that the operators of this package share: tables in the shared folder, row keys, byte chunks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task turns into numpy arrays at once. A longer document makes a chunk of its own.
CHUNK_BYTES = 2_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, a session on one machine (tests) gets a temporary one; on a cluster that is an error, as its
    machines would each write to their own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        found = tempfile.mkdtemp(prefix="trackloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Spark's setting that deletes an execution's shuffle files as soon as it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: lineage ends here, lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")  # for this write alone, whose plan nothing runs again
    try:
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before or "false")
    spark._jvm.System.gc()  # other executions' shuffle files go once the driver has collected their plans
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete a table that stored() wrote and that nothing will read again."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stored_at)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, max_rows: int, max_bytes: int) -> bool:
    """Whether df surely is below both bounds; counts it, and takes its values' text length as their size."""
    size = sum((F.coalesce(F.length(F.col(f"`{c}`").cast("string")), F.lit(4)) for c in df.columns), F.lit(0))
    n, b = df.select(F.count(F.lit(1)), F.coalesce(F.sum(4 * size + 16), F.lit(0))).first()
    return n <= max_rows and b <= max_bytes


def row_key(doc_id: Column, text: Column) -> list[Column]:
    """(doc_id, h): h tells apart rows that repeat a doc_id with another text."""
    return [doc_id.alias("doc_id"), F.hash(text).alias("h")]


def same_row(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & a["h"].eqNullSafe(b["h"])


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type):
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    else:
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most so many bytes together, one row at least."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1
        end = min(max(end, row + 1), rows)
        yield row, end
        row = end


def arrow_batches(columns: dict[str, np.ndarray], schema: pa.Schema, most: int = 200_000) -> Iterator[pa.RecordBatch]:
    n = len(next(iter(columns.values())))
    for at in range(0, n, most):
        yield pa.RecordBatch.from_arrays([pa.array(columns[f.name][at : at + most], f.type) for f in schema], schema=schema)
