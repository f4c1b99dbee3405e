"""Shared storage and text-batch helpers of the llm operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bytes of text that a kernel handles at once, so that its arrays stay small whatever the batch holds.
CHUNK_BYTES = 2 << 20
#: Rows of the offsets of a range sort (one for each range and group within it) up to which they are broadcast.
OFFSET_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or, where that is unset (tests), a new local one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jvm = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = jvm.get() if jvm.isDefined() else tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def replaced(df: DataFrame, name: str, last: str | None = None) -> tuple[DataFrame, str]:
    """``stored``, and its path; the table of the round before (``last``), which nothing reads then, is deleted."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if last:
        folder = spark._jvm.org.apache.hadoop.fs.Path(last)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    return spark.read.schema(df.schema).parquet(path), path


def fresh(name: str, *taken: list[str]) -> str:
    """``name``, with as many marks added as it takes to be none of the taken column names (which ignore case)."""
    used = {c.lower() for names in taken for c in names}
    while name.lower() in used:
        name += "_"
    return name


def measured(df: DataFrame, name: str, most: int) -> tuple[DataFrame, bool]:
    """``df`` as a stored table, and whether it has at most ``most`` rows and so may be broadcast; then it carries that hint."""
    df = stored(df, name)
    small = df.count() <= most
    return (F.broadcast(df) if small else df), small


def numbered(rows: DataFrame, group: str, order: Sequence[str], name: str) -> DataFrame:
    """``rows`` with at (from 0 in the group, by ``order``) and count (rows of the group), by one range sort.

    Ranges are cut by group and order, so a large group is spread over many; only counts of ranges are summed up.
    """
    sorted_rows = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("_spot", F.monotonically_increasing_id())
    ranged = stored(sorted_rows, name).withColumn("_range", F.shiftright("_spot", 33))
    parts = ranged.groupBy(group, "_range").agg(F.count("*").alias("_n"), F.min("_spot").alias("_first"))
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(group, "_range", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(group)).alias("count"))
    offsets, _ = measured(offsets, f"{name}_offsets", OFFSET_ROWS)
    return ranged.join(offsets, [group, "_range"]).withColumn("at", F.col("_before") + F.col("_spot") - F.col("_first")).drop("_range", "_spot", "_first", "_before")


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Split a string column into runs of rows of about ``limit`` bytes: (first row, UTF-8 bytes, row offsets). Null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, raw_offsets, raw = column.buffers()
    offsets = np.frombuffer(raw_offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(len(column), max(last, first + 1))
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def text_slices(batch: pa.RecordBatch, column: int, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of which the strings of a column have about ``limit`` bytes each."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    first = 0
    while first < len(sizes):
        before = int(ends[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(first, last - first)
        first = last
