"""File streams and their runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from tunetable.session import scratch_path

#: Rows per file of a batch, and the rows that a file of the smallest batch has at least.
SLICE_ROWS = 1 << 20
LEAST_ROWS = 1 << 10


def file_stream(
    spark: SparkSession,
    folder: str,
    schema: StructType,
    pattern: str | None = None,
    fmt: str = "parquet",
    max_files: int | None = None,
) -> DataFrame:
    """Streaming read of a folder; ``max_files`` bounds the size of one micro-batch."""
    reader = spark.readStream.format(fmt).schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(folder)


def slices(df: DataFrame, order: str, label: str, count: int = 3) -> tuple[str, int]:
    """Writes a table as ``count`` batches of files, in the order of a numeric column.

    Returns the folder and the files of a batch: a stream that takes so many files at a time sees
    the batches one after another. Files hold about SLICE_ROWS rows, so that writing and reading spread over more
    tasks as the table grows; every batch has as many, and no file is empty unless a batch has next to no rows.
    """
    spark = df.sparkSession
    out = scratch_path(spark, label)
    ends = df.agg(F.min(order).alias("low"), F.max(order).alias("high"), F.count("*").alias("n")).first()
    step = ((ends["high"] or 0) - (ends["low"] or 0)) // count + 1
    number = F.coalesce(F.floor((F.col(order) - F.lit(ends["low"] or 0)) / step), F.lit(0))
    parts = -(-ends["n"] // (count * SLICE_ROWS))
    if parts > 2:
        rows = [r["count"] for r in df.groupBy(number.alias("_slice")).count().collect()]
        parts = min(parts, min(rows) // LEAST_ROWS if len(rows) == count else 2)
    parts = max(2, parts)
    for i in range(count):
        df.filter(number == i).repartition(parts).write.mode("append").parquet(out)
    return out, parts


def run_available(writer: DataStreamWriter, checkpoint: str) -> None:
    """Processes everything that is there now, then stops."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def append_to_files(
    df: DataFrame, label: str, fmt: str = "parquet", options: dict[str, str] | None = None
) -> str:
    """Runs an append query into a fresh shared folder and returns the folder."""
    spark = df.sparkSession
    out = scratch_path(spark, label)
    writer = df.writeStream.format(fmt).outputMode("append").options(**(options or {}))
    run_available(writer.option("path", out), scratch_path(spark, f"{label}-checkpoint"))
    return out


def each_batch(df: DataFrame, label: str, mode: str, handle: Callable[[DataFrame, int, str], None]) -> str:
    """Runs ``handle(batch, batch_id, folder)`` per micro-batch.

    A batch may be replayed after a failure, so handlers overwrite a subfolder named by its id.
    """
    spark = df.sparkSession
    out = scratch_path(spark, label)
    writer = df.writeStream.outputMode(mode).foreachBatch(lambda b, i: handle(b, i, out))
    run_available(writer, scratch_path(spark, f"{label}-checkpoint"))
    return out


def overwrite_batch(batch: DataFrame, batch_id: int, folder: str) -> None:
    batch.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")
