"""Live training-loss log: events are typed, rounded and appended; minima are kept per run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunetable.operators.telemetry import log_rows, loss_minimum, typed_log
from tunetable.streaming.runs import append_to_files, each_batch, overwrite_batch


def live_log(raw: DataFrame) -> DataFrame:
    """Works on streaming and batch input alike."""
    return log_rows(typed_log(raw))


def append_live_log(raw: DataFrame) -> DataFrame:
    """Runs the log as a stream into CSV files and reads them back."""
    spark = raw.sparkSession
    log = live_log(raw)
    out = append_to_files(log, "loss-log", "csv", {"header": "true"})
    return spark.read.schema(log.schema).option("header", True).csv(out)


def running_minimum(raw: DataFrame, by: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """Minimum per run over all micro-batches, from one small partial result per batch."""
    spark = raw.sparkSession

    def partial(batch: DataFrame, batch_id: int, folder: str) -> None:
        overwrite_batch(loss_minimum(batch, by), batch_id, folder)

    partials = spark.read.parquet(each_batch(live_log(raw), "loss-minimum", "append", partial))
    return (
        partials.groupBy(*by)
        .agg(F.min(F.struct("min_loss", "min_step")).alias("m"), F.sum("n_points").alias("n_points"))
        .select(*by, "m.min_loss", "m.min_step", "n_points")
    )
