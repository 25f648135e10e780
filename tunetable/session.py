"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
BATCH_ROWS_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 2000


def local_session(cores: int | str = "*", app: str = "tunetable") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


_shipped: set[str] = set()


def bound_batches(spark: SparkSession) -> None:
    """Whole texts go to the Python workers BATCH_ROWS at a time, unless the session says otherwise.

    A batch is held several times over, in the executor and in its worker, beside what former batches left.
    """
    if spark.conf.get(BATCH_ROWS_KEY, None) is None:
        spark.conf.set(BATCH_ROWS_KEY, str(BATCH_ROWS))


def ship_package(spark: SparkSession) -> None:
    """Makes this package importable in the Python workers of all executors, once per application."""
    bound_batches(spark)
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    archive = os.path.join(tempfile.mkdtemp(prefix="tunetable-code-"), "tunetable-code.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder for checkpoints and intermediate tables.

    Only a local session may fall back to a temporary folder of its own machine.
    """
    configured = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(
        CHECKPOINT_KEY
    )
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
    fallback = tempfile.mkdtemp(prefix="tunetable-")
    spark.conf.set(CHECKPOINT_KEY, fallback)
    return fallback


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; nothing is created."""
    return os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")


def written(df: DataFrame, label: str) -> DataFrame:
    """The same rows, stored once in the shared folder and read back from there."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
