"""A log that is read while it grows: each micro-batch commits one version, readers see whole versions only.

A version is a manifest: the list of Parquet folders that hold its rows. A micro-batch writes its rows to a
folder of its own and then the manifest, whose appearance commits the version. Rows are written
once; when a version lists COMPACT_AFTER folders, they are rewritten as one. A batch that is replayed after a
failure overwrites its own folder and manifest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tunetable.streaming.runs import each_batch

#: Folders of a version before they are rewritten as one.
COMPACT_AFTER = 8
MANIFEST = "version long, parts array<string>, n_rows long"


def versions(spark: SparkSession, folder: str) -> DataFrame:
    """(``version``, ``parts``, ``n_rows``) of the committed versions; one small row each."""
    return spark.read.schema(MANIFEST).option("recursiveFileLookup", True).json(f"{folder}/manifest")


def read_version(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """The rows of a committed version, the newest unless told."""
    known = versions(spark, folder)
    if version is not None:
        known = known.filter(known["version"] == version)
    row = known.orderBy("version", ascending=False).first()
    if row is None:
        raise ValueError(f"no such version below {folder}: {version}")
    return spark.read.parquet(*row["parts"])


def versioned_log(log: DataFrame, label: str, compact_after: int = COMPACT_AFTER) -> str:
    """Runs a streaming table into versions, one per micro-batch; returns their folder."""

    def commit(batch: DataFrame, batch_id: int, folder: str) -> None:
        spark = batch.sparkSession
        part = f"{folder}/parts/{batch_id}"
        batch.write.mode("overwrite").parquet(part)
        parts, rows = [part], spark.read.parquet(part).count()
        if batch_id:
            before = versions(spark, folder).filter(f"version < {batch_id}")
            before = before.orderBy("version", ascending=False).first()
            parts, rows = [*before["parts"], part], before["n_rows"] + rows
        if len(parts) > compact_after:
            whole = f"{folder}/whole/{batch_id}"
            spark.read.parquet(*parts).write.mode("overwrite").parquet(whole)
            parts = [whole]
        manifest = spark.createDataFrame([(batch_id, parts, rows)], MANIFEST).coalesce(1)
        manifest.write.mode("overwrite").json(f"{folder}/manifest/{batch_id}")

    return each_batch(log, label, "append", commit)
