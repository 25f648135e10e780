"""Readers: one table or split, several splits, logs and metric documents."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tunetable.functions.formats import is_flagged
from tunetable.operators.telemetry import typed_log
from tunetable.sources.schemas import INSTRUCTIONS, LOSS_LOG_TEXT, METRICS_DOCUMENT


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether Spark finds the path, on whatever file system it is; nothing is read."""
    try:
        spark.read.text(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


def first_available(spark: SparkSession, paths: list[str]) -> str:
    for path in paths:
        if path_exists(spark, path):
            return path
    raise FileNotFoundError(f"none of these paths exists: {paths}")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_jsonl(
    spark: SparkSession,
    path: str | list[str],
    schema: StructType | str = INSTRUCTIONS,
    strict: bool = True,
) -> DataFrame:
    """JSON lines with a fixed schema; with ``strict`` a malformed line is an error."""
    mode = "FAILFAST" if strict else "DROPMALFORMED"
    return spark.read.schema(schema).option("mode", mode).json(path)


def read_splits(
    spark: SparkSession, files: dict[str, str], schema: StructType = INSTRUCTIONS
) -> DataFrame:
    """Named JSONL files as one table with a ``split`` column."""
    parts = [
        read_jsonl(spark, path, schema).withColumn("split", F.lit(name))
        for name, path in files.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """A folder written with ``split=`` subfolders; a filter on ``split`` prunes files."""
    return spark.read.parquet(path)


def read_loss_log(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """The first existing CSV log, typed leniently. Fails if there is none."""
    path = first_available(spark, [paths] if isinstance(paths, str) else paths)
    return typed_log(spark.read.option("header", True).schema(LOSS_LOG_TEXT).csv(path))


def read_metrics_document(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """The first existing metrics document: one nested row."""
    path = first_available(spark, [paths] if isinstance(paths, str) else paths)
    return spark.read.schema(METRICS_DOCUMENT).option("multiLine", True).json(path)


def metric_records(document: DataFrame) -> DataFrame:
    """Records of a metrics document with their position and the note flag."""
    return document.select(
        "eval_samples",
        is_flagged("note").alias("has_note"),
        F.posexplode("results").alias("position", "r"),
    ).select("position", "r.*", "eval_samples", "has_note")


def union_available(
    spark: SparkSession, files: dict[str, str], schema: StructType | str = INSTRUCTIONS
) -> tuple[DataFrame, list[str]]:
    """Rows of the inputs that exist (labelled ``model``) and the labels of those that do not."""
    found = {k: p for k, p in files.items() if path_exists(spark, p)}
    missing = [k for k in files if k not in found]
    if not found:
        raise FileNotFoundError(f"none of these inputs exists: {files}")
    parts = [
        read_jsonl(spark, p, schema).withColumn("model", F.lit(k)) for k, p in found.items()
    ]
    return reduce(DataFrame.unionByName, parts), missing
