"""Writers: JSON lines, published splits, metric documents, CSV logs, review reports.

All of them write folders of part files in parallel; only the metrics document, which has one row,
is a single file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunetable.sources.schemas import LOSS_LOG_TEXT

LOG_COLUMNS = tuple(LOSS_LOG_TEXT.fieldNames())


def write_jsonl(df: DataFrame, path: str, by_split: bool = True, mode: str = "errorifexists") -> str:
    """JSON lines with all keys present and non-ASCII text unescaped."""
    writer = df.write.mode(mode).option("ignoreNullFields", "false")
    (writer.partitionBy("split") if by_split else writer).json(path)
    return path


def publish_splits(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """Train and eval together as Parquet with one subfolder per split."""
    df.write.mode(mode).partitionBy("split").parquet(path)
    return path


def write_document(document: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """A one-row document as JSON text."""
    fields = F.struct(*document.columns)
    text = F.to_json(fields, {"ignoreNullFields": "false", "pretty": "true"})
    document.select(text.alias("value")).write.mode(mode).text(path)
    return path


def append_log(log: DataFrame, path: str) -> str:
    """Appends rows to a CSV folder; every part file starts with the header line."""
    columns = [F.col(c) if c in log.columns else F.lit(None).cast("string").alias(c) for c in LOG_COLUMNS]
    log.select(*columns).write.mode("append").option("header", True).csv(path)
    return path


def write_review(report: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """Markdown blocks in number order across the part files."""
    ordered = report.repartitionByRange("number").sortWithinPartitions("number")
    # The text writer ends every row with a line break, so the block's own last one is left out.
    lines = F.substr("block", F.lit(1), F.length("block") - 1)
    ordered.select(lines.alias("value")).write.mode(mode).text(path)
    return path
