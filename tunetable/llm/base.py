"""What the operators of this subpackage share: keys of rows, sizes, size-checked joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tunetable.session import written

#: A joined side is broadcast up to this many bytes of its Parquet files, else shuffled; in memory it takes
#: about ten times as much.
BROADCAST_BYTES = 2 << 20
#: Text bytes per bucket of work.
BUCKET_BYTES = 16 << 20

ROW_KEY = ("k_id", "k_tie")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tie(docs: DataFrame) -> Column:
    ids = docs.select(F.col("doc_id").cast("long").alias("k_id"))
    repeated = ids.groupBy("k_id").count().filter("count > 1 or k_id is null")
    return F.lit(0).cast("long") if repeated.isEmpty() else F.xxhash64("text")


def keyed_rows(docs: DataFrame, *columns: str, whole: bool = False) -> DataFrame:
    """(k_id, k_tie, [row,] columns): rows with a null-safe key; `row` holds all columns of `docs`.

    `k_tie` is 0 where all doc_id are different and none is null, otherwise a hash of the text, so
    that different rows with the same doc_id stay apart. Rows equal in both are one document. A null
    doc_id counts as the smallest.
    """
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("k_id"),
        _tie(docs).alias("k_tie"),
        *([F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if whole else []),
        *columns,
    )


def keyed_texts(docs: DataFrame) -> DataFrame:
    """(k_id, k_tie, body): the row key of `keyed_rows` and the bytes of the text."""
    rows = keyed_rows(docs, "text")
    return rows.select(*ROW_KEY, F.col("text").cast("binary").alias("body"))


def with_text(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of `docs` out of `row`, with `text` from the column beside it."""
    return rows.select(
        *(F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns)
    )


def doc_id_of(key: str = "k_id") -> Column:
    """The doc_id that a row key stands for."""
    return F.when(F.col(key) != -(1 << 63), F.col(key))


def bucket_count(texts: DataFrame, column: str = "body") -> int:
    """Buckets of about BUCKET_BYTES of text."""
    size = texts.agg(F.sum(F.octet_length(column))).first()[0] or 0
    return 1 + size // BUCKET_BYTES


def stored_bytes(df: DataFrame) -> int:
    """Bytes of a stored table, as the optimizer knows them from its files."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def checked(small: DataFrame, label: str) -> DataFrame:
    """The rows, stored; with a broadcast hint only if the files are at most BROADCAST_BYTES."""
    stored = written(small, label)
    return F.broadcast(stored) if stored_bytes(stored) <= BROADCAST_BYTES else stored


def beside(rows: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """Joins keyed rows with something found for a share of them.

    What is found grows with the rows, so both sides are shuffled at every size; the row key is unique
    but for repeated rows, so there is no hot key.
    """
    return rows.join(found.hint("merge"), list(ROW_KEY), how)
