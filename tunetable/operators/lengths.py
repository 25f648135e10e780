"""Word counts, token truncation and length statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunetable.functions.text import truncate, word_count, words

# Token limits of the evaluation and of the training job.
EVAL_MAX_TOKENS = 512
TRAIN_MAX_TOKENS = 1024


def truncation_stats(
    df: DataFrame,
    text: str,
    limits: tuple[int, ...] = (EVAL_MAX_TOKENS, TRAIN_MAX_TOKENS),
    by: tuple[str, ...] = (),
) -> DataFrame:
    """What token limits remove: truncated texts and kept/total tokens per group and ``limit``.

    Every text is read and counted once, for all limits.
    """
    limit = F.explode(F.array(*[F.lit(n) for n in limits])).alias("limit")
    counted = df.select(*by, word_count(text).alias("n"), limit)
    return counted.groupBy(*by, "limit").agg(
        F.count("*").alias("n_texts"),
        F.count_if(F.col("n") > F.col("limit")).alias("n_truncated"),
        F.sum("n").alias("total_tokens"),
        F.sum(F.least("n", "limit")).alias("kept_tokens"),
        F.max("n").alias("max_tokens"),
    )


def truncate_texts(df: DataFrame, text: str, max_tokens: int | None) -> DataFrame:
    """Adds ``tokens``, the possibly shortened word list, and whether it is shorter than the text."""
    cut = df.withColumn("_words", words(text))
    kept = truncate(F.col("_words"), max_tokens)
    return cut.withColumn("tokens", kept).withColumn(
        "truncated", F.size("tokens") < F.size("_words")
    ).drop("_words")


def mean_length(preds: DataFrame, by: tuple[str, ...] = ("model",)) -> DataFrame:
    """Mean response length in words."""
    return preds.groupBy(*by).agg(F.avg(word_count("prediction")).alias("avg_response_length"))
