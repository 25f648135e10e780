"""Perplexity from token log-probabilities, or from an add-one unigram model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunetable.functions.text import truncate, words
from tunetable.operators.sampling import head


def perplexity(nll: DataFrame, text_key: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``exp`` of the unweighted mean over texts of each text's mean token NLL; 1.0 if empty."""
    per_text = nll.groupBy(*by, text_key).agg(F.avg("nll").alias("text_nll"))
    return per_text.groupBy(*by).agg(
        F.count("*").alias("n_texts"),
        F.exp(F.coalesce(F.avg("text_nll"), F.lit(0.0))).alias("perplexity"),
    )


def first_texts(nll: DataFrame, text_key: str, n: int) -> DataFrame:
    """Tokens of the first ``n`` texts in key order."""
    keys = head(nll.select(text_key).distinct(), n, text_key)
    return nll.join(keys, text_key, "left_semi")


def unigram_perplexity(
    docs: DataFrame, text: str = "text", split: str = "split", max_tokens: int | None = None
) -> DataFrame:
    """Perplexity of the ``eval`` texts under an add-one unigram model of the ``train`` texts.

    The mean over texts of the mean token NLL equals a sum over words of (weight in the evaluation
    texts) * NLL(word), so one aggregation by word carries both sides: no join, and a frequent word
    is combined before the shuffle. The vocabulary has one extra slot for unseen words.
    """
    tokens = docs.select(
        (F.col(split) == "train").alias("is_train"), truncate(words(text), max_tokens).alias("t")
    )
    weights = (
        tokens.select(
            "is_train", (F.lit(1.0) / F.size("t")).alias("share"), F.explode("t").alias("word")
        )
        .groupBy("word")
        .agg(
            F.count_if("is_train").alias("c"),
            F.sum(F.when(~F.col("is_train"), F.col("share"))).alias("w"),
        )
    )
    totals = weights.agg(
        F.sum("c").alias("train_tokens"),
        (F.count_if(F.col("c") > 0) + 1).alias("vocabulary"),
        F.sum("w").alias("n_texts"),
        F.sum(F.col("w") * F.log(F.col("c") + 1.0)).alias("known"),
    )
    size = F.log(F.col("train_tokens") + F.col("vocabulary"))
    mean_nll = size - F.col("known") / F.col("n_texts")
    return totals.select(
        "train_tokens",
        "vocabulary",
        F.round("n_texts").cast("long").alias("n_texts"),
        F.when(F.col("n_texts") > 0, F.exp(mean_nll)).otherwise(F.lit(1.0)).alias("perplexity"),
    )
