"""Pairing predictions with references and models with each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def align(preds: DataFrame, refs: DataFrame, key: list[str]) -> DataFrame:
    """Every prediction with the reference of the same key, null where there is none.

    References are reduced to one per key first, so repeated keys cannot multiply rows; the join
    reuses the partitioning of that reduction.
    """
    one = refs.groupBy(*key).agg(F.min("reference").alias("reference"))
    return preds.join(one, key, "left")


def alignment_counts(aligned: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return aligned.groupBy(*by).agg(
        F.count("*").alias("n_predictions"),
        F.count("reference").alias("n_matched"),
        (F.count("*") - F.count("reference")).alias("n_unmatched"),
    )


def unmatched_references(preds: DataFrame, refs: DataFrame, key: list[str]) -> DataFrame:
    """The references whose key no prediction has, one row per key."""
    return refs.select(*key).distinct().join(preds.select(*key), key, "left_anti")


def side_by_side(
    results: DataFrame,
    key: str,
    models: tuple[str, ...],
    value: str = "prediction",
    order: Column | None = None,
) -> DataFrame:
    """One row per key with one column per model, null where a model has no answer.

    The first answer in ``order`` wins; grouping instead of joining keeps repeated keys from
    producing all combinations.
    """
    rank = F.lit(0) if order is None else order
    first = [
        F.min(F.when(F.col("model") == m, F.struct(rank.alias("o"), F.col(value).alias("v"))))
        .getField("v")
        .alias(m)
        for m in models
    ]
    return results.groupBy(key).agg(*first)
