"""Corpus BLEU: 13a tokens, orders 1 to 4, clipped corpus sums, exponential smoothing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunetable.functions.text import mt13a_tokens, or_empty
from tunetable.operators.rouge import KEYS, Grams, gram_matches

ORDERS = (1, 2, 3, 4)


SCHEME = Grams("mt", "mt_pred", "mt_ref", ORDERS)


def mt_columns() -> list[Column]:
    """The tokens of both sides, joined by spaces; no token holds one."""
    sides = (("prediction", "mt_pred"), ("reference", "mt_ref"))
    return [F.array_join(mt13a_tokens(or_empty(c)), " ").alias(name) for c, name in sides]


def corpus_sums() -> list[Column]:
    """Aggregates over per-pair counts: what corpus BLEU needs."""
    per_order = [F.sum(f"mt_{c}_{n}").alias(f"{c}_{n}") for n in ORDERS for c in ("match", "pred")]
    return [*per_order, F.sum("mt_ref_1").alias("ref_1")]


def bleu_counts(
    pairs: DataFrame,
    keys: tuple[str, ...] = KEYS,
    by: tuple[str, ...] = ("model",),
) -> DataFrame:
    """Corpus sums per group: ``match_n``/``pred_n`` for each order and both lengths; only they are shuffled."""
    texts = pairs.select(*keys, *mt_columns())
    return gram_matches(texts, keys, (SCHEME,)).groupBy(*by).agg(*corpus_sums())


def _precision(n: int) -> Column:
    """Percent precision of order ``n``; the k-th order without a match counts 1/2**k matches."""
    zeros = [(F.col(f"match_{m}") == 0).cast("int") for m in range(1, n + 1)]
    k = reduce(lambda a, b: a + b, zeros)
    smoothed = 100.0 / (F.pow(F.lit(2.0), k) * F.col(f"pred_{n}"))
    return F.when(F.col(f"match_{n}") == 0, smoothed).otherwise(
        100.0 * F.col(f"match_{n}") / F.col(f"pred_{n}")
    )


def bleu_score() -> Column:
    """BLEU (0..100) from corpus sums; 0 without any match or without any 4-gram."""
    sys, ref = F.col("pred_1"), F.col("ref_1")
    penalty = F.when(sys < ref, F.exp(1 - ref / sys)).otherwise(F.lit(1.0))
    logs = reduce(lambda a, b: a + b, [F.log(_precision(n)) for n in ORDERS])
    any_match = F.greatest(*[F.col(f"match_{n}") for n in ORDERS]) > 0
    enough = any_match & (F.col(f"pred_{ORDERS[-1]}") > 0)
    return F.when(enough, penalty * F.exp(logs / len(ORDERS))).otherwise(F.lit(0.0))


def corpus_bleu(counts: DataFrame, by: tuple[str, ...] = ("model",)) -> DataFrame:
    lengths = [F.col("pred_1").alias("sys_len"), F.col("ref_1").alias("ref_len")]
    return counts.select(*by, *lengths, bleu_score().alias("bleu"))
