"""ROUGE-1/2/L per prediction and per model.

Grams are counted and matched row by row, where a pair is: a gram never becomes a row, so nothing is sorted, spilled
or shuffled for it. What leaves a pair is three numbers per order.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tunetable.functions.stemmer import stem_text
from tunetable.functions.text import alnum_tokens, joined_tokens, or_empty

KEYS = ("model", "sample_id")


@dataclass(frozen=True)
class Grams:
    """Columns of space-joined tokens of a pair whose n-grams are matched; ``name`` prefixes the result columns."""

    name: str
    pred: str
    ref: str
    orders: tuple[int, ...]


def placed(scores: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """One key's rows in one partition, for what is joined or grouped by key afterwards.

    Only the numbers of a pair are moved, so place them after the Python functions that read the texts. The
    number of partitions is left to adaptive execution.
    """
    return scores.repartition(*keys)


def overlap(pred: str, ref: str, orders: tuple[int, ...]) -> list[int]:
    """Per order the clipped multiset matches and the n-grams of each side; tokens are split at spaces."""
    a, b = (t.split(" ") if t else [] for t in (pred, ref))
    out = []
    for n in orders:
        x, y = (Counter(zip(*(t[k:] for k in range(n)))) for t in (a, b))
        match = sum(min(c, y[gram]) for gram, c in x.items() if gram in y)
        out += [match, max(len(a) - n + 1, 0), max(len(b) - n + 1, 0)]
    return out


def _overlaps(orders: tuple[int, ...]) -> Callable[[str, str], Column]:
    names = [f"{kind}_{n}" for n in orders for kind in ("match", "pred", "ref")]

    @F.pandas_udf(", ".join(f"{name} long" for name in names))
    def counts(pred: pd.Series, ref: pd.Series) -> pd.DataFrame:
        rows = [overlap(p, r, orders) for p, r in zip(pred, ref)]
        return pd.DataFrame(rows, columns=names, dtype="int64")

    return counts


def gram_matches(
    texts: DataFrame, keys: tuple[str, ...], schemes: tuple[Grams, ...], carry: tuple[str, ...] = ()
) -> DataFrame:
    """Keys and, per scheme and order, ``<name>_match_n``, ``<name>_pred_n``, ``<name>_ref_n``.

    Matches are clipped multiset matches. All schemes and orders come out of one pass; ``carry``
    names further columns of the pair to keep. Every row is a pair of its own, also with equal keys.
    """
    counted = texts.select(
        *keys, *carry, *[_overlaps(g.orders)(g.pred, g.ref).alias(f"_{g.name}") for g in schemes]
    )
    fields = [
        F.col(f"_{g.name}.{kind}_{n}").alias(f"{g.name}_{kind}_{n}")
        for g in schemes
        for n in g.orders
        for kind in ("match", "pred", "ref")
    ]
    return counted.select(*keys, *carry, *fields)


def f_measure(match: Column, n_pred: Column, n_ref: Column) -> Column:
    precision = match / F.greatest(n_pred, F.lit(1))
    recall = match / F.greatest(n_ref, F.lit(1))
    total = precision + recall
    return F.when(total > 0, 2 * precision * recall / total).otherwise(F.lit(0.0))


def lcs_length(a: list[str], b: list[str]) -> int:
    """Longest common subsequence, one machine-word-parallel update per token of ``b``.

    Bits of ``row`` that turned 0 mark where the dynamic-programming row increases (Crochemore et
    al. 2001, Hyyro 2004); Python integers are the bit vectors.
    """
    where: dict[str, int] = {}
    for i, token in enumerate(a):
        where[token] = where.get(token, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for token in b:
        hits = row & where.get(token, 0)
        if hits:
            row = ((row + hits) | (row - hits)) & full
    return len(a) - row.bit_count()


@F.pandas_udf(T.IntegerType())
def _lcs(pred: pd.Series, ref: pd.Series) -> pd.Series:
    return pd.Series([lcs_length(p.split(), r.split()) for p, r in zip(pred, ref)], dtype="int32")


def normalized(pairs: DataFrame, keep: tuple[str, ...], use_stemmer: bool) -> DataFrame:
    """``keep`` with ``pred`` and ``ref``: the tokens of the overlap scores, joined by spaces."""
    texts = pairs.select(
        *keep,
        F.array_join(alnum_tokens(or_empty("prediction")), " ").alias("pred"),
        F.array_join(alnum_tokens(or_empty("reference")), " ").alias("ref"),
    )
    return texts.withColumns({c: stem_text(c) for c in ("pred", "ref")}) if use_stemmer else texts


def with_lcs(texts: DataFrame) -> DataFrame:
    return texts.withColumn("lcs", _lcs("pred", "ref"))


def rouge_scheme(orders: tuple[int, ...] = (1, 2)) -> Grams:
    return Grams("rouge", "pred", "ref", orders)


def rouge_n_score(n: int) -> Column:
    return f_measure(F.col(f"rouge_match_{n}"), F.col(f"rouge_pred_{n}"), F.col(f"rouge_ref_{n}"))


def rouge_n(
    pairs: DataFrame,
    keys: tuple[str, ...] = KEYS,
    orders: tuple[int, ...] = (1, 2),
    use_stemmer: bool = False,
    colocated: bool = False,
) -> DataFrame:
    """Keys with ``rouge<n>`` for each order; the scores of a key lie in one partition.

    Pass ``colocated`` to leave them where their pairs are.
    """
    counts = gram_matches(normalized(pairs, keys, use_stemmer), keys, (rouge_scheme(orders),))
    scores = counts.select(*keys, *[rouge_n_score(n).alias(f"rouge{n}") for n in orders])
    return scores if colocated else placed(scores, keys)


def rouge_l(pairs: DataFrame, keys: tuple[str, ...] = KEYS, use_stemmer: bool = False) -> DataFrame:
    """Keys with ``lcs`` and ``rougeL``; computed row by row, without any shuffle."""
    scored = with_lcs(normalized(pairs, keys, use_stemmer))
    sizes = [F.size(joined_tokens(F.col(c))) for c in ("pred", "ref")]
    return scored.select(*keys, "lcs", f_measure(F.col("lcs"), *sizes).alias("rougeL"))


def mean_scores(
    scores: DataFrame, names: tuple[str, ...], by: tuple[str, ...] = ("model",), decimals: int = 4
) -> DataFrame:
    """Plain mean of the per-pair scores; the denominator is the number of predictions."""
    return scores.groupBy(*by).agg(*[F.round(F.avg(n), decimals).alias(n) for n in names])
