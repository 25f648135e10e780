"""User metrics that are computed together: one pass over the pairs, one shuffle of partial sums.

A metric of ``report.METRICS`` is a plan of its own. One of this kind states what it needs instead: columns of a
pair, aggregates over them, and values made of the aggregates. All metrics of a call become one aggregation
per model, combined before the shuffle, so a further metric costs no further pass.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunetable.functions.text import or_empty, strip, word_count
from tunetable.operators.report import long_form


@dataclass(frozen=True)
class FusedMetric:
    """Columns over ``prediction`` and ``reference``, aggregates over those, values over the aggregates.

    A metric registered as ``m`` refers to its own column or aggregate ``c`` as ``m.c``, so metrics share no names.
    """

    rows: dict[str, Column]
    sums: dict[str, Column]
    values: dict[str, Column]


FUSED: dict[str, Callable[[], FusedMetric]] = {}


def register_fused(name: str, metric: Callable[[], FusedMetric]) -> None:
    """Makes a metric available by name; it is built when it is used, as columns need a session."""
    FUSED[name] = metric


def _words(side: str) -> Column:
    return word_count(or_empty(side)).cast("long")


def exact_match() -> FusedMetric:
    """Share of predictions equal to their reference, white space at the ends aside."""
    return FusedMetric(
        {"same": (strip(or_empty("prediction")) == strip(or_empty("reference"))).cast("long")},
        {"same": F.sum("exact_match.same"), "n": F.count("exact_match.same")},
        {"exact_match": F.col("exact_match.same") / F.col("exact_match.n")},
    )


def length_ratio() -> FusedMetric:
    """Words of all predictions per word of all references; null without reference words."""
    return FusedMetric(
        {"pred": _words("prediction"), "ref": _words("reference")},
        {"pred": F.sum("length_ratio.pred"), "ref": F.sum("length_ratio.ref")},
        {"length_ratio": F.try_divide("length_ratio.pred", "length_ratio.ref")},
    )


def length_error() -> FusedMetric:
    """Root of the mean squared difference in words, and the largest difference."""
    apart = F.col("length_error.apart")
    return FusedMetric(
        {"apart": _words("prediction") - _words("reference")},
        {"squares": F.sum(apart * apart), "n": F.count(apart), "most": F.max(F.abs(apart))},
        {
            "length_rmse": F.sqrt(F.col("length_error.squares") / F.col("length_error.n")),
            "length_max_error": F.col("length_error.most").cast("double"),
        },
    )


register_fused("exact_match", exact_match)
register_fused("length_ratio", length_ratio)
register_fused("length_error", length_error)


def fused_scores(
    pairs: DataFrame, metrics: tuple[str, ...], by: tuple[str, ...] = ("model",)
) -> DataFrame:
    """One row per model with the values of all named metrics, from one aggregation.

    Values of the same name in two metrics are an error.
    """
    chosen = {m: FUSED[m]() for m in metrics}
    names = [n for metric in chosen.values() for n in metric.values]
    if len(set(names)) < len(names):
        raise ValueError(f"two metrics have a value of the same name: {sorted(names)}")
    fields = lambda part: (c.alias(n) for n, c in part.items())
    rows = pairs.select(*by, *(F.struct(*fields(c.rows)).alias(m) for m, c in chosen.items()))
    sums = rows.groupBy(*by).agg(*(F.struct(*fields(c.sums)).alias(m) for m, c in chosen.items()))
    return sums.select(*by, *(v for c in chosen.values() for v in fields(c.values)))


def evaluate_fused(pairs: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """(``model``, ``metric``, ``value``) rows, as ``report.evaluate`` takes them in ``extra``."""
    names = tuple(n for m in metrics for n in FUSED[m]().values)
    return long_form(fused_scores(pairs, metrics), names)
