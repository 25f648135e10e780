"""Bootstrap aggregation of per-pair scores.

Instead of drawing resampled tables, every row gets a Poisson(1) weight per replicate from a hash of
(seed, row, replicate) (Chamandy et al. 2012): one pass with partial aggregation, the same result for
any partitioning, and nothing but (group, replicate) sums in the shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunetable.operators.sampling import DEFAULT_SEED

REPLICATES = 1000
PER_DIGEST = 8  # 16-bit uniforms in one md5 digest
LEVELS = 1 << 16


def poisson_thresholds() -> list[int]:
    """Points of a 16-bit uniform at which the Poisson(1) count grows by one."""
    out, cumulative, k = [], 0.0, 0
    while True:
        cumulative += math.exp(-1) / math.factorial(k)
        level = math.floor(cumulative * LEVELS + 0.5)
        if level >= LEVELS:
            return out
        out.append(level)
        k += 1


def poisson_weight(uniform: Column) -> Column:
    weight = F.lit(0)
    for t in poisson_thresholds():
        weight = weight + (uniform >= t).cast("int")
    return weight


def _weight(i: int) -> Column:
    """The weight that the i-th 16 bits of ``digest`` give."""
    digits = F.substring("digest", i * 4 + 1, 4)
    return poisson_weight(F.conv(digits, 16, 10).cast("int"))


def bootstrap(
    scores: DataFrame,
    names: tuple[str, ...],
    key: str,
    by: tuple[str, ...] = ("model",),
    replicates: int = REPLICATES,
    seed: int = DEFAULT_SEED,
) -> DataFrame:
    """Per group and ``metric``: ``low``, ``mid``, ``high``, the 2.5 %, 50 % and 97.5 % points of
    the resampled means, and ``n_replicates``, how many replicates drew any row.

    All named scores share the weights of their row. The eight weights of a digest are eight sums
    side by side, so a row becomes one row per digest. A replicate of a small group in which every
    weight is 0 has no mean and is left out.
    """
    blocks = math.ceil(replicates / PER_DIGEST)
    block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    seeded = F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"), F.col("block").cast("string"))
    drawn = (
        scores.select(*by, *names, key, block)
        .select(*by, *names, "block", F.md5(seeded).alias("digest"))
        .select(*by, *names, "block", *[_weight(i).alias(f"w{i}") for i in range(PER_DIGEST)])
    )
    sums = drawn.groupBy(*by, "block").agg(
        *[F.sum(f"w{i}").alias(f"w{i}") for i in range(PER_DIGEST)],
        *[
            F.sum(F.col(f"w{i}") * F.col(n)).alias(f"s{i}_{n}")
            for i in range(PER_DIGEST)
            for n in names
        ],
    )
    sides = [
        F.struct(
            F.lit(i).alias("i"),
            *[F.try_divide(F.col(f"s{i}_{n}"), F.col(f"w{i}")).alias(n) for n in names],
        )
        for i in range(PER_DIGEST)
    ]
    means = sums.select(*by, "block", F.inline(F.array(*sides)))
    means = means.withColumn("replicate", F.col("block") * PER_DIGEST + F.col("i"))
    means = means.filter(F.col("replicate") < replicates)
    quantiles = F.percentile("mean", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    return (
        means.unpivot([*by, "replicate"], list(names), "metric", "mean")
        .groupBy(*by, "metric")
        .agg(quantiles.alias("q"), F.count("mean").alias("n_replicates"))
        .select(
            *by,
            "metric",
            *[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(("low", "mid", "high"))],
            "n_replicates",
        )
    )
