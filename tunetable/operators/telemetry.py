"""Training-loss logs: lenient typing, thinning, minimum and epoch boundaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Every n-th step is logged; decimals of the written log.
LOGGING_STEPS = 10
LOSS_DECIMALS = 6
EPOCH_DECIMALS = 4

NUMERIC = ("loss", "learning_rate", "epoch")
WHOLE = r"^\s*[+-]?\d+\s*$"
DECIMAL = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf(inity)?|nan)\s*$"


def typed_log(raw: DataFrame) -> DataFrame:
    """String log rows -> numbers. An empty field becomes null; a malformed one drops the row.

    Only plain decimal forms are numbers: casts alone would also take suffixes and hexadecimal floats.
    """
    step = F.when(F.col("step").rlike(WHOLE), F.expr("try_cast(step as bigint)"))
    fields = [c for c in NUMERIC if c in raw.columns]

    def number(c: str) -> Column:
        return F.when(F.col(c).rlike(DECIMAL), F.expr(f"try_cast({c} as double)"))

    well_formed = step.isNotNull()
    for c in fields:
        empty = F.coalesce(F.col(c), F.lit("")) == ""
        well_formed = well_formed & (empty | number(c).isNotNull())
    others = [c for c in raw.columns if c not in ("step", *fields)]
    return raw.filter(well_formed).select(
        *others, step.alias("step"), *[number(c).alias(c) for c in fields]
    )


def with_loss(log: DataFrame) -> DataFrame:
    return log.filter(F.col("loss").isNotNull())


def log_rows(log: DataFrame) -> DataFrame:
    """Rows as the trainer writes them: only events with a loss, rounded."""
    rounded = with_loss(log).withColumn("loss", F.round("loss", LOSS_DECIMALS))
    if "epoch" not in log.columns:
        return rounded
    return rounded.withColumn("epoch", F.round(F.coalesce("epoch", F.lit(0.0)), EPOCH_DECIMALS))


def thin(log: DataFrame, every: int = LOGGING_STEPS) -> DataFrame:
    return log.filter(F.col("step") % every == 0)


def loss_minimum(log: DataFrame, by: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """Smallest loss and the first step that reached it."""
    points = with_loss(log).filter(~F.isnan("loss"))
    return (
        points.groupBy(*by)
        .agg(F.min(F.struct("loss", "step")).alias("m"), F.count("*").alias("n_points"))
        .select(*by, F.col("m.loss").alias("min_loss"), F.col("m.step").alias("min_step"), "n_points")
    )


def epoch_boundaries(log: DataFrame, by: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """Steps at which the whole part of ``epoch`` rises above everything seen before.

    Reduced first to the first step of every whole epoch. Epoch e then is a boundary exactly if no
    higher epoch appears at an earlier step, so the window sees one row per epoch of a run, however
    long the run is and whether or not its epochs grow steadily.
    """
    whole = F.floor("epoch")
    firsts = (
        with_loss(log)
        .filter(F.col("epoch").isNotNull() & (whole > 0))
        .groupBy(*by, whole.alias("epoch"))
        .agg(F.min("step").alias("step"))
    )
    higher = Window.partitionBy(*by).orderBy(F.desc("epoch")).rowsBetween(
        Window.unboundedPreceding, -1
    )
    earliest_higher = F.min("step").over(higher)
    return (
        firsts.withColumn("_h", earliest_higher)
        .filter(F.col("_h").isNull() | (F.col("_h") >= F.col("step")))
        .drop("_h")
    )


def last_steps(log: DataFrame, n: int = 10) -> DataFrame:
    return log.orderBy(F.desc("step")).limit(n).orderBy("step")
