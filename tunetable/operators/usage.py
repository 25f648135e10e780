"""Request logs: constraint checks, admission limits, recent prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tunetable.functions.quality import request_columns, request_violations
from tunetable.functions.text import strip

# Admitted requests per window and route, window length, history length.
GENERATE_LIMIT = 5
VALIDATE_LIMIT = 20
ROUTE_LIMITS = {"validate": VALIDATE_LIMIT}  # routes that differ from the general limit
WINDOW = "1 minute"
HISTORY_LENGTH = 5
SALTS = 8


def check_requests(requests: DataFrame) -> DataFrame:
    """Defaults applied, plus ``violations`` and ``accepted``."""
    return (
        requests.withColumns(request_columns())
        .withColumn("violations", request_violations())
        .withColumn("accepted", F.size("violations") == 0)
    )


def limit_of(route: str, limits: dict[str, int] = ROUTE_LIMITS, other: int = GENERATE_LIMIT) -> Column:
    """The admission limit of each request's route."""
    out = F.lit(other)
    for name, n in limits.items():
        out = F.when(F.col(route) == name, n).otherwise(out)
    return out


def admitted(
    requests: DataFrame,
    key: tuple[str, ...],
    limit: int = GENERATE_LIMIT,
    window: str = WINDOW,
    ts: str = "ts",
    order: str = "event_id",
    route_limit: Column | None = None,
) -> DataFrame:
    """The first ``limit`` requests per key and clock-aligned window, with their ``rank``.

    With ``route_limit`` (then the key contains the route) ``limit`` is the largest of the limits.
    Spark keeps only ``limit`` rows per group and task before the shuffle (the rank filter is
    applied on both sides of it), so a single busy client sends a few rows per task.
    """
    w = Window.partitionBy(*key, "window_start").orderBy(ts, order)
    inside = F.col("rank") <= limit
    if route_limit is not None:
        inside = inside & (F.col("rank") <= route_limit)
    return (
        requests.withColumn("window_start", F.window(ts, window)["start"])
        .withColumn("rank", F.row_number().over(w))
        .filter(inside)
    )


def window_counts(
    requests: DataFrame,
    key: tuple[str, ...],
    limit: int | Column = GENERATE_LIMIT,
    window: str = WINDOW,
    ts: str = "ts",
) -> DataFrame:
    """Admitted and blocked requests per key and clock-aligned window; combines before shuffling.

    ``limit`` may be a column over the key.
    """
    return (
        requests.groupBy(*key, F.window(ts, window)["start"].alias("window_start"))
        .agg(F.count("*").alias("n_requests"))
        .withColumn("n_admitted", F.least("n_requests", limit if isinstance(limit, Column) else F.lit(limit)))
        .withColumn("n_blocked", F.col("n_requests") - F.col("n_admitted"))
    )


def with_admission(
    requests: DataFrame,
    key: tuple[str, ...],
    limit: int = GENERATE_LIMIT,
    window: str = WINDOW,
    ts: str = "ts",
    order: str = "event_id",
) -> DataFrame:
    """Every request with ``admitted``: compared with the last admitted one of its window.

    Requests with a null key are one client. A request without a time is in no window and not
    admitted. The cuts, one row per client and window, are repeated over a few salts, so that a
    busy client's requests are joined in several tasks.
    """
    place = F.struct(F.col(ts).alias("t"), F.col(order).alias("o"))
    cuts = (
        admitted(requests, key, limit, window, ts, order)
        .groupBy(*key, "window_start")
        .agg(F.max(place).alias("_cut"))
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    )
    salt = F.pmod(F.xxhash64(order), F.lit(SALTS)).cast("int")
    placed = requests.filter(F.col(ts).isNotNull())
    placed = placed.withColumn("window_start", F.window(ts, window)["start"])
    placed = placed.withColumn("_salt", salt).alias("r")
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"c.{c}")) for c in (*key, "window_start", "_salt")]
    names = [F.col(f"r.{c}") for c in (*requests.columns, "window_start")]
    inside = F.struct(F.col(f"r.{ts}").alias("t"), F.col(f"r.{order}").alias("o")) <= F.col("c._cut")
    timed = placed.join(cuts.alias("c"), same, "left").select(*names, inside.alias("admitted"))
    untimed = requests.filter(F.col(ts).isNull()).select(
        "*",
        F.lit(None).cast(timed.schema["window_start"].dataType).alias("window_start"),
        F.lit(False).alias("admitted"),
    )
    return timed.unionByName(untimed)


def recent_prompts(
    history: DataFrame, user: str = "user_id", n: int = HISTORY_LENGTH, ts: str = "ts"
) -> DataFrame:
    """Each user's ``n`` most recent distinct prompts, newest first; blank prompts are ignored."""
    latest = (
        history.select(user, strip("prompt").alias("prompt"), ts)
        .filter(F.col("prompt") != "")
        .groupBy(user, "prompt")
        .agg(F.max(ts).alias("last_used"))
    )
    w = Window.partitionBy(user).orderBy(F.desc("last_used"), "prompt")
    return latest.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
