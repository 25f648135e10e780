"""Connected components of a link table, in rounds over stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunetable.llm.base import checked
from tunetable.session import written


ROWS_PER_FILE = 1 << 18


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(
        F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")
    ).first()
    return row["n"], row["s"]


def _parts(edges: int) -> int:
    """Output files of a table with so many links."""
    return 1 + edges // ROWS_PER_FILE


def _star(edges: DataFrame, large: bool, parts: int) -> DataFrame:
    """Links every larger (or smaller) neighbour of a vertex to its smallest neighbour."""
    if large:
        edges = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = edges.join(checked(least.coalesce(parts), "star-least"), "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    return out.filter("u > v").distinct().coalesce(parts)


def components(links: DataFrame, rounds: int | None = None) -> DataFrame:
    """(v, component): the smallest vertex that each linked vertex reaches; `links` has columns a, b.

    Alternating large-star and small-star steps (Kiveris et al. 2014). Every step is stored in the
    shared folder, so a lost executor costs one step and the plan stays short. Vertices without a
    link do not appear. With a bound on the rounds a component may come in several parts, each named by
    one of its vertices.
    """
    edges = written(
        links.filter("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "links",
    )
    before = _state(edges)
    done = 0
    while before[0] and done != rounds:
        parts = _parts(before[0])
        edges = written(_star(edges, True, parts), "large-star")
        edges = written(_star(edges, False, parts), "small-star")
        after = _state(edges)
        if after == before:
            break
        before, done = after, done + 1
    named = edges.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("component"))
    if rounds is None:
        return named.union(edges.select("v", F.col("v").alias("component")).distinct())
    return named
