"""Chunks are joined where they lie, before they are shuffled."""

import random

import pytest
from pyspark.sql import functions as F

from tunetable.operators import frames


@pytest.mark.parametrize("twice", [False, True])
def test_chunks_in_any_order_and_some_twice(spark, twice):
    rng = random.Random(3)
    rows, want = [], set()
    for stream in ("a", "b", None):
        pieces = ["".join(rng.choice(["é", "x", "\n", "€"]) for _ in range(rng.randrange(4))) for _ in range(5000)]
        sent = [(stream, i, p or None) for i, p in enumerate(pieces)]
        again = [(stream, i, rng.choice("uv\n")) for i in rng.sample(range(5000), 40)] if twice else []
        whole = "".join(p or "" for _, _, p in sorted(sent + again, key=lambda r: (r[1], (r[2] or "").encode())))
        want |= {(stream, i, line) for i, line in enumerate(whole.split("\n")[:-1])}
        rows += sent + again
    if twice:
        rng.shuffle(rows)
    df = spark.createDataFrame(rows, "s string, n int, d string").repartition(3, F.col("n") % 7)
    got = frames.chunks_to_lines(df, ("s",), "n", "d").select("s", "seq", "line").collect()
    joined = {tuple(r) for r in got if r["s"] is not None}
    assert joined == {r for r in want if r[0] is not None}


def test_neighbouring_chunks_are_one_row_of_the_shuffle(spark):
    chunks = spark.range(0, 9000, 1, 1).select(F.lit(1).alias("s"), F.col("id").alias("n"), F.lit("ab ").alias("d"))
    runs = frames._runs(chunks, ("s",), "n", "d").collect()
    assert len(runs) < 20 and sum(len(r["ends"]) for r in runs) == 9000
    assert "".join(r["data"] for r in sorted(runs, key=lambda r: r["o"])) == "ab " * 9000
