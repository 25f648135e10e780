"""State functions are called per bucket of keys, and files of a stream's batches follow the table's size."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from test_files_and_streams import stream_of

from tunetable.operators import frames
from tunetable.streaming import buckets, limits, runs, tokens
from tunetable.streaming.runs import append_to_files, file_stream, slices


def test_slices_have_more_files_as_the_table_grows(spark, monkeypatch):
    monkeypatch.setattr(runs, "SLICE_ROWS", 1000)
    monkeypatch.setattr(runs, "LEAST_ROWS", 100)
    folder, files = slices(spark.range(15_000), "id", "many-files")
    assert files == 5
    seen = runs.each_batch(
        file_stream(spark, folder, spark.range(1).schema, max_files=files), "seen", "append", runs.overwrite_batch
    )
    got = spark.read.parquet(seen).groupBy("batch").agg(F.min("id"), F.max("id"), F.count("*")).collect()
    assert sorted(map(tuple, got)) == [(0, 0, 4999, 5000), (1, 5000, 9999, 5000), (2, 10000, 14999, 5000)]


def test_state_is_keyed_by_bucket(spark, tmp_path):
    """Grouped by key, a call per key and micro-batch took most of the time of q_stream_tokens and q_stream_first_hit."""
    rows = spark.range(8).select("id", F.current_timestamp().alias("ts"), F.lit(0).alias("part"))
    requests = stream_of(spark, rows.select("part", F.col("id").alias("event_id"), "ts", F.col("id").alias("u")), tmp_path, 1)
    for df in (limits.first_hit_windows(requests, "u"), tokens.fold_stream(
        requests.select("u", F.lit(0).alias("seq"), F.lit("x").alias("line"), "ts"), "u", "ts"
    )):
        plan = df._jdf.queryExecution().analyzed().toString()
        assert "FlatMapGroupsInPandasWithState" in plan and "bucket" in plan


@pytest.mark.parametrize("kind", ["string", "bigint", "date"])
def test_names_of_keys(spark, kind):
    values = spark.sql(f"select cast(v as {kind}) v from values ('2024'), (null) t(v)")
    named = values.withColumn("name", buckets.key_name("v"))
    back = named.select("v", buckets.key_of("name", kind).alias("w"))
    assert all(r["v"] == r["w"] for r in back.collect())
    assert named.filter(F.col("name").isNull()).count() == 0


def test_streams_of_one_bucket_stay_apart(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(buckets, "BUCKETS", 1)
    t0 = datetime(2024, 1, 1)
    texts = {name: f"{name} says " + "x " * i + "end" for i, name in enumerate(("a", "b", "", None))}
    df = spark.createDataFrame(list(texts.items()), "stream string, text string")
    lines = frames.encode_frames(df, ("stream",)).withColumn("ts", F.lit(t0))
    parted = lines.withColumn("part", F.least(F.col("seq"), F.lit(1)).cast("int"))
    hours = ((2, 3), (3, 9))
    later = spark.createDataFrame(
        [("late", h, 'data: {"token": "z"}', t0 + timedelta(hours=h), part) for part, h in hours],
        "stream string, seq long, line string, ts timestamp, part int",
    )
    cut = parted.filter("not (stream <=> 'b' and line like '%done%')")
    cut = cut.unionByName(later.select(*cut.columns))
    folded = tokens.fold_stream(stream_of(spark, cut, tmp_path / "in", 4), "stream", "ts")
    out = spark.read.schema(folded.schema).parquet(append_to_files(folded, "apart"))
    got = {r["stream"]: (r["text"], r["done"]) for r in out.collect() if r["stream"] != "late"}
    assert got == {k: (t, k != "b") for k, t in texts.items()}
