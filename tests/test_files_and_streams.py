import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tunetable import session
from tunetable.operators import frames, report, telemetry
from tunetable.operators.syntax import parse_result
from tunetable.sources import inline, readers, writers
from tunetable.streaming import limits, loss, tokens
from tunetable.streaming.runs import append_to_files, file_stream


@pytest.fixture
def rows(spark):
    data = [("i1", "", "o\n1", "t1", "train"), ("é \"q\"", None, "o2", "t2", "eval"), ("i3", "x", "o3", "t3", "train")]
    return spark.createDataFrame(data, "instruction string, input string, output string, text string, split string")


def test_jsonl_round_trip(spark, rows, tmp_path):
    path = writers.write_jsonl(rows, str(tmp_path / "out"))
    back = readers.read_splits(spark, {s: f"{path}/split={s}" for s in ("train", "eval")})
    assert sorted(map(str, back.collect())) == sorted(map(str, rows.collect()))
    text = "".join(p.read_text() for p in (tmp_path / "out").rglob("part-*"))
    assert "é" in text and text.count('"input":') == 3


def test_malformed_lines(spark, tmp_path):
    path = tmp_path / "bad.jsonl"
    path.write_text('{"instruction": "a"}\n\n{"instruction": \n')
    with pytest.raises(Exception, match="FAILFAST"):
        readers.read_jsonl(spark, str(path)).collect()
    assert readers.read_jsonl(spark, str(path), strict=False).count() == 1


def test_published_splits_are_pruned(spark, rows, tmp_path):
    path = writers.publish_splits(rows, str(tmp_path / "pub"))
    only = readers.read_published(spark, path).filter("split = 'eval'")
    assert only.count() == 1
    assert "PartitionFilters: [isnotnull(split" in only._jdf.queryExecution().executedPlan().toString()


def test_first_available(spark, tmp_path):
    a, b = tmp_path / "a.csv", tmp_path / "b.csv"
    b.write_text("step,loss,learning_rate,epoch\n1,2.5,,0.1\nbad,1,,\n2,,0.001,\n3\n")
    log = readers.read_loss_log(spark, [str(a), str(b)])
    assert [(r["step"], r["loss"]) for r in log.collect()] == [(1, 2.5), (2, None), (3, None)]
    a.write_text("step,loss,learning_rate,epoch\n9,1,,\n")
    assert readers.read_loss_log(spark, [str(a), str(b)]).first()["step"] == 9
    with pytest.raises(FileNotFoundError):
        readers.read_loss_log(spark, [str(tmp_path / "c.csv")])


def test_log_append_keeps_earlier_rows(spark, tmp_path):
    log = spark.createDataFrame([(1, 2.0, 0.1)], "step int, loss double, epoch double")
    for _ in range(2):
        writers.append_log(log, str(tmp_path / "log"))
    assert readers.read_loss_log(spark, str(tmp_path / "log")).count() == 2


def test_metrics_document(spark, tmp_path):
    schema = "model string, rouge1 double, rouge2 double, rougeL double, bleu double, perplexity double, avg_response_length double, num_samples long"
    rep = spark.createDataFrame(
        [("finetuned", 0.319, 0.166, 0.246, None, 5.4, 58.2, 20), ("base", 0.314, 0.134, 0.237, None, 12.5, 58.7, 20)], schema)
    doc = report.metrics_document(rep, F.max("num_samples"), note="n")
    path = writers.write_document(doc, str(tmp_path / "doc"))
    records = readers.metric_records(readers.read_metrics_document(spark, [path]))
    assert [(r["model"], r["rouge1"], r["eval_samples"], r["has_note"]) for r in records.orderBy("position").collect()] == [
        ("base", 0.314, 20, True), ("finetuned", 0.319, 20, True)]
    twice = records.unionByName(records.withColumn("position", F.col("position") + 5).withColumn("rouge1", F.lit(9.0)))
    assert {r["rouge1"] for r in report.first_record(twice, "position").collect()} == {0.314, 0.319}


def test_missing_inputs_are_reported(spark, rows, tmp_path):
    path = writers.write_jsonl(rows, str(tmp_path / "a"), by_split=False)
    found, missing = readers.union_available(spark, {"base": path, "finetuned": str(tmp_path / "none")})
    assert missing == ["finetuned"] and {r["model"] for r in found.collect()} == {"base"}
    with pytest.raises(FileNotFoundError):
        readers.union_available(spark, {"x": str(tmp_path / "none")})


def test_review_file(spark, tmp_path):
    df = inline.review_problems(spark).withColumn("k", F.length("prompt"))
    assert all(parse_result(r["generated_code"])[0] for r in df.collect())
    path = writers.write_review(report.review_report(df, "k"), str(tmp_path / "review"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "review").glob("part-*")))
    assert text.startswith("# Human Evaluation Benchmark") and text.count("## Problem") == 3
    assert text.index("## Problem 1") < text.index("## Problem 2") < text.index("## Problem 3")
    assert inline.example_prompts(spark).count() == 5


def test_scratch_needs_a_shared_folder_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://somewhere"

        def getConf(self):
            return self

        def get(self, key, default=None):
            return default

    class Session:
        conf, sparkContext = Context(), Context()

    with pytest.raises(ValueError):
        session.shared_dir(Session())
    assert session.scratch_path(spark, "x").startswith(session.shared_dir(spark))


def write_parts(df, folder, n):
    """Files that a stream with one file per batch reads one after the other."""
    for i in range(n):
        df.filter(F.col("part") == i).drop("part").coalesce(1).write.parquet(f"{folder}/p{i}")


def stream_of(spark, df, folder, n):
    write_parts(df, folder, n)
    return file_stream(spark, f"{folder}/*", df.drop("part").schema, max_files=1)


def test_token_streams_across_batches(spark, tmp_path):
    texts = {f"s{i}": " ".join(f"w{i}.{j}" for j in range(i * 3 + 1)) for i in range(6)}
    df = spark.createDataFrame(list(texts.items()), "stream string, text string")
    lines = frames.encode_frames(df, ("stream",))
    late = spark.createDataFrame([("s1", 99, 'data: {"token": "late"}')], lines.schema)
    parted = lines.withColumn("part", (F.col("seq") / 4).cast("int")).unionByName(
        late.withColumn("part", F.lit(4)))
    parted = parted.filter("not (stream = 's5' and line like '%done%')")
    folded = tokens.fold_stream(stream_of(spark, parted, tmp_path / "in", 5), "stream")
    out = spark.read.schema(folded.schema).parquet(append_to_files(folded, "t"))
    got = {r["stream"]: (r["text"], r["token_count"], r["done"]) for r in out.collect()}
    assert got == {k: (t, len(t.split()), True) for k, t in texts.items() if k != "s5"}


def test_idle_token_streams_are_given_up(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    rows = [("a", 0, 'data: {"token": "x"}', t0, 0), ("b", 0, 'data: {"token": "y"}', t0 + timedelta(hours=9), 1),
            ("b", 1, 'data: {"done": true}', t0 + timedelta(hours=9), 1), ("c", 0, 'data: {"token": "z"}', t0 + timedelta(hours=10), 2)]
    df = spark.createDataFrame(rows, "stream string, seq long, line string, ts timestamp, part int")
    folded = tokens.fold_stream(stream_of(spark, df, tmp_path / "in", 3), "stream", ts="ts")
    out = spark.read.schema(folded.schema).parquet(append_to_files(folded, "idle"))
    assert {tuple(r) for r in out.collect()} == {("b", "y", 1, True), ("a", "x", 1, False)}


def first_hit(rows, limit, seconds):
    state, out = {}, {}
    for i, user, ts in sorted(rows, key=lambda r: (r[2], r[0])):
        start, n = state.get(user, (None, 0))
        if start is None or ts >= start + timedelta(seconds=seconds):
            start, n = ts, 0
        state[user] = (start, n + 1)
        out[i] = n + 1 <= limit
    return out


def request_rows():
    rnd = random.Random(2)
    times = sorted(rnd.randrange(3600) for _ in range(900))
    start = datetime(2024, 1, 1)
    return [(i, 0 if rnd.random() < 0.34 else rnd.randrange(1, 9), start + timedelta(seconds=t)) for i, t in enumerate(times)]


def test_first_hit_windows_across_batches(spark, tmp_path):
    rows = request_rows()
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp").withColumn(
        "part", (F.col("event_id") / 300).cast("int"))
    admitted = limits.first_hit_windows(stream_of(spark, df, tmp_path / "in", 3), "user_id")
    out = spark.read.schema(admitted.schema).parquet(append_to_files(admitted, "hits"))
    assert {r["event_id"]: r["admitted"] for r in out.collect()} == first_hit(rows, 5, 60)


def test_live_window_counts_across_batches(spark, tmp_path):
    rows = request_rows()
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp").withColumn(
        "part", (F.col("event_id") / 300).cast("int"))
    counts = limits.live_window_counts(stream_of(spark, df, tmp_path / "in", 3), ("user_id",))
    got = limits.collect_window_counts(counts, ("user_id",)).collect()
    expected = {}
    for _, user, ts in rows:
        k = (user, ts.replace(second=0))
        expected[k] = expected.get(k, 0) + 1
    assert {(r["user_id"], r["window_start"]): (r["n_requests"], r["n_admitted"]) for r in got} == {
        k: (n, min(n, 5)) for k, n in expected.items()}


def test_live_log_equals_the_batch_log(spark, tmp_path):
    schema = "run_id string, step string, loss string, epoch string"
    rows = [("r", str(s), "" if s % 7 == 0 else str(5 / s), f"{s / 50}") for s in range(1, 120)]
    df = spark.createDataFrame(rows, schema).withColumn("part", (F.col("step").cast("int") / 50).cast("int"))
    stream = stream_of(spark, df, tmp_path / "in", 3)
    batch = loss.live_log(df.drop("part"))
    assert sorted(map(str, loss.append_live_log(stream).collect())) == sorted(map(str, batch.collect()))
    low = loss.running_minimum(stream).first()
    assert tuple(low) == tuple(telemetry.loss_minimum(batch).first())
