import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tunetable.operators import frames, syntax, telemetry, usage


def log_rows(rows, spark):
    return spark.createDataFrame(rows, "run_id string, step string, loss string, learning_rate string, epoch string")


def test_typed_log_is_lenient(spark):
    raw = log_rows(
        [("a", "1", "2.5", "1e-4", "0.1"), ("a", "x", "1", "", ""), ("a", "3", "", None, ""),
         ("a", "4", "n/a", "", ""), ("a", None, "1", "", ""), ("a", "5.0", "1", "", "")],
        spark,
    )
    rows = telemetry.typed_log(raw).collect()
    assert [tuple(r) for r in rows] == [("a", 1, 2.5, 1e-4, 0.1), ("a", 3, None, None, None)]


def test_typed_log_keeps_large_steps_and_drops_odd_numbers(spark):
    odd = ["1.5d", "0x1p3", "1f", "1e", "--1", ".", "1_0"]
    good = [" 2 ", "+.5", "1.", "-1E-3", "inf", "NaN"]
    rows = [("a", str(3_000_000_000 + i), v, "", "") for i, v in enumerate(odd + good)]
    got = telemetry.typed_log(log_rows(rows, spark)).orderBy("step").collect()
    assert [r["step"] - 3_000_000_000 for r in got] == list(range(len(odd), len(odd) + len(good)))
    assert [r["loss"] for r in got[:5]] == [2.0, 0.5, 1.0, -0.001, float("inf")]


def boundaries(rows):
    seen, out = 0, []
    for step, epoch in sorted(rows):
        if epoch and int(epoch) > seen:
            seen = int(epoch)
            out.append((seen, step))
    return out


def test_epoch_boundaries_against_the_loop(spark):
    rnd = random.Random(5)
    runs = {
        "steady": [(s, s / 100) for s in range(1, 500)],
        "jumps": [(s, (s // 50) * 2 + 0.5) for s in range(1, 400)],
        "resumed": [(s, (s % 170) / 40) for s in range(1, 600)],
        "random": [(s, rnd.uniform(0, 9)) for s in range(1, 300)],
    }
    rows = [(r, s, 1.0, e) for r, v in runs.items() for s, e in v]
    log = spark.createDataFrame(rows, "run_id string, step int, loss double, epoch double")
    got = telemetry.epoch_boundaries(log).collect()
    for run, values in runs.items():
        mine = sorted((r["epoch"], r["step"]) for r in got if r["run_id"] == run)
        assert mine == boundaries(values)


def test_loss_minimum_takes_the_first_step_on_ties_and_skips_nan(spark):
    rows = [("a", 1, 2.0), ("a", 2, 1.0), ("a", 3, 1.0), ("a", 4, None), ("a", 5, float("nan"))]
    log = spark.createDataFrame(rows, "run_id string, step int, loss double")
    assert tuple(telemetry.loss_minimum(log).first()) == ("a", 1.0, 2, 3)
    assert [r["step"] for r in telemetry.last_steps(telemetry.with_loss(log), 2).collect()] == [3, 5]
    assert telemetry.thin(log, 2).count() == 2


def test_request_checks(spark):
    rows = [("p", None, None), ("", 64, 0.1), ("x" * 4097, 63, 1.6), (None, 2048, 1.5), ("x" * 4096, 2049, 0.05)]
    df = spark.createDataFrame(rows, "prompt string, max_tokens int, temperature double")
    out = usage.check_requests(df).collect()
    assert [r["violations"] for r in out] == [
        [], ["prompt"], ["prompt", "max_tokens", "temperature"], ["prompt"], ["max_tokens", "temperature"]]
    assert (out[0]["max_tokens"], out[0]["temperature"], out[0]["accepted"]) == (512, 0.7, True)


@pytest.fixture(scope="module")
def hits(spark):
    """One client makes a third of all requests."""
    rnd = random.Random(1)
    start = datetime(2024, 1, 1)
    rows = [
        (i, 0 if rnd.random() < 0.34 else rnd.randrange(1, 30), start + timedelta(seconds=rnd.randrange(600)))
        for i in range(1500)
    ]
    return spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz"), rows


def test_admission(hits):
    df, rows = hits
    seen, expected = {}, {}
    for i, user, ts in sorted(rows, key=lambda r: (r[2], r[0])):
        w = (user, ts.replace(second=0))
        seen[w] = seen.get(w, 0) + 1
        expected[i] = seen[w]
    kept = usage.admitted(df, ("user_id",)).collect()
    assert {r["event_id"]: r["rank"] for r in kept} == {i: n for i, n in expected.items() if n <= 5}
    flagged = usage.with_admission(df, ("user_id",)).collect()
    assert {r["event_id"]: r["admitted"] for r in flagged} == {i: n <= 5 for i, n in expected.items()}
    counts = usage.window_counts(df, ("user_id",)).agg(F.sum("n_admitted"), F.sum("n_blocked")).first()
    assert tuple(counts) == (len(kept), len(rows) - len(kept))


def test_admission_of_null_clients_and_times(spark):
    at = datetime(2024, 1, 1)
    rows = [(i, None, at) for i in range(7)] + [(7, 1, None), (8, None, None), (9, 1, at)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz")
    got = {r["event_id"]: (r["admitted"], r["window_start"]) for r in usage.with_admission(df, ("user_id",)).collect()}
    assert {i for i, (ok, _) in got.items() if ok} == {0, 1, 2, 3, 4, 9} and len(got) == 10
    assert got[7] == (False, None) == got[8]


def test_admission_limits_each_group_before_the_shuffle(hits):
    plan = usage.admitted(hits[0], ("user_id",))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_route_limits(hits):
    df = hits[0].withColumn("route", F.when(F.col("event_id") % 2 == 0, "validate").otherwise("base"))
    kept = usage.admitted(df, ("user_id", "route"), 20, route_limit=usage.limit_of("route"))
    assert "WindowGroupLimit" in kept._jdf.queryExecution().executedPlan().toString()
    highest = {r["route"]: r["m"] for r in kept.groupBy("route").agg(F.max("rank").alias("m")).collect()}
    assert highest == {"validate": 20, "base": 5}
    counts = usage.window_counts(df, ("user_id", "route"), usage.limit_of("route"))
    assert counts.agg(F.sum("n_admitted")).first()[0] == kept.count()


def test_recent_prompts(spark):
    rows = [(1, p, datetime(2024, 1, 1, 0, 0, s)) for s, p in enumerate(["a", "b", " a ", "c", " ", "d", "e", "f", "b"])]
    df = spark.createDataFrame(rows, "user_id long, prompt string, ts timestamp_ntz")
    out = sorted(usage.recent_prompts(df).collect(), key=lambda r: r["rank"])
    assert [r["prompt"] for r in out] == ["b", "f", "e", "d", "c"]


TEXTS = ["one two  three", "", " lead and trail ", 'quote " and \\ back\nline é', "x" * 50]


@pytest.fixture(scope="module")
def encoded(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "stream long, text string")
    return frames.encode_frames(df, ("stream",))


def test_frames_have_the_documented_format(encoded):
    rows = encoded.filter("stream = 0").orderBy("seq").collect()
    assert [r["line"] for r in rows] == [
        'data: {"token": "one "}', 'data: {"token": "two "}', 'data: {"token": " "}',
        'data: {"token": "three"}', 'data: {"done": true}']


def test_decode_inverts_encode(encoded, monkeypatch):
    for block in (4096, 2):
        monkeypatch.setattr(frames, "BLOCK", block)
        folded = frames.fold_streams(frames.parse_lines(encoded), ("stream",)).collect()
        assert {r["stream"]: r["text"] for r in folded} == dict(enumerate(TEXTS))
        assert all(r["done"] for r in folded)


def test_decoding_rules(spark, monkeypatch):
    lines = [
        (1, 0, 'data: {"token": "a"}'), (1, 1, ""), (1, 2, ': ping'), (1, 3, 'data: {"tok'),
        (1, 4, 'data: {"token": ""}'), (1, 5, 'data:{"token": "no"}'), (1, 6, 'data: {"token": "b", "done": false}'),
        (1, 7, 'data: {"done": true}'), (1, 8, 'data: {"token": "late"}'), (1, 9, 'data: {"done": true}'),
        (2, 0, 'data: {"token": "open"}'), (2, 1, 'data: {"token": "x"} y'), (2, 2, 'data: {"token": "x"}{"token": "y"}'),
        (2, 3, "data: {'token': 'x'}"), (2, 4, "data: null"), (2, 5, "data: [1]"), (2, 6, 'data: {"token": "x",}'),
        (2, 7, "data: ")]
    df = spark.createDataFrame(lines, "stream long, seq long, line string")
    rows = frames.decode_frames(df, ("stream",)).collect()
    assert sorted((r["stream"], r["token"]) for r in rows) == [(1, "a"), (1, "b"), (2, "open")]
    for block in (4096, 3, 1):
        monkeypatch.setattr(frames, "BLOCK", block)
        folded = frames.fold_streams(frames.parse_lines(df), ("stream",)).orderBy("stream").collect()
        assert [tuple(r) for r in folded] == [(1, True, "ab", 2), (2, False, "open", 1)]
    running = frames.still_running(
        frames.fold_streams(frames.parse_lines(df), ("stream",)).withColumn("prompt", F.lit(1)), ("prompt",))
    assert running.first()["is_generating"]


def test_speed(spark):
    t0 = datetime(2024, 1, 1)
    rows = [(1, i, f"t{i}", i == 4, t0 + timedelta(milliseconds=400 * i), t0) for i in range(5)]
    rows += [(2, 0, "x", False, t0 + timedelta(milliseconds=500), t0)]
    df = spark.createDataFrame(rows, "s long, seq long, token string, done boolean, ts timestamp_ntz, req timestamp_ntz")
    out = {r["s"]: r for r in frames.fold_streams(df, ("s",), "ts", "req").collect()}
    assert out[1]["token_count"] == 4 and out[1]["elapsed"] == 1.2 and out[1]["tokens_per_sec"] == 3
    assert out[2]["tokens_per_sec"] is None


@pytest.mark.parametrize("block", [4096, 3, 1])
def test_chunks_to_lines(spark, monkeypatch, block):
    monkeypatch.setattr(frames, "BLOCK", block)
    rnd = random.Random(3)
    texts = {1: "a\nbb\n\nccc\nrest", 2: "no newline at all", 3: "\n\n", 4: "x\n" * 20}
    rows = []
    for s, t in texts.items():
        at, n = 0, 0
        while at < len(t):
            step = rnd.randrange(0, 4)
            rows.append((s, n, t[at : at + step]))
            at, n = at + step, n + 1
    df = spark.createDataFrame(rows, "s long, chunk_seq long, data string")
    got = frames.chunks_to_lines(df, ("s",)).collect()
    for s, t in texts.items():
        mine = [r["line"] for r in sorted((r for r in got if r["s"] == s), key=lambda r: r["seq"])]
        assert mine == t.split("\n")[:-1]


def test_syntax_reports(spark):
    rows = [
        ("a", "x = 1", True), ("a", "x = (", True), ("a", "  ", True), ("b", "```python\ny = 2\n```", False),
        ("b", "```\nbad bad\n```", True), ("b", None, True)]
    df = spark.createDataFrame(rows, "model string, text string, done boolean")
    checked = syntax.with_syntax(df)
    assert [r["valid"] for r in checked.collect()] == [True, False, False, True, False, False]
    rates = {r["model"]: r["n_valid"] for r in syntax.validity_rate(checked).collect()}
    assert rates == {"a": 1, "b": 1}
    top = syntax.frequent_errors(checked, 1).collect()
    assert [tuple(r) for r in top] == [("Empty code provided", 2)]
    panels = syntax.checked_panels(df).collect()
    assert [r["message"] for r in panels] == ["Line 1: invalid syntax"]


def test_strict_frames(spark):
    lines = [
        'data: {"token": "a"}, "x": 1', 'data: {"token": "c"},"f":{"done":true}', 'data: {"token": 0}',
        'data: {"token": false}', 'data: {"token": NaN}', 'data: {"done": 0.0}', 'data: {"done": ""}',
        'data: {"token": 5}', 'data: {"token": "0"}', 'data: {"token": 1.5}', 'data: {"token": true}',
        'data: [1]', 'data: null', 'data: {"token": "k"} {"done": true}', 'data:{"token": "n"}',
        'data: {"done": "false"}', 'data: {"d\\u006fne": 1}',
    ]
    df = spark.createDataFrame(list(enumerate(lines)), "seq long, line string")
    got = [(r["seq"], r["token"], r["done"]) for r in frames.parse_lines(df).orderBy("seq").collect()]
    assert got == [
        (7, "5", False), (8, "0", False), (9, "1.5", False), (10, "true", False),
        (15, None, True), (16, None, True),
    ]
    one = df.withColumn("s", F.lit(1))
    assert [r["seq"] for r in frames.decode_frames(one, ("s",)).orderBy("seq").collect()] == [7, 8, 9, 10]
    escaped = one.filter("seq <> 15").unionByName(
        spark.createDataFrame([(20, 'data: {"token": "late"}', 1)], "seq long, line string, s int"))
    assert [r["seq"] for r in frames.decode_frames(escaped, ("s",)).orderBy("seq").collect()] == [7, 8, 9, 10]


def test_the_last_start_of_a_stream_counts(spark):
    rows = [(1, 0, 0, "a", False), (1, 0, 1, "z", True), (1, 1, 0, "x", False), (1, 1, 1, "y", False), (1, 1, 2, None, True), (2, 0, 0, "q", False)]
    df = spark.createDataFrame(rows, "s int, attempt int, seq long, token string, done boolean")
    got = frames.fold_streams(frames.latest_attempts(df, ("s",), "attempt"), ("s",)).collect()
    assert {(r["s"], r["text"], r["token_count"], r["done"]) for r in got} == {(1, "xy", 2, True), (2, "q", 1, False)}
    assert frames.fold_streams(df, ("s",), attempt="attempt").collect() == got


def test_a_frame_ends_where_its_value_ends(spark):
    lines = [
        'data: {"token": "a"}] x', 'data: {"token": "b"}, null', 'data: {"token": "c"',
        'data: {"token": "d", "token": "e"}', 'data: {"token": "f", "more": {"done": true, "n": [1, {}]}}',
        'data: {"token": {"a": 1}}', 'data: {"token": [1]}', 'data: {"token": null, "done": 1e0}',
        "data: {'token': 'g'}", 'data: {"token": Infinity}', 'data: {"token": -3}', 'data:  {"token": "h"} ',
        'data: {"token": "i\\u00e9\\n"}', 'data: {"token": "j", "done": [] }', 'data: "token"', 'data: [{"token": "k"}]',
        'data: {"token": 1e3}', None,
    ]
    df = spark.createDataFrame(list(enumerate(lines)), "seq long, line string")
    got = [(r["seq"], r["token"], r["done"]) for r in frames.parse_lines(df).orderBy("seq").collect()]
    assert got == [
        (3, "e", False), (4, "f", False), (5, '{"a":1}', False), (6, "[1]", False), (7, None, True),
        (10, "-3", False), (11, "h", False), (12, "i\u00e9\n", False), (13, None, True), (16, "1000", False),
    ]
    kept = {r["seq"]: (r["token"], r["done"]) for r in frames.parse_lines(df, keep_others=True).collect()}
    assert kept == {
        **{n: (None, False) for n in range(len(lines))}, **{seq: (token, done) for seq, token, done in got}
    }


def test_frames_are_parsed_once_and_read_once(spark):
    df = spark.createDataFrame([(1, 0, 0, 'data: {"token": "a"}')], "s int, attempt int, seq long, line string")
    folded = frames.fold_streams(frames.parse_lines(df), ("s",), attempt="attempt")
    plan = folded._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1 and plan.count("LogicalRDD") == 1


def test_one_parse_for_frequent_errors(spark):
    checked = syntax.with_syntax(spark.createDataFrame([(1, "x = (")], "id int, text string"))
    plan = syntax.frequent_errors(checked)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
