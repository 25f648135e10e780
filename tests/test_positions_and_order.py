"""Rows by place, streams out of order, first-hit windows in batch, repeated keys."""

import json
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tunetable.operators import admission, fused, positions, report, sampling
from tunetable.session import scratch_path
from tunetable.streaming import ordered, snapshots
from tunetable.streaming.runs import append_to_files, each_batch, file_stream, overwrite_batch


def files(spark, contents):
    """Text files whose names sort in the given order; returns their folder."""
    path = scratch_path(spark, "files")
    for number, lines in enumerate(contents):
        spark.createDataFrame([("\n".join(lines),)], "v string").coalesce(1).write.text(f"{path}/part={number:03}")
    return path


def test_positions_follow_files_and_lines(spark):
    rng = random.Random(1)
    contents = [[f"{i}-{j}" for j in range(rng.randrange(1, 400))] + ["", "  "] for i in range(9)]
    path = files(spark, contents)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")  # many splits per file
    try:
        rows = positions.with_position(positions.text_rows(spark, path))
        got = {r["position"]: r["value"] for r in rows.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = [line for part in contents for line in part if line.strip()]
    assert [got[i] for i in range(len(got))] == want


def test_pairs_stop_at_the_shorter_side(spark):
    left = files(spark, [[json.dumps({"prediction": f"p{i}{j}"}) for j in range(3)] for i in range(3)])
    right = files(spark, [[json.dumps({"reference": f"r{i}"}) for i in range(5)]])
    got = sorted(map(tuple, positions.align_by_position(spark, left, right).collect()))
    assert got == [(i, f"p{i // 3}{i % 3}", f"r{i}") for i in range(5)]
    assert positions.pairing_counts(spark, left, right).first().asDict() == {
        "n_predictions": 9, "n_references": 5, "n_pairs": 5,
    }
    bad = files(spark, [["{"]])
    with pytest.raises(Exception, match="MALFORMED|malformed|Malformed"):
        positions.align_by_position(spark, left, bad).collect()


def test_occurrences_are_numbered_in_the_order_of_the_files(spark):
    rng = random.Random(2)
    contents = [[rng.choice(["same", "same", "same", f"x{rng.randrange(9)}"]) for _ in range(200)] for _ in range(5)]
    path = files(spark, contents)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256")
    try:
        rows = positions.with_position(positions.text_rows(spark, path))
        got = {r["position"]: r["row_key"].split(":")[1] for r in positions.occurrence_keys(rows).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    seen, want = Counter(), {}
    for i, line in enumerate(line for part in contents for line in part):
        seen[line] += 1
        want[i] = str(seen[line])
    assert got == want


def test_bad_rows_have_a_place_and_a_reason(spark):
    schema = StructType(
        [StructField("a", LongType(), False), StructField("b", StringType()), StructField("c d", StringType())]
    )
    lines = {
        '{"a": 1, "b": "x", "c d": "y"}': None, '{"a": 2}': None, '{"a": 3, "b": null, "z": []}': None,
        "{": "malformed", '{"a": 1} 2': "malformed", '{"a": 1}, {"a": 2}': "malformed", "7": "not an object",
        "[1]": "not an object", "null": "not an object", '{"b": "x"}': "missing: a", '{"a": null}': "missing: a",
        '{"a": "1"}': "type: a", '{"a": true, "b": 2}': "type: a, b", '{"a": 1, "c d": {}}': "type: c d",
    }
    good, bad = positions.read_with_bad_rows(spark, files(spark, [list(lines)]), schema)
    assert {r["line"]: r["reason"] for r in bad.collect()} == {k: v for k, v in lines.items() if v}
    assert sorted((r["position"], r["a"], r["b"], r["c d"]) for r in good.collect()) == [
        (0, 1, "x", "y"), (1, 2, None, None), (2, 3, None, None),
    ]
    assert {list(lines)[r["position"]] for r in bad.collect()} == {k for k, v in lines.items() if v}


def test_equal_keys_are_numbered_by_content(spark):
    rng = random.Random(3)
    rows = [("hot" if i % 3 == 0 else rng.choice("abc"), rng.randrange(-5, 5) << 59 if i % 2 else i) for i in range(900)]
    rows += [(None, 1), (None, 1), ("hot", 7)] + [("hot", 3)] * 300
    table = spark.createDataFrame(rows, "k string, v long").repartition(7)
    got = sampling.row_index_ordered(table, "k", "i", F.col("v")).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    assert [(r["k"], r["v"]) for r in sorted(got, key=lambda r: r["i"])] == order
    assert sorted(r["i"] for r in got) == list(range(len(rows)))


def windows(rows, length, limit):
    out, state = {}, {}
    for user, event, us in sorted(rows, key=lambda r: (r[2], r[1])):
        start, n = state.get(user, (None, 0))
        if start is None or us >= start + length:
            start, n = us, 0
        state[user] = start, n + 1
        out[event] = (user, start, n + 1, n + 1 <= limit)
    return out


@pytest.mark.parametrize("span", [1, 2, 7, 1024])
def test_first_hit_windows_of_spans_equal_the_loop(spark, span):
    rng = random.Random(span)
    second = 1_000_000
    rows, event = [], 0
    for user in [1, 2, 3, None]:
        us = rng.randrange(-50, 50) * second
        for _ in range(300):
            us += rng.choice([0, 1, second // 2, second, 3 * second, 9 * second, 10 * second, 95 * second])
            rows.append((user, event, us))
            event += 1
    rows.append((9, event, 5))
    table = spark.createDataFrame(rows, "u long, e long, us long").select("u", "e", F.timestamp_micros("us").alias("t"))
    table = table.unionByName(spark.createDataFrame([(1, -1, None)], "u long, e long, t timestamp"))
    found = admission.first_hit_admission(table, "u", limit=2, seconds=10, ts="t", order="e", span=span)
    got = {r["e"]: (r["u"], r["window_start"], r["rank"], r["admitted"]) for r in found.collect()}
    assert got == windows(rows, 10 * second, 2)


def test_admission_of_an_empty_log(spark):
    empty = spark.createDataFrame([], "u string, e long, t timestamp")
    assert admission.first_hit_admission(empty, "u", ts="t", order="e").count() == 0


def streamed(spark, batches, schema):
    """A stream of one file per batch."""
    path = scratch_path(spark, "stream")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return file_stream(spark, path, spark.createDataFrame([], schema).schema, max_files=1)


def test_chunks_cut_within_characters(spark):
    rng = random.Random(5)
    texts = {k: "".join(rng.choice(["é", "€", "😀", "a", "\n", "\r\n"]) for _ in range(300)) for k in ("x", "y")}
    batches = [[], [], []]
    for name, text in texts.items():
        raw, number = text.encode(), 0
        while raw:
            size = rng.randrange(0, 4)
            batches[min(2, number // 120)].append((name, number, raw[:size]))
            raw, number = raw[size:], number + 1
        batches[2].append((name, number, None))
    lines = ordered.byte_chunk_lines(streamed(spark, batches, "id string, chunk_seq long, data binary"), "id")
    with ordered.keyed_state(spark):
        stored = spark.read.schema(lines.schema).parquet(append_to_files(lines, "lines")).collect()
    got = defaultdict(dict)
    for r in stored:
        got[r["id"]][r["seq"]] = r["line"]
    for name, text in texts.items():
        assert [got[name][i] for i in range(len(got[name]))] == text.split("\n")[:-1]


def frame(stream, attempt, seq, token, at):
    line = 'data: {"done": true}' if token is None else f'data: {{"token": "{token}"}}'
    return stream, attempt, seq, line if token != "noise" else ": ping", at


def prefixes_of(spark, batches, **options):
    lines = streamed(spark, batches, "s string, a int, seq long, line string, ts timestamp_ltz")
    out = ordered.reordered_prefixes(lines, "s", "ts", "a", **options)
    with ordered.keyed_state(spark):
        return spark.read.schema(out.schema).parquet(append_to_files(out, "prefixes"))


def test_frames_in_any_order_two_attempts_and_noise(spark):
    from datetime import datetime, timedelta, timezone

    rng = random.Random(6)
    now = datetime(2024, 1, 1, tzinfo=timezone.utc)
    batches, texts = [[], [], [], []], {}
    for s in ("one", "two", "three"):
        words = [rng.choice(["a ", "b ", "noise"]) for _ in range(700)]
        texts[s] = "".join(w for w in words if w != "noise"), sum(w != "noise" for w in words)
        for attempt, tokens in ((0, ["old "] * 5), (1, words + [None])):
            for seq, token in enumerate(tokens):
                row = frame(s, attempt, seq, token, now + timedelta(milliseconds=seq))
                for batch in {rng.randrange(4) for _ in range(rng.choice([1, 1, 2]))}:  # some come twice
                    batches[batch].append(row)
    got = ordered.whole_streams(prefixes_of(spark, batches), "s").collect()
    assert {r["s"]: (r["text"], r["token_count"]) for r in got} == texts
    assert all(r["done"] and r["gaps"] == 0 for r in got)


def test_a_missing_frame_is_given_up_after_its_time(spark):
    from datetime import datetime, timedelta, timezone

    now = datetime(2024, 1, 1, tzinfo=timezone.utc)
    first = [frame("s", 0, n, f"t{n} ", now) for n in (0, 1, 3, 4)] + [frame("s", 0, 5, None, now)]
    later = [[frame("other", 0, k, "x", now + timedelta(hours=k + 1))] for k in range(3)]
    got = ordered.whole_streams(prefixes_of(spark, [first, *later], patience=60), "s").collect()
    row = next(r for r in got if r["s"] == "s")
    assert (row["text"], row["token_count"], row["done"], row["gaps"]) == ("t0 t1 t3 t4 ", 4, True, 1)


def test_recent_prompts_move_to_the_front(spark):
    from datetime import datetime, timedelta

    now = datetime(2024, 1, 1)
    uses = ["a", "b", " a ", "", "c", "d", "b", "e", "f", None, "a"]
    rows = [(1, p, now + timedelta(minutes=i)) for i, p in enumerate(uses)] + [(2, "z", None)]
    batches = [rows[:4], rows[4:7], rows[7:]]
    lists = ordered.live_recent_prompts(streamed(spark, batches, "user_id int, prompt string, ts timestamp"), n=3)
    with ordered.keyed_state(spark):
        stored = spark.read.parquet(each_batch(lists, "recent", "update", overwrite_batch))
    by_batch = defaultdict(list)
    for r in sorted(stored.collect(), key=lambda r: r["rank"]):
        by_batch[r["batch"]].append(r["prompt"])
    assert dict(by_batch) == {0: ["a", "b"], 1: ["b", "d", "c"], 2: ["a", "f", "e"]}


def test_scores_of_repeated_keys_count_row_by_row(spark):
    pairs = [("m", 1, "the cat sat on the mat", "the cat sat on a mat"), ("m", 2, "a dog", "the dog ran home")]
    unique = [("m", i, p, r) for i, (_, _, p, r) in enumerate([pairs[0], pairs[0], pairs[1]])]
    schema = "model string, sample_id long, prediction string, reference string"
    got = report.text_scores(spark.createDataFrame([pairs[0], *pairs], schema)).first().asDict()
    want = report.text_scores(spark.createDataFrame(unique, schema)).first().asDict()
    assert got == want and got["num_samples"] == 3


def test_fused_metrics_share_one_exchange(spark):
    rows = [("m", "a b", "a b "), ("m", "a", "b c"), ("m", None, None), ("n", "x", "")]
    pairs = spark.createDataFrame(rows, "model string, prediction string, reference string")
    names = ("exact_match", "length_ratio", "length_error")
    scores = fused.fused_scores(pairs, names)
    plan = scores._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    got = {r["model"]: r.asDict() for r in scores.collect()}
    assert got["m"] == {
        "model": "m", "exact_match": 2 / 3, "length_ratio": 3 / 4, "length_rmse": (1 / 3) ** 0.5, "length_max_error": 1.0,
    }
    assert got["n"]["length_ratio"] is None and got["n"]["exact_match"] == 0
    fused.register_fused("again", fused.exact_match)
    with pytest.raises(ValueError, match="exact_match"):
        fused.fused_scores(pairs, ("exact_match", "again"))
    long = fused.evaluate_fused(pairs, names)
    wide = report.evaluate(pairs.withColumn("sample_id", F.lit(1)), ("text",), long, ("rougeL", "exact_match", "num_samples"))
    assert {r["model"]: r["exact_match"] for r in wide.collect()} == {"m": 2 / 3, "n": 0.0}


def test_versions_of_a_growing_log(spark):
    batches = [[(i, 10 * i)] * (i + 1) for i in range(5)]
    folder = snapshots.versioned_log(streamed(spark, batches, "a int, b int"), "versions", compact_after=2)
    known = {r["version"]: (len(r["parts"]), r["n_rows"]) for r in snapshots.versions(spark, folder).collect()}
    assert known == {0: (1, 1), 1: (2, 3), 2: (1, 6), 3: (2, 10), 4: (1, 15)}
    for version in known:
        rows = Counter(r["a"] for r in snapshots.read_version(spark, folder, version).collect())
        assert rows == {i: i + 1 for i in range(version + 1)}
    assert snapshots.read_version(spark, folder).count() == 15
    # rows of a batch that did not commit are not seen
    spark.createDataFrame([(9, 9)], "a int, b int").write.parquet(f"{folder}/parts/5")
    assert snapshots.read_version(spark, folder).count() == 15
    with pytest.raises(ValueError, match="no such version"):
        snapshots.read_version(spark, folder, 77)


def test_blank_lines_count_when_asked_for(spark, tmp_path):
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "a.txt").write_text("x\n\n \ny\n")
    (tmp_path / "lines" / "b.txt").write_text("\nz")
    rows = positions.with_position(positions.text_rows(spark, str(tmp_path / "lines"), blank=True))
    got = sorted((r["position"], r["value"]) for r in rows.collect())
    assert got == [(0, "x"), (1, ""), (2, " "), (3, "y"), (4, ""), (5, "z")]
    rows = positions.with_position(positions.text_rows(spark, str(tmp_path / "lines")))
    assert sorted((r["position"], r["value"]) for r in rows.collect()) == [(0, "x"), (1, "y"), (2, "z")]


def test_constants_that_the_sql_shares_with_the_library():
    from tunetable.functions.text import WHITESPACE
    from tunetable.operators.bootstrap import REPLICATES
    from tunetable.operators.report import REVIEW_HEADER
    from tunetable.sources.inline import REVIEW_PROMPTS, SAMPLE_ANSWERS

    assert all(c.isspace() for c in WHITESPACE)
    assert set(WHITESPACE) == {chr(c) for c in range(0x110000) if chr(c).isspace()}
    assert REPLICATES == 1000 and REVIEW_HEADER.startswith("# Human Evaluation Benchmark\n\n")
    assert len(REVIEW_PROMPTS) == len(SAMPLE_ANSWERS) == 3
