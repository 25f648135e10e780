import math

import pytest
from pyspark.sql import functions as F

from tunetable.functions import prompts, quality
from tunetable.operators import prep, sampling

PAD = " " * 30
GOOD = ("Write a python function", "def my_func():\n    return 42" + PAD, "small text")


def kept(spark, row, max_chars=100):
    df = spark.createDataFrame([row], "instruction string, output string, text string")
    rules = quality.QualityRules(max_chars=max_chars)
    n = prep.quality_filter(df, rules).count()
    reasons = prep.with_reject_reasons(df, rules).first()["reject_reasons"]
    assert (n == 1) == (reasons == [])
    return n == 1, reasons


def test_filter_accepts_a_good_row(spark):
    assert kept(spark, GOOD)[0]


def test_filter_rejects_long_text(spark):
    assert kept(spark, (GOOD[0], GOOD[1], "a" * 150)) == (False, ["too_long"])
    assert kept(spark, (GOOD[0], GOOD[1], "a" * 100)) == (False, ["too_long"])  # strict
    assert kept(spark, (GOOD[0], GOOD[1], "a" * 99))[0]


def test_filter_rejects_prose(spark):
    prose = "This is just english text with no python code." + PAD
    assert kept(spark, (GOOD[0], prose, "small text")) == (False, ["no_marker"])


def test_budget_applies_whatever_marker_is_found(spark):
    assert kept(spark, (GOOD[0], "x = 5" + PAD, "a" * 150)) == (False, ["too_long"])


def test_null_fields_fail(spark):
    assert kept(spark, (None, None, None)) == (
        False,
        ["short_instruction", "short_output", "too_long", "no_marker"],
    )


def test_format_rows(spark):
    df = spark.createDataFrame(
        [(" do it ", None, " x "), ("a", "", None), ("a", " ", "b")],
        "instruction string, input string, output string",
    )
    rows = prep.format_rows(df).collect()
    head = "<s>[INST] " + prompts.SYSTEM_PROMPT + "\n\n"
    assert [r["text"] for r in rows] == [
        head + "do it[/INST] x</s>",
        head + "a[/INST] </s>",
        head + "a\n\nInput:\n [/INST] b</s>",
    ]
    assert [r["input"] for r in rows] == ["", "", " "]


def test_alpaca_parse(spark):
    full = "### Instruction:\nQ\n\n### Response:\nA"
    df = spark.createDataFrame([(full,), ("plain",), (full + "### Response:\nmore",)], "text string")
    columns = prompts.parse_alpaca("text")
    rows = df.select(*[c.alias(n) for n, c in columns.items()]).collect()
    assert [(r["instruction"], r["expected"], r["has_marker"]) for r in rows] == [
        ("Q", "A", True),
        ("plain### Response:\n", "", False),
        ("Q", "A", True),
    ]


def test_conversations_are_rendered_the_same_in_blocks_of_any_size(spark):
    turns = [(1, 0, "system", "S"), (1, 1, "user", "u1"), (1, 2, "assistant", "a1"),
             (1, 3, "system", "T"), (1, 4, "user", "u2"), (1, 5, "assistant", "a2"), (2, 0, "user", "q")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    expected = {
        1: "<s>[INST] S\n\nu1[/INST] a1</s>[INST] T\n\nu2[/INST] a2</s>",
        2: "<s>[INST] q[/INST]",
    }
    for block in (1, 2, 3, 4, 256):
        rows = prep.render_conversations(df, block=block).collect()
        assert {r["conv_id"]: r["text"] for r in rows} == expected


@pytest.fixture(scope="module")
def numbered(spark):
    return spark.range(2000).withColumnRenamed("id", "doc_id")


def in_hash_order(spark, df, seed=42):
    rows = df.select("doc_id", sampling.hash_order("doc_id", seed).alias("h")).collect()
    return [r["doc_id"] for r in sorted(rows, key=lambda r: (r["h"], r["doc_id"]))]


def test_sample_is_the_start_of_the_hash_order(spark, numbered, monkeypatch):
    order = in_hash_order(spark, numbered)
    for ranked in (50_000, 0):  # 0 forces the refinement down to single digests
        monkeypatch.setattr(sampling, "RANKED_ROWS", ranked)
        for n in (1, 777, 1999):
            got = sampling.sample_exact(numbered, n, "doc_id").collect()
            assert {r["doc_id"] for r in got} == set(order[:n])
            if ranked == 0:
                break
    stored = sampling.sample_exact(numbered, 777, "doc_id", write_keys=True).collect()
    assert {r["doc_id"] for r in stored} == set(order[:777])


def test_sample_is_a_no_op_without_or_beyond_a_size(spark, numbered):
    for n in (None, 0, 2000, 5000):
        assert sampling.sample_exact(numbered, n, "doc_id").count() == 2000


def test_sample_depends_on_the_seed_but_not_on_partitioning(spark, numbered):
    pick = lambda df, seed: {r["doc_id"] for r in sampling.sample_exact(df, 100, "doc_id", seed).collect()}
    assert pick(numbered, 42) == pick(numbered.repartition(13), 42)
    assert pick(numbered, 42) != pick(numbered, 43)


@pytest.mark.parametrize("write_keys", [False, True])
def test_exact_split(spark, numbered, write_keys):
    df = numbered.limit(1990)
    split = sampling.split_exact(df, "doc_id", write_keys=write_keys)
    train, held = split.filter("split = 'train'"), split.filter("split = 'eval'")
    assert held.count() == math.ceil(0.05 * 1990) and train.count() + held.count() == 1990
    assert train.join(held, "doc_id", "left_anti").count() == train.count()
    assert sampling.split_exact(df.filter("false"), "doc_id").count() == 0


def test_stable_split_keeps_membership_when_rows_are_added(spark, numbered):
    member = lambda df: {r["doc_id"]: r["split"] for r in sampling.split_stable(df, "doc_id").collect()}
    small, large = member(numbered.filter("doc_id < 900")), member(numbered)
    assert all(large[k] == v for k, v in small.items())
    assert 50 < sum(v == "eval" for v in large.values()) < 150


def test_ordered_index_with_an_outlier_key(spark):
    keys = [*range(3000), 10**15]
    df = spark.createDataFrame([(k * 7 % 3001 if k < 3000 else k,) for k in keys], "k long")
    rows = sampling.row_index_ordered(df.distinct(), "k").collect()
    by_key = sorted(rows, key=lambda r: r["k"])
    assert [r["row_index"] for r in by_key] == list(range(len(rows)))


def test_batches(spark, numbered):
    batches = sampling.assign_batches(numbered, "doc_id", batch_size=4)
    sizes = {r["batch_id"]: r["count"] for r in batches.groupBy("batch_id").count().collect()}
    assert sizes == {b: 16 for b in range(125)}
    order = in_hash_order(spark, numbered)
    first = {r["doc_id"] for r in batches.filter("batch_id = 0").collect()}
    assert first == set(order[:16])


def test_prepare_samples_before_it_filters(spark):
    good, bad = "def my_func(values):\n    return sum(values)", "prose only, without any of the markers in it"
    rows = [(i, GOOD[0], None, good if i % 2 else bad) for i in range(200)]
    raw = spark.createDataFrame(rows, "id long, instruction string, input string, output string")
    out = prep.prepare(raw, "id", max_samples=100)
    sampled = {r["id"] for r in sampling.sample_exact(raw, 100, "id").collect()}
    assert {r["id"] for r in out.collect()} == {i for i in sampled if i % 2}
    assert out.columns == ["id", "instruction", "input", "output", "text", "split"]


def test_pairs_of_long_conversation(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"t{t}") for t in range(400)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = prep.turn_pairs(df).collect()
    assert {(r["instruction"], r["output"]) for r in got} == {(f"t{t}", f"t{t+1}") for t in range(0, 400, 2)}


def test_pair_keys_do_not_collide(spark):
    rows = [(1, 1001, "user", "a"), (1, 1002, "assistant", "b"), (2, 1, "user", "c"), (2, 2, "assistant", "d"),
            (2, 2, "assistant", "e"), (2, 0, "system", "s")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["sample_id"]: (r["instruction"], r["input"], r["output"]) for r in prep.turn_pairs(df).collect()}
    assert got == {"1:1001": ("a", "", "b"), "2:1": ("c", "s", "d")}


def test_null_keys_are_sampled_and_batched(spark):
    df = spark.createDataFrame([(None,), ("a",), ("b",), ("c",)], "k string")
    for n in (1, 2, 3):
        assert sampling.sample_exact(df, n, "k").count() == n
    assert sampling.assign_batches(df, "k", 1).filter("batch_id = 0").count() == 4
    ordered = sampling.row_index_ordered(df, "k").orderBy("row_index").collect()
    assert [(r["k"], r["row_index"]) for r in ordered] == [(None, 0), ("a", 1), ("b", 2), ("c", 3)]


def test_stage_counts(spark):
    good, bad = "def my_func(values):\n    return sum(values)", "prose only, without any of the markers in it"
    rows = [(i, GOOD[0], None, good if i % 2 else bad) for i in range(200)]
    raw = spark.createDataFrame(rows, "id long, instruction string, input string, output string")
    counts = {r["stage"]: r["n_rows"] for r in prep.prepare_stages(raw, "id", max_samples=100).collect()}
    kept = prep.prepare(raw, "id", max_samples=100).count()
    assert counts["raw"] == 200 and counts["sampled"] == 100 and counts["kept"] == kept
    assert counts["train"] + counts["eval"] == kept


def test_funnel(spark, numbered):
    flagged = sampling.split_stable(numbered, "doc_id")
    row = prep.funnel(flagged, F.col("doc_id") < 1000, F.col("doc_id") % 2 == 0, F.col("split")).first()
    assert (row["n_raw"], row["n_sampled"], row["n_kept"]) == (2000, 1000, 500)
    assert row["n_train"] + row["n_eval"] == 500


def test_repeated_turns_give_one_pair(spark):
    rows = [
        (1, 0, "user", "b"), (1, 0, "user", "a"), (1, 1, "assistant", "y"), (1, 1, "assistant", "x"),
        (2, 0, "user", None), (2, 1, "assistant", "z"), (3, 0, "user", "alone"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    got = {r["sample_id"]: (r["instruction"], r["input"], r["output"]) for r in prep.turn_pairs(df).collect()}
    assert got == {"1:0": ("a", "", "x"), "2:0": (None, "", "z")}
    assert prep.turn_pairs(df).count() == 2
