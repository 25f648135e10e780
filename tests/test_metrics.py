import math
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tunetable.functions.stemmer import stem_word
from tunetable.operators import alignment, bleu, bootstrap, perplexity, report, rouge, sampling

PAIRS = [
    ("base", 1, "def add(a, b): return a + b", "def add(a, b): return a + b"),
    ("base", 2, "def add(a, b): return a + c", "def add(a, b): return a + b"),
    ("base", 3, "", "def add(a, b): return a + b"),
    ("base", 4, "def add", ""),
    ("base", 5, "", ""),
    ("base", 6, "the the the cat", "the cat the dog the the the"),
    ("ft", 1, "Returning the values, returned value.", "returns a value the valued returning"),
    ("ft", 2, "éte x-y 10 20 10 20 10 20", "10 20 10 éte 30 x y 20"),
    ("ft", 3, "totally different", "nothing shared here"),
]


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame(PAIRS, "model string, sample_id long, prediction string, reference string")


def tokens(s, stemmed):
    t = re.findall("[a-z0-9]+", s.lower())
    return [stem_word(w) if len(w) > 3 else w for w in t] if stemmed else t


def f_score(match, n_pred, n_ref):
    if not match:
        return 0.0
    p, r = match / n_pred, match / n_ref
    return 2 * p * r / (p + r)


def grams(t, n):
    return Counter(tuple(t[i : i + n]) for i in range(len(t) - n + 1))


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def expected_rouge(pred, ref, stemmed):
    p, r = tokens(pred, stemmed), tokens(ref, stemmed)
    out = []
    for n in (1, 2):
        gp, gr = grams(p, n), grams(r, n)
        out.append(f_score((gp & gr).total(), gp.total(), gr.total()))
    return (*out, f_score(lcs(p, r), len(p), len(r)))


@pytest.mark.parametrize("stemmed", [False, True])
def test_rouge_against_brute_force(pairs, stemmed):
    n = {(r["model"], r["sample_id"]): r for r in rouge.rouge_n(pairs, use_stemmer=stemmed).collect()}
    long = {(r["model"], r["sample_id"]): r for r in rouge.rouge_l(pairs, use_stemmer=stemmed).collect()}
    assert len(n) == len(long) == len(PAIRS)
    for model, i, pred, ref in PAIRS:
        got = (n[model, i]["rouge1"], n[model, i]["rouge2"], long[model, i]["rougeL"])
        assert got == pytest.approx(expected_rouge(pred, ref, stemmed))
    assert n["base", 1]["rouge1"] == 1.0 and 0 < n["base", 2]["rouge1"] < 1


words = st.lists(st.sampled_from("abcd"), max_size=40)


@settings(max_examples=300)
@given(words, words)
def test_lcs_length(a, b):
    assert rouge.lcs_length(a, b) == lcs(a, b) == rouge.lcs_length(b, a)


def mt_tokens(s):
    for x, y in (("&quot;", '"'), ("&amp;", "&")):
        s = s.replace(x, y)
    s = re.sub(r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 ", f" {s} ")
    s = re.sub(r"([^0-9])([\.,])", r"\1 \2 ", s)
    s = re.sub(r"([\.,])([^0-9])", r" \1 \2", s)
    return re.sub(r"([0-9])(-)", r"\1 \2 ", s).split()


def expected_bleu(rows):
    match, total, sys_len, ref_len = [0] * 4, [0] * 4, 0, 0
    for _, _, pred, ref in rows:
        p, r = mt_tokens(pred), mt_tokens(ref)
        sys_len, ref_len = sys_len + len(p), ref_len + len(r)
        for n in range(4):
            gp, gr = grams(p, n + 1), grams(r, n + 1)
            match[n] += (gp & gr).total()
            total[n] += gp.total()
    if not any(match) or not total[3]:
        return 0.0
    smooth, logs = 1.0, 0.0
    for m, t in zip(match, total):
        if m == 0:
            smooth *= 2
        logs += math.log(100.0 * m / t if m else 100.0 / (smooth * t))
    penalty = math.exp(1 - ref_len / sys_len) if sys_len < ref_len else 1.0
    return penalty * math.exp(logs / 4)


def test_bleu_against_brute_force(pairs):
    got = {r["model"]: r["bleu"] for r in bleu.corpus_bleu(bleu.bleu_counts(pairs)).collect()}
    for model in ("base", "ft"):
        rows = [p for p in PAIRS if p[0] == model]
        assert got[model] == pytest.approx(expected_bleu(rows))


def test_bleu_extremes(spark):
    rows = [("same", 1, "a b c d e", "a b c d e"), ("short", 1, "a b c", "a b c"), ("none", 1, "x y z w", "a b c d")]
    df = spark.createDataFrame(rows, "model string, sample_id long, prediction string, reference string")
    got = {r["model"]: r["bleu"] for r in bleu.corpus_bleu(bleu.bleu_counts(df)).collect()}
    assert got == pytest.approx({"same": 100.0, "short": 0.0, "none": 0.0})


def test_report_is_one_pass_and_equals_the_single_metrics(pairs):
    one = {r["model"]: r for r in report.text_scores(pairs, use_stemmer=True).collect()}
    for model in ("base", "ft"):
        rows = [p for p in PAIRS if p[0] == model]
        scores = [expected_rouge(p, r, True) for _, _, p, r in rows]
        for k, name in enumerate(("rouge1", "rouge2", "rougeL")):
            assert one[model][name] == pytest.approx(sum(s[k] for s in scores) / len(rows), abs=1e-4)
        assert one[model]["bleu"] == pytest.approx(expected_bleu(rows), abs=1e-4)
        mean = sum(len(p.split()) for _, _, p, _ in rows) / len(rows)
        assert one[model]["avg_response_length"] == pytest.approx(mean, abs=0.051)
        assert one[model]["num_samples"] == len(rows)


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning")


def test_report_shuffles_pairs_once(pairs):
    assert exchanges(report.text_scores(pairs)) == 2  # the pairs, then a few rows per model
    assert exchanges(rouge.rouge_n(pairs)) == 1
    assert exchanges(rouge.rouge_l(pairs)) == 0


def test_registered_metric(pairs):
    report.register_metric(
        "exact",
        lambda p: p.groupBy("model").agg(F.avg((F.col("prediction") == F.col("reference")).cast("double")).alias("value"))
        .select("model", F.lit("exact").alias("metric"), "value"),
    )
    try:
        out = report.evaluate(pairs, ("text", "exact"), columns=("rouge1", "exact", "num_samples"))
        row = out.filter("model = 'base'").first()
        assert row["exact"] == pytest.approx(2 / 6) and row["num_samples"] == 6
        whole = report.evaluate(pairs, ("text", "exact")).filter("model = 'base'").first()
        assert whole["exact"] == row["exact"] and whole["rouge2"] is not None
    finally:
        del report.METRICS["exact"], report.METRIC_COLUMNS["exact"]


def test_no_metric_is_lost(spark, pairs):
    row = report.evaluate(pairs, ("text", "rouge_bootstrap")).filter("model = 'base'").first()
    assert row["rouge1_bootstrap"] is not None and row["rouge2_bootstrap"] is not None
    extra = spark.createDataFrame([("base", "surprise", 1.0)], "model string, metric string, value double")
    with pytest.raises(Exception, match="surprise"):
        report.evaluate(pairs, extra=extra).collect()


@pytest.mark.parametrize("n", [1, 3, 7])
def test_bootstrap_of_a_few_rows(spark, n):
    for seed in (1, 2, 3):
        df = spark.createDataFrame([("m", i, 0.25 * i) for i in range(n)], "model string, sample_id long, s double")
        row = bootstrap.bootstrap(df, ("s",), "sample_id", seed=seed).collect()[0]
        assert 0 <= row["low"] <= row["mid"] <= row["high"] <= 0.25 * (n - 1)
        assert 500 < row["n_replicates"] <= 1000 and (n > 1 or row["n_replicates"] < 700)


def test_compare_and_long(spark):
    schema = "model string, rouge1 double, rouge2 double, rougeL double, bleu double, perplexity double, avg_response_length double, num_samples long"
    rep = spark.createDataFrame([("base", 0.314, 0.134, None, None, 12.5, 58.7, 20)], schema)
    rows = {r["metric"]: r for r in report.metric_compare(rep).collect()}
    assert rows["ROUGE-1"]["base"] == 0.314 and rows["ROUGE-1"]["base_percent"] == "31.4%"
    assert rows["ROUGE-L"]["base"] == 0.0 and rows["ROUGE-1"]["finetuned"] == 0.0
    assert {r["key"] for r in report.metric_long(rep).collect()} == {
        f"base/{k}" for k in ("rouge1", "rouge2", "perplexity", "avg_response_length", "num_samples")
    }


def test_alignment_keeps_predictions_and_reports_missing_references(spark):
    preds = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k long, prediction string")
    refs = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z"), (9, "w")], "k long, reference string")
    out = alignment.align(preds, refs, ["k"])
    assert {(r["k"], r["reference"]) for r in out.collect()} == {(1, "x"), (2, "z"), (3, None)}
    assert tuple(alignment.alignment_counts(out).first()) == (3, 2, 1)


def test_side_by_side_takes_the_first_answer(spark):
    rows = [(1, "base", "late", 2), (1, "base", "early", 1), (1, "ft", "f", 1), (2, "ft", "g", 1)]
    df = spark.createDataFrame(rows, "k long, model string, prediction string, n int")
    out = alignment.side_by_side(df, "k", ("base", "ft"), order=F.col("n")).collect()
    assert {tuple(r) for r in out} == {(1, "early", "f"), (2, None, "g")}


def test_perplexity(spark):
    rows = [(1, 1.0), (1, 3.0), (2, 1.0), (3, 0.0)]
    nll = spark.createDataFrame(rows, "t long, nll double")
    assert perplexity.perplexity(nll, "t").first()["perplexity"] == pytest.approx(math.exp(1.0))
    assert perplexity.perplexity(nll.filter("false"), "t").first()["perplexity"] == 1.0
    kept = perplexity.first_texts(nll, "t", 2)
    assert kept.count() == 3


@pytest.mark.parametrize("limit", [None, 3])
def test_unigram_perplexity_against_brute_force(spark, limit):
    docs = [("train", "a b a c"), ("train", "b b"), ("eval", "a z a"), ("eval", "c b y y y"), ("train", "")]
    df = spark.createDataFrame(docs, "split string, text string")
    cut = [(s, t.split()[:limit]) for s, t in docs]
    vocab = Counter(w for s, t in cut if s == "train" for w in t)
    size = vocab.total() + len(vocab) + 1
    means = [sum(math.log(size / (vocab[w] + 1)) for w in t) / len(t) for s, t in cut if s == "eval"]
    row = perplexity.unigram_perplexity(df, max_tokens=limit).first()
    assert row["perplexity"] == pytest.approx(math.exp(sum(means) / len(means)))
    assert (row["vocabulary"], row["n_texts"]) == (len(vocab) + 1, 2)


def test_bootstrap(spark):
    df = spark.createDataFrame([("m", i, (i % 10) / 10) for i in range(500)], "model string, sample_id long, s double")
    run = lambda d, **k: bootstrap.bootstrap(d, ("s",), "sample_id", **k).first()
    row = run(df)
    assert row["low"] < row["mid"] < row["high"]
    assert row["mid"] == pytest.approx(0.45, abs=0.01)
    # 2.5 % .. 97.5 % of the mean of 500 values with deviation 0.287: about 0.05 wide
    assert row["high"] - row["low"] == pytest.approx(2 * 1.96 * 0.2872 / math.sqrt(500), rel=0.15)
    again = run(df.repartition(7))
    assert again["low"] == pytest.approx(row["low"]) and again["high"] == pytest.approx(row["high"])
    assert run(df, seed=7)["low"] != row["low"]


def test_poisson_thresholds_are_the_distribution():
    t = bootstrap.poisson_thresholds()
    mean = sum(1 - x / bootstrap.LEVELS for x in t)
    assert mean == pytest.approx(1.0, abs=1e-3)


def test_review_report(spark):
    rows = [(30, "p3", "c3"), (10, "p1", "c1"), (20, "p2", "c2")]
    df = spark.createDataFrame(rows, "k long, prompt string, generated_code string")
    out = sorted(report.review_report(df, "k").collect(), key=lambda r: r["number"])
    assert [(r["k"], r["number"]) for r in out] == [(10, 1), (20, 2), (30, 3)]
    assert out[0]["block"].startswith("# Human Evaluation Benchmark\n\nReview")
    assert out[1]["block"].startswith("## Problem 2\n**Prompt:**\n```text\np2\n```\n\n")
    assert out[2]["block"].count("- [ ]") == 4


def test_grams_never_become_rows(pairs):
    """What leaves a pair is a few numbers: no gram is generated, sorted or aggregated as a row."""
    for df in (report.text_scores(pairs), rouge.rouge_n(pairs), bleu.bleu_counts(pairs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Generate" not in plan and "gram#" not in plan


@settings(max_examples=200)
@given(words, words)
def test_overlap_of_a_pair(a, b):
    want = []
    for n in (1, 2, 3, 4):
        x, y = grams(a, n), grams(b, n)
        want += [(x & y).total(), x.total(), y.total()]
    assert rouge.overlap(" ".join(a), " ".join(b), (1, 2, 3, 4)) == want
