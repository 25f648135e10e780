"""One report row per model, its long and compared forms, and the review document."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunetable.functions.formats import percent
from tunetable.functions.text import or_empty, word_count
from tunetable.operators.bleu import SCHEME as BLEU_SCHEME
from tunetable.operators.bleu import bleu_score, corpus_sums, mt_columns
from tunetable.operators.bootstrap import bootstrap
from tunetable.operators.rouge import (
    KEYS,
    f_measure,
    gram_matches,
    normalized,
    placed,
    rouge_n,
    rouge_n_score,
    rouge_scheme,
    with_lcs,
)
from tunetable.operators.sampling import row_index_ordered

Metric = Callable[[DataFrame], DataFrame]

# Metric order, chart labels and target of the comparison.
REPORT_METRICS = ("rouge1", "rouge2", "rougeL", "bleu", "perplexity", "avg_response_length")
CHART_LABELS = {"rouge1": "ROUGE-1", "rouge2": "ROUGE-2", "rougeL": "ROUGE-L"}
MODEL_LABELS = {"base": "Base", "finetuned": "Fine-tuned"}
TARGET = 0.5


def long_form(df: DataFrame, names: tuple[str, ...], by: tuple[str, ...] = ("model",)) -> DataFrame:
    return df.unpivot(
        list(by), [F.col(n).cast("double").alias(n) for n in names], "metric", "value"
    )


def text_scores(
    pairs: DataFrame,
    use_stemmer: bool = True,
    decimals: int = 4,
    keys: tuple[str, ...] = KEYS,
) -> DataFrame:
    """ROUGE-1/2/L, BLEU, mean length and sample count of every model in one plan.

    Both tokenisations, the matches and the subsequence length are found where a pair is. Only the numbers of a
    pair cross the network, placed by ``keys``, and one aggregation per model finishes every metric. Pairs with
    equal keys count one by one.
    """
    texts = normalized(pairs, (*keys, "prediction", "reference"), use_stemmer)
    n_words = word_count(or_empty("prediction")).alias("n_words")
    texts = with_lcs(texts.select(*keys, "pred", "ref", n_words, *mt_columns()))
    schemes = (rouge_scheme(), BLEU_SCHEME)
    pair = placed(gram_matches(texts, keys, schemes, carry=("n_words", "lcs")), keys)
    lcs_score = f_measure(F.col("lcs"), F.col("rouge_pred_1"), F.col("rouge_ref_1"))
    sums = pair.groupBy("model").agg(
        F.avg(rouge_n_score(1)).alias("rouge1"),
        F.avg(rouge_n_score(2)).alias("rouge2"),
        F.avg(lcs_score).alias("rougeL"),
        F.avg("n_words").alias("avg_response_length"),
        F.count("*").alias("num_samples"),
        *corpus_sums(),
    )
    return sums.select(
        "model",
        *[F.round(c, decimals).alias(c) for c in ("rouge1", "rouge2", "rougeL")],
        F.round(bleu_score(), decimals).alias("bleu"),
        F.round("avg_response_length", 1).alias("avg_response_length"),
        "num_samples",
    )


def _text_metrics(use_stemmer: bool) -> Metric:
    names = ("rouge1", "rouge2", "rougeL", "bleu", "avg_response_length", "num_samples")
    return lambda pairs: long_form(text_scores(pairs, use_stemmer), names)


def _rouge_bootstrap(pairs: DataFrame) -> DataFrame:
    """Median of the resampled ROUGE-1/2 means instead of the plain mean, unstemmed."""
    names = ("rouge1", "rouge2")
    medians = bootstrap(rouge_n(pairs), names, "sample_id").withColumnRenamed("mid", "value")
    return medians.select("model", F.concat("metric", F.lit("_bootstrap")).alias("metric"), "value")


# Registered metrics: prediction pairs -> (model, metric, value) rows.
METRICS: dict[str, Metric] = {
    "text": _text_metrics(use_stemmer=True),
    "text_unstemmed": _text_metrics(use_stemmer=False),
    "rouge_bootstrap": _rouge_bootstrap,
}
# Columns that a metric adds to the report beside the usual ones.
METRIC_COLUMNS: dict[str, tuple[str, ...]] = {
    "text": (),
    "text_unstemmed": (),
    "rouge_bootstrap": ("rouge1_bootstrap", "rouge2_bootstrap"),
}


def register_metric(name: str, metric: Metric, columns: tuple[str, ...] | None = None) -> None:
    """Makes a user metric available to ``evaluate`` by name; its rows use its name unless told."""
    METRICS[name] = metric
    METRIC_COLUMNS[name] = (name,) if columns is None else columns


def evaluate(
    pairs: DataFrame,
    metrics: tuple[str, ...] = ("text",),
    extra: DataFrame | None = None,
    columns: tuple[str, ...] | None = None,
) -> DataFrame:
    """One row per model with one column per metric.

    ``extra`` holds further (model, metric, value) rows, such as perplexities measured elsewhere.
    The parts are united in long form and turned once, so no join depends on the number of metrics.
    The columns are the usual ones and those that the chosen metrics declare; a row of any other
    metric is an error, not a loss. ``columns`` selects some of them instead.
    """
    chosen = columns
    if columns is None:
        declared = (c for m in metrics for c in METRIC_COLUMNS[m])
        columns = tuple(dict.fromkeys((*REPORT_METRICS, "num_samples", *declared)))
    parts = [METRICS[m](pairs) for m in metrics]
    if extra is not None:
        parts.append(extra.select("model", "metric", F.col("value").cast("double").alias("value")))
    rows = reduce(DataFrame.unionByName, parts)
    if chosen is None:
        unknown = F.raise_error(F.concat(F.lit("no report column for metric "), F.col("metric")))
        known = F.when(F.col("metric").isin(*columns), F.col("metric")).otherwise(unknown)
        rows = rows.withColumn("metric", known)
    wide = rows.groupBy("model").pivot("metric", list(columns)).agg(F.first("value"))
    return wide.withColumn("num_samples", F.col("num_samples").cast("long"))


def metric_long(report: DataFrame, names: tuple[str, ...] = REPORT_METRICS) -> DataFrame:
    """Key-value rows ``model/metric`` of all numeric report fields that are present."""
    rows = long_form(report, (*names, "num_samples")).filter("value is not null")
    return rows.select(F.concat_ws("/", "model", "metric").alias("key"), "value")


def first_record(results: DataFrame, order: str) -> DataFrame:
    """The first record of each model in input order."""
    fields = [c for c in results.columns if c not in ("model", order)]
    first = F.min(F.struct(order, *fields)).alias("r")
    return results.groupBy("model").agg(first).select("model", *[F.col(f"r.{f}") for f in fields])


def metric_compare(
    report: DataFrame,
    labels: dict[str, str] = CHART_LABELS,
    models: dict[str, str] = MODEL_LABELS,
    target: float = TARGET,
) -> DataFrame:
    """Metrics as rows and models as columns; missing values are 0."""
    rows = long_form(report, tuple(labels))
    wide = rows.groupBy("metric").pivot("model", list(models)).agg(F.first("value"))
    label = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])[F.col("metric")]
    values = {m: F.round(F.coalesce(F.col(m), F.lit(0.0)), 4) for m in models}
    return wide.select(
        label.alias("metric"),
        *[v.alias(m) for m, v in values.items()],
        *[percent(v).alias(f"{m}_percent") for m, v in values.items()],
        *[(v >= target).alias(f"{m}_on_target") for m, v in values.items()],
    )


def metrics_document(report: DataFrame, eval_samples: Column, note: str | None = None) -> DataFrame:
    """The whole report as one nested record; it has one element per model."""
    fields = [c for c in report.columns]
    doc = report.agg(
        F.array_sort(F.collect_list(F.struct(*fields))).alias("results"),
        eval_samples.cast("long").alias("eval_samples"),
    )
    return doc if note is None else doc.withColumn("note", F.lit(note))


# The wording of the review document.
REVIEW_HEADER = (
    "# Human Evaluation Benchmark\n\nReview the generated code for the following problems.\n\n"
)
REVIEW_BLOCK = (
    "## Problem %d\n**Prompt:**\n```text\n%s\n```\n\n**Generated Code:**\n```python\n%s\n```\n\n"
)
REVIEW_RUBRIC = (
    "### Rubric\n"
    "- [ ] **Correctness:** Does the code solve the problem accurately?\n"
    "- [ ] **Readability:** Is the code clean, well-structured, and idiomatic?\n"
    "- [ ] **Efficiency:** Is the approach optimal in terms of time and space complexity?\n"
    "- [ ] **Documentation:** Are there appropriate docstrings, type hints, and comments?\n\n"
)


def review_report(problems: DataFrame, key: str) -> DataFrame:
    """Numbered Markdown blocks (``number``, ``block``) in key order; number 1 has the header."""
    numbered = row_index_ordered(problems, key, "_index").withColumn(
        "number", F.col("_index") + 1
    )
    block = F.concat(
        F.when(F.col("number") == 1, REVIEW_HEADER).otherwise(""),
        F.format_string(REVIEW_BLOCK, "number", "prompt", "generated_code"),
        F.lit(REVIEW_RUBRIC),
    )
    return numbered.select(key, "number", block.alias("block"))
