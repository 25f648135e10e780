"""Corpus preparation: pairs of turns, formatting, filtering with reasons, funnel counts."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunetable.functions.prompts import DEFAULT_TEMPLATE, ChatTemplate, format_columns, render_turns
from tunetable.functions.quality import QualityRules, contains_any, passes, reject_reasons
from tunetable.functions.text import or_empty
from tunetable.operators.sampling import DEFAULT_SEED, sample_exact, split_exact, split_stable
from tunetable.session import written


SALTS = 8


def turn_pairs(conversations: DataFrame) -> DataFrame:
    """Each user turn with the assistant turn that follows it; ``sample_id`` is ``conv_id:turn``.

    Questions and answers are joined first, on (conv_id, turn), so a conversation of any length
    spreads over all tasks. The system texts, one row per conversation, are repeated over a few salts,
    so that the second join spreads as well. Several questions of one turn, or answers to it, are
    reduced to the smallest text, which keeps ``sample_id`` unique; the join needs that placement anyway.
    """
    users = (
        conversations.filter("role = 'user'")
        .groupBy("conv_id", "turn")
        .agg(F.min("text").alias("instruction"))
    )
    systems = (
        conversations.filter("role = 'system'")
        .groupBy("conv_id")
        .agg(F.max("text").alias("input"))
        .select("conv_id", "input", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    )
    answers = (
        conversations.filter("role = 'assistant'")
        .groupBy("conv_id", (F.col("turn") - 1).alias("turn"))
        .agg(F.min("text").alias("output"))
    )
    return (
        users.join(answers, ["conv_id", "turn"])
        .withColumn("salt", F.pmod(F.xxhash64("turn"), F.lit(SALTS)).cast("int"))
        .join(systems, ["conv_id", "salt"], "left")
        .select(
            F.concat_ws(":", "conv_id", "turn").alias("sample_id"),
            "conv_id",
            "turn",
            "instruction",
            or_empty("input").alias("input"),
            "output",
        )
    )


def format_rows(
    df: DataFrame,
    keep: tuple[str, ...] = (),
    renderer: Callable[..., dict[str, Column]] = format_columns,
) -> DataFrame:
    """Only the produced columns (plus ``keep``): instruction, input, output, text."""
    return df.select(*keep, *[c.alias(name) for name, c in renderer().items()])


def quality_filter(df: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    return df.filter(passes(rules))


def with_reject_reasons(df: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    return df.withColumn("reject_reasons", reject_reasons(rules))


def prepare(
    raw: DataFrame,
    key: str,
    max_samples: int | None = None,
    rules: QualityRules = QualityRules(),
    predicate: Column | None = None,
    renderer: Callable[..., dict[str, Column]] = format_columns,
    exact_split: bool = True,
    seed: int = DEFAULT_SEED,
) -> DataFrame:
    """Sample, format, filter and split: the whole preparation as one DataFrame.

    The sample is drawn before the filter, as in the original job, so fewer rows may remain. The
    conditions on raw columns are implied by the rules (stripping only shortens a text) and exist
    to reach the scan. ``predicate`` replaces the rules.
    """
    sampled = sample_exact(raw, max_samples, key, seed, write_keys=True)
    return _prepared(sampled, key, rules, predicate, renderer, exact_split, seed)


def prepare_stages(
    raw: DataFrame,
    key: str,
    max_samples: int | None = None,
    rules: QualityRules = QualityRules(),
    seed: int = DEFAULT_SEED,
) -> DataFrame:
    """(stage, n_rows) of one run of ``prepare``: raw, sampled, kept, and the two halves of the split."""
    sampled = sample_exact(raw, max_samples, key, seed, write_keys=True)
    split = _prepared(sampled, key, rules, None, format_columns, True, seed).select("split")
    split = written(split, "prepared")
    counts = [
        rows.agg(F.lit(stage).alias("stage"), F.count("*").alias("n_rows"))
        for stage, rows in (
            ("raw", raw),
            ("sampled", sampled),
            ("kept", split),
            ("train", split.filter("split = 'train'")),
            ("eval", split.filter("split = 'eval'")),
        )
    ]
    return reduce(DataFrame.unionByName, counts)


def _prepared(
    rows: DataFrame,
    key: str,
    rules: QualityRules,
    predicate: Column | None,
    renderer: Callable[..., dict[str, Column]],
    exact_split: bool,
    seed: int,
) -> DataFrame:
    if predicate is None:
        rows = rows.filter(
            (F.length("output") >= rules.min_output)
            & (F.length("instruction") >= rules.min_instruction)
            & contains_any("output", rules.markers)
        )
        predicate = passes(rules)
    kept = format_rows(rows, (key,), renderer).filter(predicate)
    if exact_split:
        return split_exact(kept, key, seed=seed, write_keys=True)
    return split_stable(kept, key, seed=seed)


def funnel(
    df: DataFrame, sampled: Column, kept: Column, split: Column, by: tuple[str, ...] = ()
) -> DataFrame:
    """Raw, sampled, kept, train and eval row counts in a single pass."""
    return df.groupBy(*by).agg(
        F.count("*").alias("n_raw"),
        F.count_if(sampled).alias("n_sampled"),
        F.count_if(sampled & kept).alias("n_kept"),
        F.count_if(sampled & kept & (split == "train")).alias("n_train"),
        F.count_if(sampled & kept & (split == "eval")).alias("n_eval"),
    )


def split_report(prepared: DataFrame) -> DataFrame:
    return prepared.groupBy("split").agg(
        F.count("*").alias("n_rows"),
        F.sum(F.length("text")).alias("text_chars"),
        F.sum(F.length("output")).alias("output_chars"),
        F.count_if(F.col("input") != "").alias("n_with_input"),
        F.max(F.length("text")).alias("max_text_chars"),
    )


def render_conversations(
    conversations: DataFrame, template: ChatTemplate = DEFAULT_TEMPLATE, block: int = 256
) -> DataFrame:
    """One training text per conversation, from its message rows.

    Blocks of turns are rendered first, so that a very long conversation is spread over tasks;
    a block that starts right after a system message loses its opening marker when joined.
    """
    message = F.struct("turn", "role", F.col("text").alias("content"))
    blocks = (
        conversations.groupBy("conv_id", F.floor(F.col("turn") / block).alias("block"))
        .agg(F.sort_array(F.collect_list(message)).alias("msgs"))
        .select(
            "conv_id",
            "block",
            F.size("msgs").alias("n_turns"),
            render_turns("msgs", template).alias("piece"),
            F.get("msgs", F.lit(0))["role"].alias("first_role"),
            F.element_at("msgs", -1)["role"].alias("last_role"),
        )
    )
    opening = len(template.open_instruction)

    def joined(parts: Column) -> Column:
        def piece(p: Column, i: Column) -> Column:
            continues = (F.get(parts, i - 1)["last_role"] == "system") & (
                p["first_role"].isin("system", "user")
            )
            return F.when(continues, F.substr(p["piece"], F.lit(opening + 1))).otherwise(p["piece"])

        return F.concat(F.lit(template.start), F.array_join(F.transform(parts, piece), ""))

    parts = F.sort_array(
        F.collect_list(F.struct("block", "piece", "first_role", "last_role", "n_turns"))
    )
    return (
        blocks.groupBy("conv_id")
        .agg(parts.alias("parts"), F.sum("n_turns").alias("n_turns"))
        .select("conv_id", "n_turns", joined(F.col("parts")).alias("text"))
    )


def preview(df: DataFrame, key: str, text: str = "text", chars: int = 200) -> DataFrame:
    """The first characters of each text with the column names of the table."""
    return df.select(
        key,
        F.lit(",".join(df.columns)).alias("columns"),
        F.substring(text, 1, chars).alias("head"),
    )
