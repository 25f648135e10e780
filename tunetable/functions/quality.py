"""Quality rules for instruction rows and constraint rules for generation requests."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tunetable.functions.text import as_column

# Limits and markers of the default filter.
MIN_INSTRUCTION_CHARS = 10
MIN_OUTPUT_CHARS = 30
CODE_MARKERS = ("def ", "class ", "import ", "=")
CHARS_PER_TOKEN = 4
DEFAULT_MAX_TOKENS = 1024


@dataclass(frozen=True)
class QualityRules:
    markers: tuple[str, ...] = CODE_MARKERS
    max_chars: int = DEFAULT_MAX_TOKENS * CHARS_PER_TOKEN
    min_instruction: int = MIN_INSTRUCTION_CHARS
    min_output: int = MIN_OUTPUT_CHARS


def contains_any(c: Column | str, markers: tuple[str, ...]) -> Column:
    """OR chain of ``contains``: unlike an array predicate it reaches the Parquet scan."""
    col = as_column(c)
    return reduce(lambda a, b: a | b, [col.contains(m) for m in markers])


def rule_failures(rules: QualityRules = QualityRules()) -> dict[str, Column]:
    """Reason -> boolean 'this row breaks the rule' over instruction, output and text."""
    return {
        "short_instruction": ~F.coalesce(
            F.length("instruction") >= rules.min_instruction, F.lit(False)
        ),
        "short_output": ~F.coalesce(F.length("output") >= rules.min_output, F.lit(False)),
        "too_long": ~F.coalesce(F.length("text") < rules.max_chars, F.lit(False)),
        "no_marker": ~F.coalesce(contains_any("output", rules.markers), F.lit(False)),
    }


def passes(rules: QualityRules = QualityRules()) -> Column:
    """Cheap length checks first, then the marker search; a null field fails the row."""
    return (
        (F.length("instruction") >= rules.min_instruction)
        & (F.length("output") >= rules.min_output)
        & (F.length("text") < rules.max_chars)
        & contains_any("output", rules.markers)
    )


def reject_reasons(rules: QualityRules = QualityRules()) -> Column:
    return F.array_compact(
        F.array(*[F.when(bad, name) for name, bad in rule_failures(rules).items()])
    )


# Request limits and defaults.
PROMPT_CHARS = (1, 4096)
MAX_TOKENS_RANGE = (64, 2048)
DEFAULT_REQUEST_TOKENS = 512
TEMPERATURE_RANGE = (0.1, 1.5)
DEFAULT_TEMPERATURE = 0.7


def request_columns() -> dict[str, Column]:
    """Defaults applied to the optional request fields."""
    return {
        "max_tokens": F.coalesce(F.col("max_tokens"), F.lit(DEFAULT_REQUEST_TOKENS)),
        "temperature": F.coalesce(F.col("temperature"), F.lit(DEFAULT_TEMPERATURE)),
    }


def request_violations() -> Column:
    """Names of the violated request constraints; evaluate after the defaults are applied."""
    prompt_ok = F.coalesce(F.length("prompt").between(*PROMPT_CHARS), F.lit(False))
    return F.array_compact(
        F.array(
            F.when(~prompt_ok, "prompt"),
            F.when(~F.col("max_tokens").between(*MAX_TOKENS_RANGE), "max_tokens"),
            F.when(~F.col("temperature").between(*TEMPERATURE_RANGE), "temperature"),
        )
    )
