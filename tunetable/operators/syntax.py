"""Python syntax checks over a column of generated answers. The code is parsed, never run."""

from __future__ import annotations

import ast
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tunetable.functions.text import as_column, extract_code, or_empty, strip

# The answer for blank code and the length above which an answer is checked.
EMPTY_MESSAGE = "Empty code provided"
MIN_CHECKED_CHARS = 5

CHECK_SCHEMA = T.StructType(
    [
        T.StructField("valid", T.BooleanType()),
        T.StructField("error", T.StringType()),
        T.StructField("line", T.IntegerType()),
    ]
)


def parse_result(code: str) -> tuple[bool, str | None, int | None]:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(code)
    except SyntaxError as e:
        return False, str(e.msg), e.lineno
    except Exception as e:  # e.g. null bytes or nesting beyond the parser's limits
        return False, str(e), None
    return True, None, None


@F.pandas_udf(CHECK_SCHEMA)
def _parse(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for codes in batches:
        distinct = {c: parse_result(c) for c in codes.dropna().unique()}
        checked = [distinct.get(c, (None, None, None)) for c in codes]
        out = pd.DataFrame(checked, columns=["valid", "error", "line"])
        yield out.astype({"valid": "boolean", "line": "Int32"})


# Otherwise a filter on its result would be pushed below the projection and parse every text again.
_parse = _parse.asNondeterministic()


def check(text: Column | str) -> Column:
    """Struct (valid, error, line) of an answer; the fence is removed natively before parsing."""
    given = strip(or_empty(text))
    # A conditional around a Python function would not skip rows, so blank rows go in as null.
    parsed = _parse(F.when(given != "", extract_code(text)))
    blank = F.struct(
        F.lit(False).alias("valid"),
        F.lit(EMPTY_MESSAGE).alias("error"),
        F.lit(None).cast("int").alias("line"),
    )
    return F.when(given == "", blank).otherwise(parsed)


def with_syntax(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``valid``, ``error``, ``line``."""
    return df.withColumn("_check", check(text)).select("*", "_check.*").drop("_check")


def checked_panels(streams: DataFrame, text: str = "text", done: str = "done") -> DataFrame:
    """Syntax status of finished answers of some length, with the message as displayed."""
    ready = streams.filter(F.col(done) & (F.length(text) > MIN_CHECKED_CHARS))
    line = F.coalesce(F.col("line").cast("string"), F.lit("undefined"))
    message = F.concat(F.lit("Line "), line, F.lit(": "), as_column("error"))
    return with_syntax(ready, text).withColumn("message", F.when(~F.col("valid"), message))


def validity_rate(checked: DataFrame, by: tuple[str, ...] = ("model",)) -> DataFrame:
    return checked.groupBy(*by).agg(
        F.count("*").alias("n_outputs"),
        F.count_if("valid").alias("n_valid"),
        F.avg(F.col("valid").cast("double")).alias("valid_share"),
    )


def frequent_errors(checked: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` most frequent error messages."""
    return (
        checked.filter(~F.col("valid"))
        .groupBy("error")
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "error")
        .limit(k)
    )
