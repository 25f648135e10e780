"""Report formatting: percentages, exponents, fixed decimals, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tunetable.functions.text import as_column


def percent(c: Column | str, decimals: int = 1) -> Column:
    return F.format_string(f"%.{decimals}f%%", F.round(as_column(c) * 100, decimals))


def fixed(c: Column | str, decimals: int = 4) -> Column:
    return F.format_string(f"%.{decimals}f", F.round(as_column(c), decimals))


def exponent(c: Column | str, decimals: int = 2) -> Column:
    """Scientific notation with an unpadded exponent, e.g. ``2.00e-4``."""
    return F.regexp_replace(
        F.format_string(f"%.{decimals}e", as_column(c)), r"e([+-])0+(\d)", "e$1$2"
    )


def js_round(c: Column | str) -> Column:
    """Round half up towards positive infinity."""
    return F.floor(as_column(c) + 0.5)


def is_flagged(note: Column | str) -> Column:
    """A document that carries a non-empty note."""
    return F.length(F.coalesce(as_column(note), F.lit(""))) > 0
