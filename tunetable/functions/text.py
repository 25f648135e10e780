"""Text normalisation and tokenisation as native Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters a Unicode-aware whitespace strip removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

NON_SPACE_RUN = r"(?U)[^\s\x1c-\x1f]+"
ALNUM_RUN = "[a-z0-9]+"

# The international "13a" tokenisation rules published with the mteval script,
# (pattern, replacement) in the order in which they apply.
MT13A_RULES = (
    ("<skipped>", ""),
    ("-\n", ""),
    ("\n", " "),
    ("&quot;", '"'),
    ("&amp;", "&"),
    ("&lt;", "<"),
    ("&gt;", ">"),
)
MT13A_PATTERNS = (
    (r"([{-~\[-` -&(-+:-@/])", " $1 "),
    (r"([^0-9])([.,])", "$1 $2 "),
    (r"([.,])([^0-9])", " $1 $2"),
    (r"([0-9])(-)", "$1 $2 "),
)


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Strip Unicode whitespace at both ends; looks only at the ends, not at the whole text."""
    return F.btrim(as_column(c), F.lit(WHITESPACE))


def or_empty(c: Column | str) -> Column:
    return F.coalesce(as_column(c), F.lit(""))


def words(c: Column | str) -> Column:
    """Whitespace-separated words, without empty edge pieces."""
    return F.regexp_extract_all(as_column(c), F.lit(NON_SPACE_RUN), F.lit(0))


def word_count(c: Column | str) -> Column:
    return F.regexp_count(as_column(c), F.lit(NON_SPACE_RUN))


def alnum_tokens(c: Column | str) -> Column:
    """Lower-cased ASCII letter/digit runs: the token definition behind the overlap scores."""
    return F.regexp_extract_all(F.lower(as_column(c)), F.lit(ALNUM_RUN), F.lit(0))


def joined_tokens(c: Column) -> Column:
    """Token array of a text whose tokens are separated by single spaces."""
    return F.when(c != "", F.split(c, " ")).otherwise(F.array().cast("array<string>"))


def mt13a_tokens(c: Column | str) -> Column:
    """Tokens of the 13a machine-translation scheme (case is kept)."""
    out = as_column(c)
    for old, new in MT13A_RULES:
        out = F.replace(out, F.lit(old), F.lit(new))
    out = F.concat(F.lit(" "), out, F.lit(" "))
    for pattern, replacement in MT13A_PATTERNS:
        out = F.regexp_replace(out, pattern, replacement)
    return words(out)


def ngrams(tokens: Column, n: int) -> Column:
    """All n-grams of a token array as space-joined strings; empty array when it is too short."""
    if n == 1:
        return tokens
    starts = F.slice(tokens, 1, F.greatest(F.size(tokens) - (n - 1), F.lit(0)))
    return F.transform(
        starts, lambda t, i: F.concat_ws(" ", t, *[F.get(tokens, i + k) for k in range(1, n)])
    )


def truncate(tokens: Column, max_tokens: int | None) -> Column:
    """First ``max_tokens`` tokens; ``None`` keeps the whole array."""
    return tokens if max_tokens is None else F.slice(tokens, 1, max_tokens)


def starts_with_any(c: Column, prefixes: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | c.startswith(p)
    return out


FENCE = "```"
FENCE_PATTERN = r"(?s)```(?:python|py)?\n(.*?)\n```"


def extract_code(c: Column | str) -> Column:
    """Python source inside a Markdown answer.

    A complete fenced block wins; otherwise the middle piece of an unbalanced fence, without its
    language line; otherwise the stripped text itself.
    """
    code = strip(c)
    pieces = F.split(code, FENCE, -1)
    middle = strip(F.get(pieces, F.lit(1)))
    after_language = F.when(
        starts_with_any(middle, ("python\n", "py\n")),
        strip(F.regexp_replace(middle, r"^[^\n]*\n", "")),
    ).otherwise(middle)
    return (
        F.when(code.rlike(FENCE_PATTERN), strip(F.regexp_extract(code, FENCE_PATTERN, 1)))
        .when(F.size(pieces) >= 3, after_language)
        .otherwise(code)
    )
