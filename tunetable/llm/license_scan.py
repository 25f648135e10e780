"""License scans: notice phrases and identifier tags by Aho-Corasick, licence expressions by shunting-yard.

Words are the runs outside `[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]` after lower-casing A-Z. One automaton
runs over the words joined by single spaces, so a phrase is found wherever its words stand
consecutively, also where places overlap. Where it meets an identifier tag, the expression after the
tag is parsed with operators `or` < `and` < `with` and parentheses, and evaluated.

An expression ends at the first token that cannot continue it (`MIT # see LICENSE` is `mit`); if what
stands before is not whole (`MIT or`), it is `spdx:malformed`. Between identifiers that are known, `/` reads as `or` and
`,` as `and`. Known are the identifiers of FAMILIES and SINGLE, each also with a trailing `+`, custom
`licenseref-` names, and a known identifier `with` one of EXCEPTIONS; any other name becomes `spdx:unknown`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunetable.llm.base import table
from tunetable.llm.tokens import LOWER
from tunetable.session import ship_package

#: Phrases that are counted, and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Further notices, labelled only.
NOTICES = {
    "gnu lesser general public license": "lgpl",
    "gnu library general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "gnu free documentation license": "gfdl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "european union public licence": "eupl",
    "common development and distribution license": "cddl",
    "microsoft public license": "ms-pl",
    "artistic license": "artistic",
    "academic free license": "afl",
    "open software license": "osl",
    "boost software license": "bsl",
    "python software foundation license": "psf",
    "sil open font license": "ofl",
    "server side public license": "sspl",
    "business source license": "busl",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit",
    "permission to use copy modify and or distribute this software": "isc",
    "this is free and unencumbered software": "unlicense",
    "isc license": "isc",
    "zlib license": "zlib",
    "cc0": "cc0",
    "creative commons zero": "cc0",
    "creative commons attribution": "cc-by",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by sa": "cc-by-sa",
    "open database license": "odbl",
    "public domain": "public-domain",
    "all rights reserved": "all-rights-reserved",
}
#: Words of the tags that an expression follows.
TAGS = ("spdx license identifier", "license expression")
#: Identifiers that exist in several versions, and the versions.
FAMILIES = {
    "afl": "1.1 1.2 2.0 2.1 3.0",
    "agpl": "1.0 1.0-only 1.0-or-later 3.0 3.0-only 3.0-or-later",
    "apache": "1.0 1.1 2.0",
    "apsl": "1.0 1.1 1.2 2.0",
    "artistic": "1.0 2.0",
    "bsd": "1-clause 2-clause 3-clause 4-clause",
    "bsl": "1.0",
    "busl": "1.1",
    "cc-by": "1.0 2.0 2.5 3.0 4.0",
    "cc-by-nc": "1.0 2.0 2.5 3.0 4.0",
    "cc-by-nc-nd": "1.0 2.0 2.5 3.0 4.0",
    "cc-by-nc-sa": "1.0 2.0 2.5 3.0 4.0",
    "cc-by-nd": "1.0 2.0 2.5 3.0 4.0",
    "cc-by-sa": "1.0 2.0 2.5 3.0 4.0",
    "cc0": "1.0",
    "cddl": "1.0 1.1",
    "cecill": "1.0 2.0 2.1 b c",
    "epl": "1.0 2.0",
    "eupl": "1.0 1.1 1.2",
    "gfdl": "1.1 1.1-only 1.1-or-later 1.2 1.2-only 1.2-or-later 1.3 1.3-only 1.3-or-later",
    "gpl": "1.0 1.0-only 1.0-or-later 2.0 2.0-only 2.0-or-later 3.0 3.0-only 3.0-or-later",
    "lgpl": "2.0 2.0-only 2.0-or-later 2.1 2.1-only 2.1-or-later 3.0 3.0-only 3.0-or-later",
    "mpl": "1.0 1.1 2.0",
    "mulanpsl": "1.0 2.0",
    "odbl": "1.0",
    "ofl": "1.0 1.1",
    "osl": "1.0 1.1 2.0 2.1 3.0",
    "psf": "2.0",
    "python": "2.0",
    "sspl": "1.0",
    "upl": "1.0",
    "zpl": "1.1 2.0 2.1",
}
#: Identifiers without a version.
SINGLE = "0bsd curl isc libpng mit mit-0 ms-pl ms-rl ncsa openssl php-3.01 postgresql ruby unlicense vim w3c wtfpl x11 zlib"
#: Exceptions that may stand after `with`.
EXCEPTIONS = frozenset(
    "autoconf-exception-2.0 autoconf-exception-3.0 bison-exception-2.2 classpath-exception-2.0 "
    "font-exception-2.0 gcc-exception-2.0 gcc-exception-3.1 linux-syscall-note llvm-exception "
    "openssl-exception u-boot-exception-2.0 wxwindows-exception-3.1".split()
)
#: Families and single identifiers that allow use with attribution only.
PERMISSIVE_FAMILIES = ("apache", "bsd", "bsl", "cc-by", "cc0", "mulanpsl", "psf", "python", "upl", "zpl")
PERMISSIVE_SINGLE = "0bsd curl isc libpng mit mit-0 ncsa php-3.01 postgresql unlicense wtfpl x11 zlib"

KNOWN = frozenset(f"{f}-{v}" for f, all_of in FAMILIES.items() for v in all_of.split()) | frozenset(SINGLE.split())
PERMISSIVE = frozenset(f"{f}-{v}" for f in PERMISSIVE_FAMILIES for v in FAMILIES[f].split()) | frozenset(
    PERMISSIVE_SINGLE.split()
)

RESULT = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
    "labels string, score double, n_tags long, permissive boolean"
)

_WORDS = bytes(
    int(LOWER[c]) if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= LOWER[c] <= 0x7A else 0x20
    for c in range(256)
)
_EXPRESSION = re.compile(rb"(?:spdx-license-identifier|license-expression)[ \t]*:[ \t]*([^\r\n]*)")
_TOKEN = re.compile(r"[ \t]*([()/,]|[a-z0-9]+(?:[.:-][a-z0-9]+)*\+?)")
_SEPARATORS = {"/": "or", ",": "and"}
_RANK = {"or": 1, "and": 2, "with": 3}


def to_postfix(tokens: list[str]) -> list[str] | None:
    """Shunting-yard; None if the expression is malformed."""
    out: list[str] = []
    stack: list[str] = []
    operand = False
    for token in tokens:
        if token == "(":
            if operand:
                return None
            stack.append(token)
        elif token == ")":
            if not operand:
                return None
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                return None
            stack.pop()
        elif token in _RANK:
            if not operand:
                return None
            while stack and stack[-1] != "(" and _RANK[stack[-1]] >= _RANK[token]:
                out.append(stack.pop())
            stack.append(token)
            operand = False
        else:
            if operand:
                return None
            out.append(token)
            operand = True
    if not operand or "(" in stack:
        return None
    return out + stack[::-1]


def is_known(name: str) -> bool:
    """Whether a name that `evaluate` returns is a known identifier, alone or with a known exception."""
    identifier, _, exception = name.partition(" with ")
    known = identifier.removesuffix("+") in KNOWN or identifier.startswith(("licenseref-", "documentref-"))
    return known and (not exception or exception in EXCEPTIONS)


def leading_tokens(line: str) -> list[str]:
    """The tokens of a tag's line up to the first that cannot continue its expression."""
    out: list[str] = []
    depth, operand, at = 0, False, 0
    while found := _TOKEN.match(line, at):
        token, at = found[1], found.end()
        if token in _SEPARATORS:
            after = _TOKEN.match(line, at)
            if not (operand and out[-1] != ")" and is_known(out[-1]) and after and is_known(after[1])):
                break
            token = _SEPARATORS[token]
        follows = operand if token == ")" or token in _RANK else not operand
        if not follows or (token == ")" and not depth):
            break
        depth += (token == "(") - (token == ")")
        operand = token == ")" or (token != "(" and token not in _RANK)
        out.append(token)
    return out


def evaluate(expression: str) -> tuple[list[str], bool] | None:
    """(identifiers, whether some allowed choice is permissive); None unless all of it is one expression."""
    return _value(to_postfix(re.findall(r"[()]|[^\s()]+", expression.lower())))


def evaluate_leading(line: str) -> tuple[list[str], bool] | None:
    """The same for the expression that a tag's line begins with; None if that is not whole."""
    return _value(to_postfix(leading_tokens(line.lower())))


def _value(postfix: list[str] | None) -> tuple[list[str], bool] | None:
    """Identifiers and verdict of an expression.

    `or` needs one permissive side, `and` both. `with` adds an exception to one identifier and does not
    make it permissive.
    """
    if postfix is None:
        return None
    names: list[str] = []
    stack: list[tuple[str | None, bool]] = []
    for token in postfix:
        if token not in _RANK:
            stack.append((token, token.removesuffix("+") in PERMISSIVE))
            continue
        (right, free), (left, allowed) = stack.pop(), stack.pop()
        if token == "with":
            if left is None or right is None:
                return None
            names.append(f"{left} with {right}")
            stack.append((None, allowed))
            continue
        names += [x for x in (left, right) if x is not None]
        stack.append((None, (allowed or free) if token == "or" else (allowed and free)))
    last, allowed = stack.pop()
    if last is not None:
        names.append(last)
    return names, allowed


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase, label in BASE.items():
        found.add_word(f" {phrase} ", (len(phrase) + 2, label, True))
    for phrase, label in {**NOTICES, **dict.fromkeys(TAGS, "")}.items():
        found.add_word(f" {phrase} ", (len(phrase) + 2, label, False))
    found.make_automaton()
    return found


def scan(text: bytes, automaton: ahocorasick.Automaton) -> tuple:
    """The columns of RESULT after doc_id, for one whole text."""
    words = text.translate(_WORDS).split()
    line = b" " + b" ".join(words) + b" "
    base: set[str] = set()
    labels: set[str] = set()
    places, first, last, notices, tagged = 0, len(line), -1, 0, False
    for end, (length, label, counted) in automaton.iter(line.decode("latin-1")):
        if counted:
            start = end - length + 1
            places, first, last = places + 1, min(first, start), max(last, start)
            base.add(label)
        elif label:
            notices += 1
            labels.add(label)
        else:
            tagged = True
    tags, verdicts = 0, []
    for found in _EXPRESSION.finditer(text.lower()) if tagged else ():
        tags += 1
        value = evaluate_leading(found[1].decode("latin-1"))
        if value is None:
            labels.add("spdx:malformed")
            continue
        labels.update(f"spdx:{x}" if is_known(x) else "spdx:unknown" for x in value[0])
        if any(map(is_known, value[0])):
            verdicts.append(value[1])
    score = 1.0 if verdicts else 1.0 - 0.5 ** (places + notices)
    return (
        len(words),
        places,
        line.count(b" ", 0, first) if places else None,
        line.count(b" ", 0, last) if places else None,
        ",".join(sorted(base)),
        ",".join(sorted(base | labels)),
        score,
        tags,
        all(verdicts) if verdicts else None,
    )


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per row of `docs`, with the columns of RESULT.

    A null text is empty: no words, empty labels, score 0. `permissive` is null without a well-formed
    tag that names a known licence; with several such tags all must be permissive, and an unknown name is not.
    """
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton()
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.int64(), pa.bool_()]
        names = [c.split()[0] for c in RESULT.split(", ")]
        for batch in batches:
            rows = [scan(x.as_py() or b"", automaton) for x in batch["body"]]
            columns = [
                pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)
            ]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *columns], names)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("body"))
    return rows.mapInArrow(run, RESULT)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases, tags and labels of every document."""
    return scan_licenses(table(spark, sf_dir, "documents"))
