"""Language identification by prediction by partial matching (PPM).

For each language a byte context tree of order `ORDER` is counted on a bounded sample of labelled
texts and then frozen. A byte costs -log2 p bits, p from the longest known context of up to ORDER bytes;
a byte that a context has not seen costs that context's escape, distinct / (total + distinct), and is
coded one order lower; the lowest order gives each of the 256 values the same chance (method C). The
language with the shortest code for the whole text wins.

The trees are stored as tables: the cost of every byte after every context of up to two bytes, and of
the four-byte strings that the sample holds, so that a text is scored by array look-ups. Bytes that no
sample text contains cost the same everywhere and share one symbol; this changes no code length.
Before counting and scoring, A-Z is lower-cased and digits and white space become one symbol each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tunetable.llm.base import checked, table, with_text
from tunetable.llm.tokens import LOWER, SPACE, text_slices
from tunetable.session import ship_package

#: Sample bound: texts per language, and bytes of the longest one.
SAMPLE_TEXTS = 300
SAMPLE_BYTES = 1 << 16
ORDER = 3
UNKNOWN = "und"
#: A prediction with a smaller share than this is no decision.
LEAST_SHARE = 0.5
#: Cost per byte, as a multiple of the median of held-out texts, and bits above it that reject a text.
DEARER, SLACK = 1.5, 64.0
SEED = 6

_FOLD = LOWER.copy()
_FOLD[ord("0") : ord("9") + 1] = ord("0")
_FOLD[SPACE] = ord(" ")


@dataclass
class Model:
    """Frozen code lengths in bits; the last axis is the language."""

    languages: list[str]
    symbol: np.ndarray
    size: int
    known: np.ndarray
    slots: list[np.ndarray]
    costs: np.ndarray
    lower: np.ndarray
    escape: np.ndarray

    def bits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length of each row of bytes in each language; a row starts after spaces."""
        rows = len(offsets) - 1
        out = np.zeros((rows, len(self.languages)))
        if not len(data):
            return out
        codes = self.symbol[data].astype(np.int64)
        blank = int(self.symbol[ord(" ")])
        # the three symbols before each one, blanks before the start of its row
        place = np.arange(len(codes)) - np.repeat(offsets[:-1], np.diff(offsets))
        before = []
        for back in range(1, ORDER + 1):
            shifted = np.empty_like(codes)
            shifted[:back] = blank
            shifted[back:] = codes[:-back]
            shifted[place < back] = blank
            before.append(shifted)
        tail = (before[1] * self.size + before[0]) * self.size
        context = before[2] * self.size * self.size + before[1] * self.size + before[0]
        three = tail + codes
        found = _found(self.known, self.slots, context * self.size + codes)
        cost = self.costs[found]
        missing = np.flatnonzero(found == 0)
        cost[missing] = self.escape[context[missing]] + self.lower[three[missing]]
        full = np.flatnonzero(np.diff(offsets))
        out[full] = np.add.reduceat(cost, offsets[full], axis=0, dtype=np.float64)
        return out


def _slot(value: np.ndarray, number: int, slots: int) -> np.ndarray:
    factor = np.uint64(0x9E3779B97F4A7C15 + 2 * number * 0x5851F42D4C957F2D & (1 << 64) - 1 | 1)
    return (value.astype(np.uint64) * factor) >> np.uint64(64 - slots.bit_length() + 1)


def _slotted(known: np.ndarray) -> list[np.ndarray]:
    """Hash tables from strings to their places in `known`; each takes what collided before."""
    tables = []
    left = np.arange(1, len(known))
    while len(left):
        table = np.zeros(1 << max(10, int(4 * len(left)).bit_length()), np.int32)
        at = _slot(known[left], len(tables), len(table))
        table[at] = left
        tables.append(table)
        left = left[table[at] != left]
    return tables


def _found(known: np.ndarray, tables: list[np.ndarray], value: np.ndarray) -> np.ndarray:
    """The place of each value in `known`, 0 if it is not there."""
    out = np.zeros(len(value), np.int32)
    todo, asked = None, value
    for number, table in enumerate(tables):
        place = table[_slot(asked, number, len(table))]
        hit = known[place] == asked
        if todo is None:
            out = np.where(hit, place, 0)
            todo = np.flatnonzero(~hit)
        else:
            out[todo[hit]] = place[hit]
            todo = todo[~hit]
        asked = value[todo]
    return out


def _counts(codes: np.ndarray, size: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(strings of `length` symbols as numbers, how often each occurs)."""
    value = np.zeros(len(codes) - ORDER, np.int64)
    for back in range(length - 1, -1, -1):
        value = value * size + codes[ORDER - back : len(codes) - back]
    return np.unique(value, return_counts=True)


def fit(texts: dict[str, list[bytes]]) -> Model | None:
    """Counts one context tree per language; None without any text."""
    languages = sorted(name for name, rows in texts.items() if any(rows))
    if not languages:
        return None
    folded = {
        name: [_FOLD[np.frombuffer(t, np.uint8)] for t in texts[name] if t] for name in languages
    }
    seen = np.zeros(256, bool)
    seen[ord(" ")] = True
    for rows in folded.values():
        for row in rows:
            seen[row] = True
    symbol = np.zeros(256, np.int32)
    symbol[seen] = np.arange(1, seen.sum() + 1)
    size = int(seen.sum()) + 1
    trees = []
    for name in languages:
        pad = np.full(ORDER, symbol[ord(" ")])
        parts = [_counts_of(np.concatenate([pad, symbol[row]]), size) for row in folded[name]]
        trees.append([_merged([p[k] for p in parts]) for k in range(ORDER + 1)])
    known = np.unique(np.concatenate([tree[ORDER][0] for tree in trees]))
    costs = np.zeros((len(known) + 1, len(languages)), np.float32)
    lower = np.zeros((size**ORDER, len(languages)), np.float32)
    escape = np.zeros((size**ORDER, len(languages)), np.float32)
    for number, tree in enumerate(trees):
        below = np.full(size, 8.0)
        for order in range(ORDER):
            below, _ = _coded(tree[order], below, size, order)
        lower[:, number] = below
        strings, times = tree[ORDER]
        total, distinct = _contexts(strings, times, size, size**ORDER)
        has = distinct > 0
        leave = np.zeros(size**ORDER)
        leave[has] = np.log2((total[has] + distinct[has]) / distinct[has])
        escape[:, number] = leave
        cost = leave[known // size] + below[known % size**ORDER]
        at = np.searchsorted(known, strings)
        owner = strings // size
        cost[at] = np.log2((total[owner] + distinct[owner]) / times)
        costs[1:, number] = cost
    known = np.concatenate([[-1], known])
    folded_symbol = symbol[_FOLD].astype(np.uint16)
    return Model(languages, folded_symbol, size, known, _slotted(known), costs, lower, escape)


def _counts_of(codes: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]]:
    return [_counts(codes, size, length) for length in range(1, ORDER + 2)]


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    value, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return value, np.bincount(place, np.concatenate([p[1] for p in parts]))


def _contexts(strings, times, size: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(occurrences, distinct next symbols) of each context."""
    owner = strings // size
    return np.bincount(owner, times, count), np.bincount(owner, minlength=count)


def _coded(tree, below: np.ndarray, size: int, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Cost of every symbol after every context of `order` symbols, given the costs one order lower."""
    strings, times = tree
    contexts = size**order
    total, distinct = _contexts(strings, times, size, contexts)
    has = distinct > 0
    leave = np.zeros(contexts)
    leave[has] = np.log2((total[has] + distinct[has]) / distinct[has])
    lower = np.resize(below, contexts * size) if order else below
    cost = np.repeat(leave, size) + lower
    owner = strings // size
    cost[strings] = np.log2((total[owner] + distinct[owner]) / times)
    return cost, leave


def held_out() -> Column:
    """Documents that no model learns from; a null doc_id is not held out but not learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_sample(docs: DataFrame) -> dict[str, list[bytes]]:
    """At most SAMPLE_TEXTS different whole texts of each lang, the first in a hash order of doc_id and text.

    Rows that agree in lang, doc_id and text are one. Of a lang with n texts only those in the first 2 * SAMPLE_TEXTS / n of the hash range are ranked, so
    the ranking sees about as many rows for a lang of any size.
    """
    usable = docs.select("doc_id", "lang", F.col("text").cast("binary").alias("body")).filter(
        F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out()
        & F.octet_length("body").between(1, SAMPLE_BYTES)
    )
    usable = usable.withColumn("mark", F.xxhash64(F.lit(SEED), "doc_id", "body"))
    place = F.shiftrightunsigned("mark", 11) / float(1 << 53)
    known = usable.select("lang", "doc_id", "mark").distinct().withColumn("place", place)
    totals = checked(known.groupBy("lang").agg(F.count("*").alias("n")), "lang-totals")
    near = known.join(totals, "lang")
    near = near.filter(F.col("place") * F.col("n") < 2.0 * SAMPLE_TEXTS)
    key = ["lang", "doc_id", "mark"]
    rank = F.row_number().over(W.partitionBy("lang").orderBy("place", "doc_id", "mark"))
    chosen = near.withColumn("rank", rank).filter(F.col("rank") <= SAMPLE_TEXTS).select(*key)
    found = usable.join(checked(chosen, "lang-sample"), key).groupBy(*key)
    rows = found.agg(F.first("body").alias("body")).orderBy(*key)
    texts: dict[str, list[bytes]] = {}
    for row in rows.collect():
        texts.setdefault(row["lang"], []).append(bytes(row["body"]))
    return texts


def predict(
    texts: DataFrame, model: Model | None, key: str = "row", with_body: bool = False
) -> DataFrame:
    """(key, [body,] lang_pred, score, cost) of rows (key, body).

    The score is the winner's share of 2 ** -bits, the cost its bits per byte. A null text, one without a
    letter, or a missing model gives `und`, score 0 and no cost. Equal code lengths go to the smaller
    language.
    """
    letters = F.coalesce(F.col("body").cast("string").rlike(r"\p{L}"), F.lit(False))
    rows = texts.select(key, "body", letters.alias("letters"))
    kept = (key, "body") if with_body else (key,)
    if model is None:
        none = F.lit(None).cast("double").alias("cost")
        return rows.select(*kept, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), none)
    sent = texts.sparkSession.sparkContext.broadcast(model)
    names = [*model.languages, UNKNOWN]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frozen = sent.value
        for batch in batches:
            best, share, cost = [], [], []
            for _, _, data, offsets in text_slices(batch["body"], 1 << 20):
                bits = frozen.bits(data, offsets)
                first = bits.argmin(axis=1)
                least = bits[np.arange(len(bits)), first]
                ahead = bits - least[:, None]
                best.append(first)
                cost.append(least / np.maximum(np.diff(offsets), 1))
                share.append(1 / np.exp2(-np.minimum(ahead, 1000)).sum(axis=1))
            best = np.concatenate(best) if best else np.zeros(0, np.int64)
            share = np.concatenate(share) if share else np.zeros(0)
            cost = np.concatenate(cost) if cost else np.zeros(0)
            blank = ~batch["letters"].to_numpy(zero_copy_only=False)
            best[blank], share[blank] = len(names) - 1, 0.0
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch[c] for c in kept),
                    pa.array(names).take(pa.array(best)),
                    pa.array(share),
                    pa.array(cost, mask=blank),
                ],
                [*kept, "lang_pred", "score", "cost"],
            )

    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)
    return rows.mapInArrow(score, f"{fields}, lang_pred string, score double, cost double")


def identify(docs: DataFrame) -> DataFrame:
    """(row, lang_pred, score, cost): every row of `docs` as a struct, with its predicted language."""
    ship_package(docs.sparkSession)
    return _identified(docs, fit(training_sample(docs)))


def _identified(docs: DataFrame, model: Model | None) -> DataFrame:
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    return predict(docs.select(row, F.col("text").cast("binary").alias("body")), model)


def in_a_learned_language(docs: DataFrame) -> DataFrame:
    """The rows of `docs` whose text is in one of the labelled languages; all if none is labelled.

    A text goes if it has no letter, if no language has LEAST_SHARE, or if it costs more per byte than
    DEARER times the median of the winner's held-out texts, over all of them, and that by SLACK bits
    or more in total. A language without held-out texts has no such limit.
    """
    ship_package(docs.sparkSession)
    model = fit(training_sample(docs))
    if model is None:
        return docs
    labelled = docs.filter(held_out() & F.col("lang").isNotNull())
    known = predict(labelled.select("lang", F.col("text").alias("body")), model, "lang")
    known = known.filter(F.col("lang_pred") == F.col("lang"))
    usual = known.groupBy("lang_pred").agg(F.percentile_approx("cost", 0.5, 10000).alias("usual"))
    limits = {row["lang_pred"]: DEARER * row["usual"] for row in usual.collect()}
    limit = F.lit(None).cast("double")
    for name, most in limits.items():
        limit = F.when(F.col("lang_pred") == name, most).otherwise(limit)
    excess = (F.col("cost") - limit) * F.octet_length("body")
    # the text goes to the workers and back once, beside the other columns
    others = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("row")
    found = predict(docs.select(others, F.col("text").alias("body")), model, with_body=True)
    kept = (F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SHARE)
    kept_rows = found.filter(kept & F.coalesce(excess < SLACK, F.lit(True)))
    return with_text(kept_rows.select("row", F.col("body").alias("text")), docs)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document whether it was held out, its predicted language and the share of that language."""
    docs = table(spark, sf_dir, "documents")
    ship_package(spark)
    model = fit(training_sample(docs))
    row = F.struct("doc_id", held_out().alias("held_out")).alias("row")
    out = predict(docs.select(row, F.col("text").cast("binary").alias("body")), model)
    return out.select("row.doc_id", "row.held_out", "lang_pred", "score")
