"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence has a probability p = sigmoid(bias + sum of its features' weights)
of being offensive, and the document is toxic with probability 1 - (1 - leak) * product(1 - p): a noisy-or
over its sentences, with a leak for documents whose label no sentence explains. Only document labels are
known; weights, bias and leak are fitted to them by maximum likelihood with an absolute-value penalty, so
that features without evidence have weight 0. The fitted p then tells which sentences offend.

Features are the words and the first bytes of longer ones, which inflected forms share. A step of the fit
leaves most features out at random, since with all of them one offending word would explain a document and its
others would stay unknown.

Words are the runs of ASCII letters, digits and characters above ASCII, with A-Z lower-cased. Sentences end at
`.`, `!`, `?` and line feeds and are cut into stretches of MOST_WORDS words, so that a text without
punctuation is no single sentence. Whole texts are scored, by the tasks that read them; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tunetable.llm.base import checked, table
from tunetable.llm.tokens import LOWER, mixed, text_slices, word_hashes, word_spans
from tunetable.session import ship_package, written

#: Sample bound: labelled texts of each of the two labels, and bytes of the longest one. They come from the
#: first DRAWN * SAMPLE_TEXTS labelled ids of each label in a hash order.
SAMPLE_TEXTS = 1000
SAMPLE_BYTES = 1 << 14
DRAWN = 4
#: Sampled texts that a word with a weight of its own occurs in at least.
LEAST_TEXTS = 3
MOST_WORDS = 40
#: Leading bytes of longer words that are features beside the whole words.
STEM_BYTES = (4, 5, 6, 7, 8)
#: Steps of the fit; the last third is without penalty and dropout.
ROUNDS = 300
#: Penalty per unit of weight, in units of the square root of the sampled texts.
PENALTY = 0.1
#: Share of the features that a step leaves out, so that each of several offending words has to be learned.
DROPPED = 0.6
TOXIC = 0.3
#: A sentence with at least this probability is reported as offending.
OFFENDING = 0.5
SEED = 11

NOT_WORD = np.ones(256, bool)
NOT_WORD[0x30:0x3A] = NOT_WORD[0x41:0x5B] = NOT_WORD[0x61:0x7B] = NOT_WORD[0x80:] = False
STOP = np.zeros(256, np.int64)
STOP[[ord("."), ord("!"), ord("?"), ord("\n")]] = 1


def _stems(data, starts, ends, whole):
    """(words, hashes) per kind of feature: all words, then the first so many bytes of longer ones.

    Inflected and compound forms of a word share its first bytes.
    """
    yield np.arange(len(starts)), whole
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    for size in STEM_BYTES:
        longer = np.flatnonzero(ends - starts > size)
        head = eights[starts[longer]] & np.uint64((1 << (8 * size)) - 1)
        yield longer, mixed(head ^ np.uint64(size * 0x9E3779B97F4A7C15 & (1 << 64) - 1))


def sentences(data: np.ndarray, offsets: np.ndarray):
    """(features, sentence of each word, row, first byte and end byte of each sentence).

    The features are pairs (words, hashes). Sentences are numbered through all rows; one without a word is
    none.
    """
    data = LOWER[data]
    starts, ends, first = word_spans(data, offsets, NOT_WORD)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return [], none, none, none, none
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    stops = np.cumsum(STOP[data])[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (np.diff(stops) != 0) | (np.diff(row) != 0)
    begin = np.flatnonzero(new)
    place = np.arange(len(starts)) - begin[np.cumsum(new) - 1]
    new |= place % MOST_WORDS == 0
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(starts)) - 1
    sentence = np.cumsum(new) - 1
    features = _stems(data, starts, ends, word_hashes(data, starts, ends))
    return features, sentence, row[begin], starts[begin], ends[last]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Model:
    """Frozen weights of word hashes; a constant score where the sample has one label only."""

    words: np.ndarray
    weights: np.ndarray
    bias: float
    leak: float

    def probabilities(self, features, sentence: np.ndarray, count: int) -> np.ndarray:
        """p of each sentence."""
        logit = np.full(count, self.bias)
        if len(self.words):
            for word, value in features:
                place = np.searchsorted(self.words, value)
                place[place == len(self.words)] = 0
                hit = np.flatnonzero(self.words[place] == value)
                logit += np.bincount(sentence[word[hit]], self.weights[place[hit]], count)
        return _sigmoid(logit)

    def documents(self, p: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        """Noisy-or of the sentences of each row."""
        clean = np.bincount(row, np.log1p(-np.minimum(p, 1 - 1e-12)), rows)
        return 1 - (1 - self.leak) * np.exp(clean)


def _evidence(pair, bag, label, weight, words: int) -> np.ndarray:
    """Log odds of the two labels among the bags with a word, less two standard errors, at least 0."""
    here = np.unique(pair % max(words, 1) * len(label) + bag[pair // max(words, 1)])
    word, owner = here // len(label), here % len(label)
    sides = []
    for side in (1, 0):
        mine = weight * (label == side)
        sides.append((np.bincount(word, mine[owner], words) + 0.5, mine.sum() + 1))
    (toxic, all_toxic), (clean, all_clean) = sides
    odds = np.log(toxic / all_toxic) - np.log(clean / all_clean)
    return np.maximum(odds - 2 * np.sqrt(1 / toxic + 1 / clean), 0)


def fit(
    words: np.ndarray, sentence: np.ndarray, bag: np.ndarray, label: np.ndarray, weight: np.ndarray
) -> Model:
    """Fits the noisy-or to the label of each bag.

    `words` are feature hashes and `sentence` where they stand, `bag` is the one of each sentence, and
    `weight` says for how many labelled texts a bag stands.

    Proximal gradient steps with a step size per coordinate. They start from each word's log odds of labels
    less two standard errors, if positive, and leave the leak alone for a third of the rounds: with a free
    leak and equal weights, the leak alone would explain all labels.
    """
    bags = len(label)
    share = float((weight * label).sum() / max(weight.sum(), 1e-300))
    none = np.zeros(0, np.uint64), np.zeros(0)
    if bags == 0 or share in (0.0, 1.0):
        return Model(*none, -40.0, share)
    value, word = np.unique(words, return_inverse=True)
    seen = np.unique(word * bags + bag[sentence]) // bags
    often = np.bincount(seen, minlength=len(value)) >= LEAST_TEXTS
    keep = often[word]
    column = (np.cumsum(often) - 1)[word[keep]]
    sentence, value = sentence[keep], value[often]
    # a word counts once per sentence
    pair = np.unique(sentence * max(len(value), 1) + column)
    sentence, column = pair // max(len(value), 1), pair % max(len(value), 1)
    units = len(bag)
    penalty = PENALTY * np.sqrt(bags)
    w = _evidence(pair, bag, label, weight, len(value))
    b, leak = -5.0, np.log(0.02 / 0.98)
    rng = np.random.default_rng(SEED)
    square = np.full(len(value) + 2, 1e-8)
    for number in range(ROUNDS):
        last = 3 * number >= 2 * ROUNDS
        if last and number and 3 * (number - 1) < 2 * ROUNDS:
            kept = w[column] != 0
            sentence, column = sentence[kept], column[kept]
            square[:] = 1.0
        on = w != 0 if last else rng.random(len(value)) >= DROPPED
        p = _sigmoid(b + np.bincount(sentence, (w * on)[column], units))
        own = _sigmoid(np.array(leak))
        clean = (1 - own) * np.exp(np.bincount(bag, np.log1p(-np.minimum(p, 1 - 1e-12)), bags))
        toxic = np.maximum(1 - clean, 1e-12)
        # derivative of the log-likelihood by a sentence's logit is this factor times p
        factor = weight * np.where(label == 1, clean / toxic, -1.0)
        pull = factor[bag] * p
        slope = np.empty(len(value) + 2)
        slope[:-2] = on * np.bincount(column, pull[sentence], len(value))
        slope[-2], slope[-1] = pull.sum(), (factor * own).sum()
        square += slope * slope
        step = 0.5 / np.sqrt(square)
        w += step[:-2] * slope[:-2]
        w = np.sign(w) * np.maximum(np.abs(w) - on * step[:-2] * (0 if last else penalty), 0)
        b += step[-2] * slope[-2]
        if 3 * number > ROUNDS:
            leak += step[-1] * slope[-1]
    used = np.flatnonzero(w)
    return Model(value[used], w[used], float(b), float(_sigmoid(np.array(leak))))


def held_out() -> Column:
    """Documents whose labels are never learned from; a null doc_id has no label either."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(texts, labels, weights) of at most SAMPLE_TEXTS whole texts per label.

    A doc_id with several labels counts as toxic if one of them says so; other labels than 0 and 1 are
    ignored. A weight is the number of labelled ids of that label per sampled text.
    """
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy(F.col("doc_id").cast("long").alias("k_id")).agg(F.max("toxic").alias("y"))
    known = written(known.withColumn("place", F.xxhash64(F.lit(SEED), "k_id")), "labels")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("k_id"), F.col("text").cast("binary").alias("body")
    ).filter(F.octet_length("body").between(1, SAMPLE_BYTES))
    texts, label, weight = [], [], []
    for y, total in known.groupBy("y").count().orderBy("y").collect():
        drawn = known.filter(F.col("y") == y).orderBy("place", "k_id").limit(DRAWN * SAMPLE_TEXTS)
        found = rows.join(checked(drawn, "drawn-labels"), "k_id").orderBy("place", "k_id", "body")
        some = [bytes(r["body"]) for r in found.limit(SAMPLE_TEXTS).select("body").collect()]
        texts += some
        label += [y] * len(some)
        weight += [total / max(len(some), 1)] * len(some)
    return texts, np.array(label, np.int64), np.array(weight)


def fitted(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of the bounded sample; without a label of one kind every text has the same score."""
    texts, label, weight = training_sample(docs, labels)
    words, places, bags, count = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [], 0
    for low, _, data, offsets in text_slices(pa.array(texts, pa.large_binary())):
        features, sentence, row, _, _ = sentences(data, offsets)
        for word, value in features:
            words.append(value)
            places.append(sentence[word] + count)
        bags.append(row + low)
        count += len(row)
    bag = np.concatenate(bags) if bags else np.zeros(0, np.int64)
    return fit(np.concatenate(words), np.concatenate(places), bag, label, weight)


SCORED = "score double, n_sentences int, n_offending int, worst int, worst_score double"


def scored(docs: DataFrame, model: Model, *columns: Column) -> DataFrame:
    """(columns, score, n_sentences, n_offending, worst, worst_score) of every row of `docs`.

    `worst` is the number, from 0, of the sentence with the largest probability, the first on ties; it and
    its probability are null for a text without a word, whose score is the leak.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.struct(*columns).alias("row"), F.col("text").cast("binary").alias("body"))
    kind = rows.schema["row"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frozen = sent.value
        for batch in batches:
            for low, high, data, offsets in text_slices(batch["body"], 1 << 20):
                features, sentence, row, _, _ = sentences(data, offsets)
                p = frozen.probabilities(features, sentence, len(row))
                rows = high - low
                count = np.bincount(row, minlength=rows)
                order = np.lexsort((np.arange(len(row)), -p, row))
                first = np.cumsum(count) - count
                full = count > 0
                worst = np.zeros(rows, np.int64)
                worst[full] = order[first[full]]
                most = np.zeros(rows)
                most[full] = p[worst[full]]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["row"].slice(low, rows),
                        pa.array(frozen.documents(p, row, rows)),
                        pa.array(count.astype(np.int32)),
                        pa.array(np.bincount(row[p >= OFFENDING], minlength=rows).astype(np.int32)),
                        pa.array((worst - first).astype(np.int32), mask=~full),
                        pa.array(most, mask=~full),
                    ],
                    ["row", *(c.split()[0] for c in SCORED.split(", "))],
                )

    return rows.mapInArrow(score, f"row {kind}, {SCORED}").select("row.*", "score", *(
        c.split()[0] for c in SCORED.split(", ")[1:]
    ))


def offending_sentences(docs: DataFrame, model: Model, least: float = OFFENDING) -> DataFrame:
    """(doc_id, number, sentence, probability): the sentences of every text with at least that probability.

    `sentence` runs from the first to the last word of the sentence or stretch, as it stands in the text.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("body")
    )

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in text_slices(batch["body"], 1 << 20):
                features, sentence, row, starts, ends = sentences(data, offsets)
                p = sent.value.probabilities(features, sentence, len(row))
                found = np.flatnonzero(p >= least)
                number = found - np.searchsorted(row, row[found])
                raw = data.tobytes()
                spans = zip(starts[found].tolist(), ends[found].tolist())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["doc_id"].take(pa.array(low + row[found], pa.int64())),
                        pa.array(number.astype(np.int32)),
                        pa.array([raw[a:b].decode("utf-8", "replace") for a, b in spans], pa.string()),
                        pa.array(p[found]),
                    ],
                    ["doc_id", "number", "sentence", "probability"],
                )

    return rows.mapInArrow(find, "doc_id long, number int, sentence string, probability double")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, with its number of sentences and the most offending one."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    ship_package(spark)
    model = fitted(docs, labels)
    out = scored(docs, model, F.col("doc_id"), held_out().alias("held_out"))
    predicted = F.when(F.col("score") >= TOXIC, 1).otherwise(0)
    return out.withColumn("predicted", predicted).select(
        "doc_id", "held_out", "score", "predicted", "n_sentences", "n_offending", "worst", "worst_score"
    )
