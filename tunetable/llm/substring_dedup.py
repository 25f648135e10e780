"""Exact substring deduplication with difference-cover anchors.

A window is `window` consecutive words of one document. Every window whose word sequence also starts
earlier (smaller doc_id, or the same document at an earlier word) is a repeat, and each word that a
repeat covers goes. Windows are judged on the input.

Method: {0, 1, 3, 9} is a perfect difference cover modulo 13, so for any two places of a match
there is a shift below 13 that brings both to cover positions. Anchors, runs of window - 12 words, are
hashed at cover positions only (4 of 13). Equal windows share an anchor at the same shift, so a
window without a repeated anchor is unique. Around repeated anchors the match is extended to whole
windows, compared by 128-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunetable.llm.base import beside, bucket_count, doc_id_of, keyed_texts, table
from tunetable.llm.shared import shared_positions
from tunetable.llm.tokens import starts_in_rows, text_slices, window_hashes, word_hashes, word_spans
from tunetable.session import ship_package, written

WINDOW = 20
PERIOD = 13
COVER = np.isin(np.arange(PERIOD), [0, 1, 3, 9])


def _words(batch: pa.RecordBatch):
    """(slice of the row keys, hashes of the words, first word of each row, rows) per run of rows."""
    ids, ties = batch["k_id"].to_numpy(), batch["k_tie"].to_numpy()
    for low, high, data, offsets in text_slices(batch["body"]):
        starts, ends, first = word_spans(data, offsets)
        yield ids[low:high], ties[low:high], word_hashes(data, starts, ends), first, (low, high)


def _anchors(window: int):
    size = window - PERIOD + 1

    def source(batch: pa.RecordBatch):
        for ids, ties, words, first, _ in _words(batch):
            index, row, position = starts_in_rows(first, size)
            at = COVER[position % PERIOD]
            hashes = window_hashes(words, size)
            yield ids, ties, (row[at], position[at], hashes[index[at]], None)

    return source


def _positions(marks: pa.Array, row: int) -> np.ndarray:
    """The marked positions of a row."""
    mark = marks[row]
    return np.frombuffer(mark.as_buffer() if mark.is_valid else b"", np.int32).astype(np.int64)


def _covered(points: np.ndarray, before: int, after: int, length: int) -> np.ndarray:
    """Which of `length` places lie in [p - before, p + after) of some point p."""
    change = np.zeros(length + 1, np.int64)
    np.add.at(change, np.clip(points - before, 0, length), 1)
    np.add.at(change, np.clip(points + after, 0, length), -1)
    return np.cumsum(change[:-1]) > 0


def _candidates(window: int):
    """Windows that contain a repeated anchor, hashed as a whole."""

    def source(batch: pa.RecordBatch):
        marks = batch["marks"]
        for ids, ties, words, first, (low, high) in _words(batch):
            index, row, position = starts_in_rows(first, window)
            counts = np.bincount(row, minlength=high - low)
            chosen = [
                _covered(_positions(marks, low + i), PERIOD - 1, 1, count)
                for i, count in enumerate(counts)
            ]
            at = np.concatenate(chosen) if chosen else np.zeros(0, bool)
            at = np.flatnonzero(at)
            one, two = window_hashes(words, window), window_hashes(words, window, 1)
            yield ids, ties, (row[at], position[at], one[index[at]], two[index[at]])

    return source


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(keyed texts, one row per document with repeats: k_id, k_tie, n_marks, marks).

    The marks are the starts of windows whose words also start earlier, as 32-bit integers.
    """
    if window < PERIOD + 1:
        raise ValueError(f"a window has at least {PERIOD + 1} words")
    spark = docs.sparkSession
    ship_package(spark)
    texts = keyed_texts(docs)
    buckets = bucket_count(texts)
    anchors = shared_positions(texts, _anchors(window), buckets, keep_first=False)
    near = beside(texts, written(anchors, "anchors"), "inner")
    repeats = shared_positions(near, _candidates(window), buckets, keep_first=True)
    return texts, written(repeats, "repeats")


def _kept(body: bytes | None, starts: np.ndarray, window: int) -> tuple[int, int, bytes]:
    """(words, removed words, kept words joined by one space) of one text."""
    words = (body or b"").split()
    gone = _covered(starts, 0, window, len(words))
    kept = [w for w, g in zip(words, gone.tolist()) if not g] if gone.any() else words
    return len(words), len(words) - len(kept), b" ".join(kept)


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, text, n_words, n_removed): each document without the words of repeated windows.

    Kept words are joined by one space. A null text has no words and gives an empty text. Rows that
    agree in doc_id and text are one document: each of them gets its result. Rows with the same
    doc_id and other texts are ordered by a hash of the text. A null doc_id is ordered first.
    """
    texts, repeats = repeated_windows(docs, window)

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [
                _kept(body.as_py(), _positions(batch["marks"], i), window)
                for i, body in enumerate(batch["body"])
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch["k_id"],
                    pa.array([x[2] for x in out], pa.binary()),
                    pa.array([x[0] for x in out], pa.int64()),
                    pa.array([x[1] for x in out], pa.int64()),
                ],
                ["k_id", "body", "n_words", "n_removed"],
            )

    joined = beside(texts, repeats, "left").select("k_id", "body", "marks")
    return joined.mapInArrow(strip, "k_id long, body binary, n_words long, n_removed long").select(
        doc_id_of().alias("doc_id"),
        F.col("body").cast("string").alias("text"),
        "n_words",
        "n_removed",
    )


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the number of its words, of the removed ones, and a digest of the kept text."""
    return remove_repeats(table(spark, sf_dir, "documents"), WINDOW).select(
        "doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256")
    )


#: The same in SQL, over the words of every window.
SQL = r"""
with doc as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
windows as (
  select doc_id, i, md5(array_to_string(words[i:i + 19], ' ')) as h
  from (select doc_id, words, unnest(range(1, len(words) - 18)) as i from doc)),
repeats as (
  select doc_id, i
  from (select doc_id, i, row_number() over (partition by h order by doc_id, i) as n from windows)
  where n > 1),
gone as (select distinct doc_id, unnest(range(i, i + 20)) as pos from repeats),
kept as (
  select w.doc_id, string_agg(w.word, ' ' order by w.pos) as text, count(*) as n
  from (select doc_id, unnest(words) as word, unnest(range(1, len(words) + 1)) as pos from doc) w
  anti join gone g on w.doc_id = g.doc_id and w.pos = g.pos
  group by w.doc_id)
select doc_id, len(words)::bigint as n_words, (len(words) - coalesce(n, 0))::bigint as n_removed,
  sha256(coalesce(text, '')) as kept_sha256
from doc left join kept using (doc_id)
"""
