"""Benchmark decontamination by greedy string tiling.

Words are the runs outside `[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]` after lower-casing A-Z. A tile is a
match of at least `min_words` consecutive words between a document and a benchmark item whose words no
earlier tile uses, on either side. Tiles are taken longest first (ties: earlier in the item, then in
the document), so passages in another order are found piece by piece. A document is contaminated by an
item if tiles cover at least `coverage` of the item's words.

Method: the Karp-Rabin hashes of all runs of `min_words` words of the items are the seeds. Documents
are joined with them by hash where they lie. Only the beginnings and ends of matches are listed, where
the words beyond differ; in pairs they are the maximal matches, and greedy tiling marks them. The benchmark is sent to the tasks in blocks of bounded size, and every
block meets all documents, so that neither side is limited and no document is shuffled.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunetable.llm.base import doc_id_of, keyed_texts, table
from tunetable.llm.tokens import LOWER, mixed, starts_in_rows, text_slices
from tunetable.llm.tokens import window_hashes, word_hashes, word_spans
from tunetable.session import ship_package

MIN_WORDS = 5
COVERAGE = 0.5
#: Text bytes of the benchmark items that go to the tasks at once.
BLOCK_BYTES = 8 << 20
#: What stands for the word beyond the edge of an item and of a document; they differ, so matches end there.
ITEM_EDGE, DOC_EDGE = 1, 2

SPLIT = np.ones(256, bool)
SPLIT[0x30:0x3A] = SPLIT[0x61:0x7B] = SPLIT[0x80:] = False

PAIRS = (
    "k_id long, k_tie long, item_id long, item_words long, covered_words long, n_tiles long, "
    "longest_tile long"
)


def _hashed(column: pa.Array):
    """(first row, hashes of the words, first word of each row) per run of rows."""
    for low, _, data, offsets in text_slices(column):
        data = LOWER[data]
        starts, ends, first = word_spans(data, offsets, SPLIT)
        yield low, word_hashes(data, starts, ends), first


class Seeds:
    """The windows of a block of items, sorted by hash, and a bitmap in front of them.

    Each window also knows the words before and after it. A match begins where a window has an equal one
    and the words before them differ, and ends where those after them differ, so matches are found by
    their two edges: text that repeats itself costs what its matches number, not its pairs of windows.
    """

    BITS = 22

    def __init__(self, ids: list[int | None], texts: list[bytes], size: int):
        hashes, items, places, lengths, around = [], [], [], [], ([], [])
        for low, words, first in _hashed(pa.array(texts, pa.large_binary())):
            window, row, position, before, after = _windows(words, first, size, ITEM_EDGE)
            hashes.append(window)
            items.append(row + low)
            places.append(position)
            lengths.append(np.diff(first))
            around[0].append(before)
            around[1].append(after)
        self.ids, self.size = ids, size
        self.lengths = np.concatenate(lengths or [np.zeros(0, np.int64)])
        value = np.concatenate(hashes or [np.zeros(0, np.uint64)])
        item = np.concatenate(items or [np.zeros(0, np.int64)])
        place = np.concatenate(places or [np.zeros(0, np.int64)])
        self.sides = []
        for words in around:
            both = _with(value, np.concatenate(words or [np.zeros(0, np.uint64)]))
            order = np.lexsort((both, value))
            known, start, count = np.unique(both[order], return_index=True, return_counts=True)
            self.sides.append((value[order], item[order], place[order], known, start, count))
        self.bitmap = np.zeros(1 << self.BITS, bool)
        self.bitmap[value & np.uint64((1 << self.BITS) - 1)] = True

    def edges(self, hashes: np.ndarray, words: np.ndarray, side: int):
        """(index into `hashes`, item, place) of every equal window whose word on that side differs."""
        value, item, place, known, start, count = self.sides[side]
        at = np.flatnonzero(self.bitmap[hashes & np.uint64((1 << self.BITS) - 1)])
        low = np.searchsorted(value, hashes[at], "left")
        high = np.searchsorted(value, hashes[at], "right")
        at, low, high = at[high > low], low[high > low], high[high > low]
        if not len(at):
            none = np.zeros(0, np.int64)
            return none, none, none
        both = _with(hashes[at], words[at])
        same = np.minimum(np.searchsorted(known, both), len(known) - 1)
        has = known[same] == both
        cut = np.where(has, start[same], high)
        on = np.where(has, start[same] + count[same], high)
        indices, seeds = [], []
        for a, b in ((low, cut), (on, high)):
            n = b - a
            indices.append(np.repeat(at, n))
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            seeds.append(np.repeat(a, n) + step)
        seed = np.concatenate(seeds)
        return np.concatenate(indices), item[seed], place[seed]


def _with(hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
    return mixed(hashes ^ mixed(words))


def _windows(words: np.ndarray, first: np.ndarray, size: int, edge: int):
    """(hash, row, place in the row, word before, word after) of each window; `edge` is beyond a row."""
    index, row, position = starts_in_rows(first, size)
    padded = np.concatenate([np.full(1, edge, np.uint64), words, np.full(1, edge, np.uint64)])
    before = np.where(position == 0, np.uint64(edge), padded[index])
    last = index + size == first[row + 1]
    after = np.where(last, np.uint64(edge), padded[np.minimum(index + size + 1, len(padded) - 1)])
    return window_hashes(words, size)[index], row, position, before, after


def tiles(
    doc: np.ndarray, item: np.ndarray, length: np.ndarray, size: int
) -> list[tuple[int, int, int]]:
    """(place in the document, place in the item, words) of each tile, from all maximal matches.

    The longest goes first; a match that an earlier tile cuts comes back with what is left of it, if that
    is long enough. When no free run of the item is long enough, the rest is not looked at.
    """
    queue = [(-n, i, d) for n, i, d in zip(length.tolist(), item.tolist(), doc.tolist())]
    heapq.heapify(queue)
    low_doc, low_item = int(doc.min()), int(item.min())
    free_doc = np.ones(int((doc + length).max()) - low_doc, bool)
    free_item = np.ones(int((item + length).max()) - low_item, bool)
    out = []
    while queue:
        n, i, d = heapq.heappop(queue)
        free = free_item[i - low_item : i - low_item - n] & free_doc[d - low_doc : d - low_doc - n]
        if free.all():
            out.append((d, i, -n))
            free_item[i - low_item : i - low_item - n] = False
            free_doc[d - low_doc : d - low_doc - n] = False
            if max((b - a for a, b in _runs(free_item)), default=0) < size:
                break
            continue
        if free.any():
            for a, b in _runs(free):
                if b - a >= size:
                    heapq.heappush(queue, (a - b, i + a, d + a))
    return out


def _runs(free: np.ndarray) -> list[tuple[int, int]]:
    """(begin, end) of each run of true values."""
    change = np.flatnonzero(np.diff(np.concatenate([[False], free, [False]]).astype(np.int8)))
    return list(zip(change[::2].tolist(), change[1::2].tolist()))


def _matches(words: np.ndarray, first: np.ndarray, seeds: Seeds):
    """(row, item, place in the document, place in the item, words) of all maximal matches, sorted."""
    window, row, position, before, after = _windows(words, first, seeds.size, DOC_EDGE)
    ends = []
    for side, beyond in ((0, before), (1, after)):
        at, item, place = seeds.edges(window, beyond, side)
        # along a diagonal of one row and item, beginnings and ends alternate
        order = np.lexsort((place, position[at] - place, item, row[at]))
        ends.append((row[at][order], item[order], position[at][order], place[order]))
    (row, item, begin, place), (_, _, end, _) = ends
    return row, item, begin, place, end - begin + seeds.size


def _tiled(batch: pa.RecordBatch, seeds: Seeds, coverage: float) -> Iterator[tuple]:
    """(row, item, covered words, tiles, longest) of the pairs that reach the coverage."""
    for low, words, first in _hashed(batch["body"]):
        row, item, begin, place, length = _matches(words, first, seeds)
        new = np.ones(len(row), bool)
        new[1:] = (np.diff(row) != 0) | (np.diff(item) != 0)
        cuts = np.flatnonzero(new)
        for a, b in zip(cuts.tolist(), np.append(cuts[1:], len(row)).tolist()):
            # an upper bound first: the item's words that lie under any match
            need = coverage * seeds.lengths[item[a]]
            if length[a:b].sum() < need:
                continue
            covered = np.zeros(seeds.lengths[item[a]] + 1, np.int64)
            np.add.at(covered, place[a:b], 1)
            np.subtract.at(covered, place[a:b] + length[a:b], 1)
            if np.count_nonzero(np.cumsum(covered)) < need:
                continue
            found = tiles(begin[a:b], place[a:b], length[a:b], seeds.size)
            total = sum(n for _, _, n in found)
            if total >= need:
                yield low + row[a], item[a], total, len(found), max(n for _, _, n in found)


def contaminated_pairs(
    docs: DataFrame,
    benchmark: DataFrame,
    min_words: int = MIN_WORDS,
    coverage: float = COVERAGE,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(k_id, k_tie, item_id, item_words, covered_words, n_tiles, longest_tile) of contaminated rows.

    One row per row of `docs` and item of `benchmark` that tiles cover. Null and short texts, of fewer
    than `min_words` words, match nothing on either side. Items with the same item_id count one by one.
    """
    spark = docs.sparkSession
    ship_package(spark)
    texts = keyed_texts(docs)
    items = benchmark.select(
        F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("body")
    ).filter("body is not null")
    total = items.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    part = F.pmod(F.xxhash64("item_id", "body"), F.lit(blocks))
    out = None
    for number in range(blocks):
        rows = items.filter(part == number).orderBy("item_id", "body").collect()
        seeds = Seeds([r["item_id"] for r in rows], [bytes(r["body"]) for r in rows], min_words)
        found = _pairs_of(texts, spark.sparkContext.broadcast(seeds), coverage)
        out = found if out is None else out.unionByName(found)
    return out


def _pairs_of(texts: DataFrame, sent, coverage: float) -> DataFrame:
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = sent.value
        for batch in batches:
            found = list(_tiled(batch, seeds, coverage))
            if found:
                at = pa.array([int(x[0]) for x in found])
                item = [int(x[1]) for x in found]
                numbers = [[int(x[k]) for x in found] for k in (2, 3, 4)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["k_id"].take(at),
                        batch["k_tie"].take(at),
                        pa.array([seeds.ids[i] for i in item], pa.int64()),
                        pa.array([int(seeds.lengths[i]) for i in item], pa.int64()),
                        *(pa.array(x, pa.int64()) for x in numbers),
                    ],
                    [c.split()[0] for c in PAIRS.split(", ")],
                )

    return texts.mapInArrow(match, PAIRS)


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contaminated documents with each benchmark item that they hold."""
    pairs = contaminated_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return pairs.select(
        doc_id_of().alias("doc_id"),
        "item_id",
        "item_words",
        "covered_words",
        F.round(F.col("covered_words") / F.col("item_words"), 6).alias("coverage"),
        "n_tiles",
        "longest_tile",
    )
