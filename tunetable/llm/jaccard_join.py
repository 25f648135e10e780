"""Exact Jaccard self-join of word-shingle sets and its connected groups.

Two documents link when 100 * intersection >= percent * union of their distinct shingles. Steps:

1. Equal sets become one class (128-bit sums of mixed shingle hashes); one representative goes on.
2. Prefix counts: of the smallest-hash tokens of a set, n - a + n/8 + 1 with a = ceil(percent% n),
   at least n/8 occur in the same prefix of any partner. Sets with fewer shared ones have no partner.
3. Of the rest, sets with fewer than `a` shared tokens have no partner either.
4. Index lists: the rarest n - a + 1 tokens of a set, by a frequency table, are its postings. Each list
   first links its sets to one leader. Verified links form groups.
5. Set-relation skipping: a set inherits the answers of the highly similar sets of its group, so
   only pairs of different groups remain. Lists are cut into blocks by set size; blocks outside the
   size bound are skipped, and a pair is skipped when its positions in the list leave too few
   tokens. All remaining pairs are verified on the whole sets.

No pair inside a group is listed, and the answer is exact whatever the frequency table says.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tunetable.llm.base import beside, bucket_count, checked, doc_id_of, keyed_texts, table
from tunetable.llm.graph import components
from tunetable.llm.shared import shared_positions
from tunetable.llm.tokens import (
    LOWER,
    mixed,
    starts_in_rows,
    text_slices,
    window_hashes,
    word_hashes,
    word_spans,
)
from tunetable.session import ship_package, written

SHINGLE = 5
PERCENT = 75
#: Counters of the frequency table, whatever the size of the corpus.
SLOTS = 1 << 20
SLOT_PARTS = 64

KEY = ["k_id", "k_tie"]
INFO = "k_id long, k_tie long, n long, one long, two long"
SETS = "k_id long, k_tie long, n long, tokens array<long>"


def _sets(batch: pa.RecordBatch, size: int):
    """(ids, ties, row and hash of each distinct shingle sorted by row and hash, sizes) per run."""
    ids, ties = batch["k_id"].to_numpy(), batch["k_tie"].to_numpy()
    for low, high, data, offsets in text_slices(batch["body"]):
        data = LOWER[data]
        starts, ends, first = word_spans(data, offsets)
        words = word_hashes(data, starts, ends)
        index, row, _ = starts_in_rows(first, size)
        rows, hashes = [row], [window_hashes(words, size)[index]]
        counts = np.diff(first)
        for short in range(1, size):
            few = np.flatnonzero(counts == short)
            if len(few):
                rows.append(few)
                whole = window_hashes(words, short)[first[few]]
                hashes.append(mixed(whole + np.uint64(short)))
        row, value = np.concatenate(rows), np.concatenate(hashes)
        order = np.lexsort((value, row))
        row, value = row[order], value[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
        row, value = row[new], value[new]
        yield ids[low:high], ties[low:high], row, value, np.bincount(row, minlength=high - low)


def _needed(n: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap of a set of n with any partner."""
    return -(-percent * n // 100)


def _prefixes(size: int, percent: int):
    """Tokens with the smallest hashes, an eighth of the set more than the prefix bound."""

    def source(batch: pa.RecordBatch):
        for ids, ties, row, value, n in _sets(batch, size):
            length = np.minimum(n, n - _needed(n, percent) + 1 + n // 8)
            rank = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            at = rank < np.repeat(length, n)
            yield ids, ties, (row[at], np.zeros(at.sum(), np.int64), mixed(value[at]), None)

    return source


def _whole(size: int):
    def source(batch: pa.RecordBatch):
        for ids, ties, row, value, _ in _sets(batch, size):
            yield ids, ties, (row, np.zeros(len(row), np.int64), mixed(value), None)

    return source


def _info(texts: DataFrame, size: int) -> DataFrame:
    """Per row the size of its set and a 128-bit digest of it."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, ties, _, value, n in _sets(batch, size):
                ends = np.cumsum(n)
                sums = []
                for salt in (1, 2):
                    total = np.zeros(len(value) + 1, np.uint64)
                    np.cumsum(mixed(value ^ mixed(np.uint64([salt]))), out=total[1:])
                    sums.append((total[ends] - total[ends - n]).view(np.int64))
                columns = [ids, ties, n.astype(np.int64), *sums]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in columns], ["k_id", "k_tie", "n", "one", "two"]
                )

    return texts.mapInArrow(digest, INFO)


def _frequencies(texts: DataFrame, size: int) -> np.ndarray:
    """How many sets have a token of each slot; SLOTS numbers for a corpus of any size."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for _, _, _, value, _ in _sets(batch, size):
                counts += np.bincount(value & np.uint64(SLOTS - 1), minlength=SLOTS)
        if counts.any():
            parts = [x.tobytes() for x in np.split(counts, SLOT_PARTS)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(SLOT_PARTS, dtype=np.int32)), pa.array(parts, pa.binary())],
                ["part", "counts"],
            )

    def total(group: pa.Table) -> pa.Table:
        counts = sum(np.frombuffer(x.as_buffer(), np.int64) for x in group["counts"])
        return pa.table({"part": group["part"][:1], "counts": pa.array([counts.tobytes()])})

    schema = "part int, counts binary"
    rows = texts.mapInArrow(tally, schema).groupBy("part").applyInArrow(total, schema).collect()
    counts = np.zeros((SLOT_PARTS, SLOTS // SLOT_PARTS), np.int64)
    for row in rows:
        counts[row["part"]] = np.frombuffer(row["counts"], np.int64)
    return counts.reshape(-1)


def _rarest_first(texts: DataFrame, size: int) -> DataFrame:
    """Each row's whole set, ordered by (slot frequency, hash): one order for all sets."""
    frequency = texts.sparkSession.sparkContext.broadcast(_frequencies(texts, size))

    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = frequency.value
        for batch in batches:
            for ids, ties, row, value, n in _sets(batch, size):
                order = np.lexsort((value, counts[value & np.uint64(SLOTS - 1)], row))
                ends = pa.array(np.append(0, np.cumsum(n)).astype(np.int32))
                tokens = pa.ListArray.from_arrays(ends, pa.array(value[order].view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids), pa.array(ties), pa.array(n.astype(np.int64)), tokens],
                    ["k_id", "k_tie", "n", "tokens"],
                )

    return texts.mapInArrow(ordered, SETS)


def _sizes_fit(a: str, b: str, percent: int) -> Column:
    return (F.col(a) * percent <= F.col(b) * 100) & (F.col(b) * percent <= F.col(a) * 100)


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""
    left = sets.select(F.col("v").alias("a"), F.col("tokens").alias("x"))
    right = sets.select(F.col("v").alias("b"), F.col("tokens").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return (
        pairs.join(right, "b")
        .join(left, "a")
        .filter(both * 100 >= percent * (F.size("x") + F.size("y") - both))
        .select("a", "b")
    )


def _links(sets: DataFrame, percent: int) -> DataFrame:
    """Verified links (a, b) whose components are those of all links."""
    lists = sets.select(
        "v", "n", F.posexplode(F.expr(f"slice(tokens, 1, cast(n - {_share_sql(percent)} + 1 as int))"))
    ).toDF("v", "n", "i", "t")
    heads = lists.groupBy("t").agg(F.count("*").alias("c"), F.min(F.struct("n", "v")).alias("h"))
    heads = checked(
        heads.filter("c > 1").select("t", F.col("h.n").alias("hn"), F.col("h.v").alias("h")),
        "list-heads",
    )
    lists = written(lists.join(heads, "t"), "lists")
    stars = (
        lists.filter((F.col("v") != F.col("h")) & _sizes_fit("hn", "n", percent))
        .select(F.col("h").alias("a"), F.col("v").alias("b"))
        .distinct()
    )
    links = written(_linked(stars, sets, percent), "star-links")
    # two rounds name nearly all groups; a group in parts only costs some comparisons
    group = written(components(links, rounds=2), "star-groups")
    leaders = _open_lists(lists, group).select(
        F.col("v").alias("a"),
        F.col("n").alias("an"),
        F.col("i").alias("ai"),
        F.inline(F.array_distinct("leaders")),
    )
    more = leaders.filter(_may_link(percent))
    more = more.select(F.least("a", "v").alias("a"), F.greatest("a", "v").alias("b")).distinct()
    known = group.select(F.col("v").alias("a"), F.col("component").alias("b"))
    links = written(known.unionByName(_linked(more, sets, percent)), "leader-links")
    group = written(components(links, rounds=2), "leader-groups")
    opened = _open_lists(lists, group)
    step = np.log(100 / percent)
    block = F.floor(F.log(F.col("n").cast("double")) / float(step)).cast("int")
    rest = lists.join(opened.select("t").distinct(), "t", "left_semi")
    rest = _grouped(rest, group).withColumn("block", block).select("t", "block", "v", "n", "i", "g")
    opened = opened.select(
        "t",
        "main",
        F.explode(F.array(*(block + d for d in (-1, 0, 1)))).alias("block"),
        F.col("v").alias("a"),
        F.col("n").alias("an"),
        F.col("i").alias("ai"),
        F.col("g").alias("ag"),
    )
    # a pair of two open sets is looked at from one side
    pairs = opened.join(rest, ["t", "block"]).filter(
        (F.col("ag") != F.col("g"))
        & ((F.col("g") == F.col("main")) | (F.col("a") < F.col("v")))
        & _may_link(percent)
    )
    pairs = pairs.select(F.least("a", "v").alias("a"), F.greatest("a", "v").alias("b")).distinct()
    known = group.select(F.col("v").alias("a"), F.col("component").alias("b"))
    return links.unionByName(known).unionByName(_linked(pairs, sets, percent))


def _may_link(percent: int) -> Column:
    """Size bound, and what the places (ai, i) in a list leave of two sets of an and n tokens."""
    left = F.least(F.col("an") - F.col("ai"), F.col("n") - F.col("i"))
    enough = left * (100 + percent) >= (F.col("an") + F.col("n")) * percent
    return _sizes_fit("an", "n", percent) & enough


def _grouped(lists: DataFrame, group: DataFrame) -> DataFrame:
    named = group.withColumnRenamed("component", "g")
    return lists.join(named, "v", "left").withColumn("g", F.coalesce("g", "v"))


def _open_lists(lists: DataFrame, group: DataFrame) -> DataFrame:
    """(t, v, n, i, g, main, leaders): the sets outside the largest group of their list.

    A list of one group is answered already. The leaders are the smallest, the largest, the foremost and
    a hashed set of the main group; a set that links with any of them belongs to that group.
    """
    lists = _grouped(lists, group)
    place = F.struct("n", "i", "v")
    counts = lists.groupBy("t", "g").agg(
        F.count("*").alias("c"),
        F.min(place).alias("small"),
        F.max(place).alias("large"),
        F.min_by(place, F.struct("i", "v")).alias("front"),
        F.min_by(place, F.struct(F.xxhash64("v"), "v")).alias("any"),
    )
    leaders = F.array("small", "large", "front", "any")
    main = counts.groupBy("t").agg(
        F.max_by(F.struct(F.col("g").alias("main"), leaders.alias("leaders")), F.struct("c", "g"))
        .alias("m"),
        F.count("*").alias("groups"),
    )
    main = checked(main.filter("groups > 1").select("t", "m.main", "m.leaders"), "open-lists")
    return written(lists.join(main, "t").filter("g <> main"), "open-sets")


def _share_sql(percent: int) -> str:
    return f"((n * {percent} + 99) div 100)"


def near_duplicate_groups(
    docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT
) -> DataFrame:
    """(k_id, k_tie, n, c_id, c_tie): set size and the smallest row key each row is linked with.

    One row per row of `docs`; rows that agree in doc_id and text get the same result. A document
    without words has n = 0 and is its own group, as is every document without a link. A null doc_id
    is the smallest.
    """
    spark = docs.sparkSession
    ship_package(spark)
    texts = keyed_texts(docs)
    buckets = bucket_count(texts)
    info = written(_info(texts, size), "set-digests")
    copies = info.filter("n > 0").groupBy("n", "one", "two").agg(
        F.min(F.struct("k_id", "k_tie")).alias("r"), F.count("*").alias("c")
    )
    copies = checked(copies.filter("c > 1").drop("c"), "copies")
    members = info.join(copies, ["n", "one", "two"], "left").select(
        *KEY, "n", F.coalesce("r", F.struct(*KEY)).alias("r")
    )
    alone = members.filter((F.col("r") == F.struct(*KEY)) & (F.col("n") > 0))
    alone = alone.select(*KEY, "n").distinct()

    def shared(rows: DataFrame, source, least: Column) -> DataFrame:
        counts = shared_positions(rows, source, buckets, keep_first=False, counts_only=True)
        known = counts.join(alone, KEY).filter(F.col("n_marks") >= least)
        return written(known.select(*KEY), "candidates")

    some = F.greatest(F.lit(1), F.floor(F.col("n") / 8))
    near = beside(texts, shared(texts, _prefixes(size, percent), some), "inner")
    near = written(near, "candidate-texts")
    near = beside(near, shared(near, _whole(size), F.expr(_share_sql(percent))), "inner")
    sets = written(_rarest_first(near, size), "sets")
    sets = sets.select(F.struct(*KEY).alias("v"), "n", "tokens")
    links = written(_links(sets, percent), "links")
    groups = checked(components(links).withColumnRenamed("v", "r"), "groups")
    return members.join(groups, "r", "left").select(
        *KEY,
        "n",
        F.coalesce("component", "r").getField("k_id").alias("c_id"),
        F.coalesce("component", "r").getField("k_tie").alias("c_tie"),
    )


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the size of its shingle set and the smallest doc_id that it reaches by links."""
    docs = table(spark, sf_dir, "documents")
    groups = near_duplicate_groups(docs, SHINGLE, PERCENT)
    return groups.select(
        doc_id_of().alias("doc_id"),
        F.col("n").alias("n_shingles"),
        doc_id_of("c_id").alias("component_id"),
    )
