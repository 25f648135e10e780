"""Ranked lexical search of many items at once, with common subexpressions evaluated once.

Terms are the runs of ASCII letters, digits and characters above ASCII, with A-Z lower-cased. A document's
score for an item is the sum over the item's terms, repeats included, of the term's weight times a saturated
frequency; the README states the formula, which is in whole numbers but for the weight's logarithm.

Method: the items come in blocks of bounded text. In a block the terms of every item are sorted by the number
of items that have them, so that items with common terms have them side by side. Rounds of pairing then mine
the shared term sets: a pair of neighbours that occurs at least twice becomes a node of the sharing DAG and
stands for both wherever it was chosen, so nodes of later rounds are larger sets. A document's partial score of
each term and each node is computed once; an item adds up the few nodes that its terms came to.

Two passes per block over all documents: the first stores each document's length and its frequencies of the
block's terms, from which the counts over the corpus follow; the second scores the stored rows. Each task keeps
the best `k` documents of every item, so a few rows per task and item are shuffled for the final ranking.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tunetable.llm.base import doc_id_of, table
from tunetable.llm.tokens import LOWER, text_slices, word_hashes, word_spans
from tunetable.session import ship_package, written

BEST = 20
#: Text bytes of the items that are evaluated together; a larger item is a block of its own.
BLOCK_BYTES = 2 << 20
#: Partial scores that a task holds at once, of 8 bytes each.
HELD_SCORES = 4 << 20

NOT_TERM = np.ones(256, bool)
NOT_TERM[0x30:0x3A] = NOT_TERM[0x41:0x5B] = NOT_TERM[0x61:0x7B] = NOT_TERM[0x80:] = False

PLAN = "block int, kind string, number int, item_id long, hash long, parts array<int>"
FORWARD = "k_id long, n long, terms binary, times binary"


def _terms(column: pa.Array):
    """(first row, hashes of the terms, first term of each row) per run of rows."""
    for low, _, data, offsets in text_slices(column):
        data = LOWER[data]
        starts, ends, first = word_spans(data, offsets, NOT_TERM)
        yield low, word_hashes(data, starts, ends), first


def shared_nodes(sequences: np.ndarray, item: np.ndarray, leaves: int):
    """(rounds of (left, right) node numbers, what is left of the sequences, its items).

    `sequences` holds the terms of all items, 0 to leaves - 1, item after item. Nodes are numbered on in the
    order of the rounds. A pair is chosen where it occurs more often than the pairs that overlap it.
    """
    rounds = []
    known = leaves
    while len(sequences) > 1:
        both = item[:-1] == item[1:]
        pair = sequences[:-1].astype(np.int64) * known + sequences[1:]
        _, place, times = np.unique(np.where(both, pair, -1), return_inverse=True, return_counts=True)
        often = np.where(both, times[place], 0)
        # equal counts: the smaller pair number, so that a pair is treated alike in every item
        padded = np.concatenate([[0], often, [0]])
        number = np.concatenate([[0], pair, [0]])
        before = (often > padded[:-2]) | ((often == padded[:-2]) & (pair < number[:-2]))
        after = (often > padded[2:]) | ((often == padded[2:]) & (pair <= number[2:]))
        chosen = np.flatnonzero((often > 1) & before & after)
        made, place, times = np.unique(pair[chosen], return_inverse=True, return_counts=True)
        lasting = times > 1
        if not lasting.any():
            break
        new = np.cumsum(lasting) - 1 + known
        chosen, place = chosen[lasting[place]], place[lasting[place]]
        rounds.append((made[lasting] // known, made[lasting] % known))
        sequences = sequences.copy()
        sequences[chosen] = new[place]
        kept = np.ones(len(sequences), bool)
        kept[chosen + 1] = False
        sequences, item = sequences[kept], item[kept]
        known += int(lasting.sum())
    return rounds, sequences, item


def _mined(block: int, items: pa.Table) -> pa.Table:
    """The plan of a block as rows: its terms by hash, the nodes, and each item as a list of nodes."""
    items = items.combine_chunks()
    hashes, owners = [], []
    for low, words, first in _terms(items["body"].combine_chunks()):
        hashes.append(words)
        owners.append(low + np.repeat(np.arange(len(first) - 1), np.diff(first)))
    hashes = np.concatenate(hashes or [np.zeros(0, np.uint64)])
    owner = np.concatenate(owners or [np.zeros(0, np.int64)])
    value, term = np.unique(hashes, return_inverse=True)
    # in how many items a term occurs
    pairs = np.unique(owner * max(len(value), 1) + term)
    usage = np.bincount(pairs % max(len(value), 1), minlength=len(value))
    order = np.lexsort((term, -usage[term], owner))
    rounds, left, item = shared_nodes(term[order], owner[order], len(value))
    sides = [np.concatenate([r[k] for r in rounds]) if rounds else np.zeros(0, int) for k in (0, 1)]
    stage = np.repeat(np.arange(len(rounds)), [len(r[0]) for r in rounds])
    having = np.unique(item)
    ids = items["item_id"].to_pylist()
    ends = np.append(np.searchsorted(item, having), len(item))
    n_terms, n_nodes, n_items = len(value), len(stage), len(having)
    nothing = lambda n: [None] * n
    rows = n_terms + n_nodes + n_items
    return pa.table(
        [
            pa.array([block] * rows, pa.int32()),
            pa.array(["term"] * n_terms + ["node"] * n_nodes + ["item"] * n_items),
            pa.array([*range(n_terms), *stage.tolist(), *range(n_items)], pa.int32()),
            pa.array(nothing(n_terms + n_nodes) + [ids[i] for i in having.tolist()], pa.int64()),
            pa.array(value.view(np.int64).tolist() + nothing(n_nodes + n_items), pa.int64()),
            pa.array(
                nothing(n_terms)
                + np.stack(sides, axis=1).tolist()
                + [left[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])],
                pa.list_(pa.int32()),
            ),
        ],
        names=[c.split()[0] for c in PLAN.split(", ")],
    )


def sharing_plans(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The stored plans of all blocks of the distinct items; see `_mined` for the rows."""
    ship_package(benchmark.sparkSession)
    items = benchmark.select(
        F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("body")
    )
    items = items.filter("body is not null").distinct()
    total = items.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    items = items.withColumn("block", F.pmod(F.xxhash64("item_id", "body"), F.lit(blocks)).cast("int"))

    def mine(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        return _mined(key[0].as_py(), group.sort_by([("item_id", "ascending"), ("body", "ascending")]))

    return written(items.groupBy("block").applyInArrow(mine, PLAN), "sharing-plans")


@dataclass
class Plan:
    """One block: sorted term hashes, node pairs by round, and the node lists of the items."""

    terms: np.ndarray
    rounds: list[tuple[np.ndarray, np.ndarray]]
    ids: list[int | None]
    parts: np.ndarray
    offsets: np.ndarray

    def scores(self, partial: np.ndarray) -> np.ndarray:
        """Scores (item, document) of partial scores (term, document)."""
        nodes = len(self.terms) + sum(len(left) for left, _ in self.rounds)
        made = np.zeros((nodes, partial.shape[1]), np.int64)
        known = len(self.terms)
        made[:known] = partial
        for left, right in self.rounds:
            np.add(made[left], made[right], out=made[known : known + len(left)])
            known += len(left)
        return np.add.reduceat(made[self.parts], self.offsets, axis=0)

    def at_once(self) -> int:
        """Documents whose partial scores are held at once."""
        nodes = len(self.terms) + sum(len(left) for left, _ in self.rounds) + len(self.parts)
        return min(4096, max(8, HELD_SCORES // max(1, nodes)))


def _plan(rows: list) -> Plan:
    terms = sorted((r["number"], r["hash"]) for r in rows if r["kind"] == "term")
    nodes: dict[int, list] = {}
    for r in rows:
        if r["kind"] == "node":
            nodes.setdefault(r["number"], []).append(tuple(r["parts"]))
    items = sorted((r["number"], r["item_id"], r["parts"]) for r in rows if r["kind"] == "item")
    lengths = [len(parts) for _, _, parts in items]
    return Plan(
        np.array([h for _, h in terms], np.int64).view(np.uint64),
        [tuple(np.array(nodes[k], np.int64).T) for k in sorted(nodes)],
        [i for _, i, _ in items],
        np.array([p for _, _, parts in items for p in parts], np.int64),
        np.cumsum([0, *lengths[:-1]]),
    )


def _ordered(rows: list) -> list:
    """Nodes in the order in which rounds numbered them: by round, then by the pair."""
    return sorted(rows, key=lambda r: (r["kind"], r["number"], r["parts"] or []))


def _forward(docs: DataFrame, terms) -> DataFrame:
    """(k_id, n, terms, times): per document with a term its length and its frequencies of known terms."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = terms.value
        for batch in batches:
            for low, words, first in _terms(batch["body"]):
                place = np.searchsorted(known, words)
                place[place == len(known)] = 0
                hit = np.flatnonzero(known[place] == words) if len(known) else np.zeros(0, int)
                row = np.searchsorted(first, hit, "right") - 1
                pair, times = np.unique(row * len(known) + place[hit], return_counts=True)
                n = np.diff(first)
                full = np.flatnonzero(n)
                cuts = np.searchsorted(pair, np.append(full, len(n)) * len(known))
                term = (pair % max(len(known), 1)).astype(np.int32)
                times = times.astype(np.int32)
                spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["k_id"].take(pa.array(low + full)),
                        pa.array(n[full], pa.int64()),
                        pa.array([term[a:b].tobytes() for a, b in spans], pa.binary()),
                        pa.array([times[a:b].tobytes() for a, b in spans], pa.binary()),
                    ],
                    [c.split()[0] for c in FORWARD.split(", ")],
                )

    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("k_id"),
        F.col("text").cast("binary").alias("body"),
    )
    return written(rows.mapInArrow(count, FORWARD), "forward")


def _flat(batch: pa.RecordBatch, low: int, high: int):
    """(document, term, frequency) of rows of the forward table."""
    raw = [batch["terms"][i].as_buffer() for i in range(low, high)]
    counts = np.array([len(x) // 4 for x in raw], np.int64)
    term = np.frombuffer(b"".join(raw), np.int32)
    times = np.frombuffer(b"".join(batch["times"][i].as_buffer() for i in range(low, high)), np.int32)
    return np.repeat(np.arange(high - low), counts), term, times.astype(np.int64)


def _document_counts(forward: DataFrame, terms: int) -> np.ndarray:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(terms, np.int64)
        for batch in batches:
            held += np.bincount(_flat(batch, 0, batch.num_rows)[1], minlength=terms)
        seen = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen.astype(np.int32)), pa.array(held[seen])], ["term", "df"]
        )

    out = np.zeros(terms, np.int64)
    found = forward.select("terms", "times").mapInArrow(count, "term int, df long")
    for row in found.groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[row["term"]] = row["df"]
    return out


class Leaders:
    """The best `k` documents of every item so far: larger scores first, ties to smaller ids."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.item = np.zeros(0, np.int64)
        self.score = np.zeros(0, np.int64)
        self.doc = np.zeros(0, np.int64)
        self.floor = np.ones(items, np.int64)

    def add(self, scores: np.ndarray, docs: np.ndarray) -> None:
        item, at = np.nonzero(scores >= self.floor[:, None])
        item, score, doc = (
            np.concatenate(pair)
            for pair in ((self.item, item), (self.score, scores[item, at]), (self.doc, docs[at]))
        )
        order = np.lexsort((doc, -score, item))
        item, score, doc = item[order], score[order], doc[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        kept = place < self.k
        self.item, self.score, self.doc = item[kept], score[kept], doc[kept]
        last = place == self.k - 1
        self.floor[item[last]] = score[last]


def _ranked(forward: DataFrame, plan: Plan, k: int) -> DataFrame:
    """(number, item_id, k_id, score): the best documents of each item per task."""
    spark = forward.sparkSession
    totals = forward.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    docs, length = totals["docs"], totals["terms"]
    df = _document_counts(forward, len(plan.terms))
    weight = np.floor(1000 * np.log((2 * docs + 2) / (2 * df + 1))).astype(np.int64)
    sent = spark.sparkContext.broadcast((plan, weight))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, weight = sent.value
        best = Leaders(len(plan.ids), k)
        step = plan.at_once()
        for batch in batches:
            ids, n = batch["k_id"].to_numpy(), batch["n"].to_numpy()
            damping = 75 + (25 * n * docs) // length
            for low in range(0, batch.num_rows, step):
                high = min(low + step, batch.num_rows)
                doc, term, times = _flat(batch, low, high)
                partial = np.zeros((len(plan.terms), high - low), np.int64)
                saturated = (1000000000 * times) // (1000 * times + 12 * damping[low:high][doc])
                partial[term, doc] = weight[term] * saturated
                best.add(plan.scores(partial), ids[low:high])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(best.item.astype(np.int32)),
                pa.array([plan.ids[i] for i in best.item.tolist()], pa.int64()),
                pa.array(best.doc),
                pa.array(best.score),
            ],
            ["number", "item_id", "k_id", "score"],
        )

    return forward.mapInArrow(score, "number int, item_id long, k_id long, score long")


def search(
    docs: DataFrame, benchmark: DataFrame, k: int = BEST, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """(item_id, rank, doc_id, score): the `k` best documents of every item with a score above 0.

    Items with the same item_id and different texts are ranked one by one; repeated items once. A null text
    is no item and a document without terms. Rows of `docs` with the same doc_id are documents of their own;
    a null doc_id counts as the smallest. Terms are compared by a 64-bit hash.
    """
    spark = docs.sparkSession
    ship_package(spark)
    plans = sharing_plans(benchmark, block_bytes)
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for row in plans.filter("kind = 'item'").select("block").distinct().orderBy("block").collect():
        plan = _plan(_ordered(plans.filter(F.col("block") == row["block"]).collect()))
        forward = _forward(docs, spark.sparkContext.broadcast(plan.terms))
        if forward.isEmpty():
            return out
        found = _ranked(forward, plan, k)
        place = F.row_number().over(W.partitionBy("number").orderBy(F.desc("score"), "k_id"))
        found = found.withColumn("rank", place).filter(F.col("rank") <= k)
        out = out.unionByName(found.select("item_id", "rank", doc_id_of().alias("doc_id"), "score"))
    return out


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best documents of every benchmark item."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SPLIT = (
    f"regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), "
    r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
)

SQL = f"""
with split as materialized (select row_number() over () as r, doc_id, {_SPLIT} as ts
    from documents where text is not null),
docs as (select r, doc_id, len(ts)::bigint as n from split where len(ts) > 0),
totals as (select count(*)::bigint as docs, sum(n)::bigint as terms from docs),
damped as (select r, doc_id, 75 + (25 * n * docs) // terms as m from docs, totals),
times as materialized (select r, t, count(*)::bigint as tf
    from (select r, unnest(ts) as t from split) group by all),
items as (select row_number() over () as i, item_id, text
    from (select distinct item_id, text from benchmark where text is not null)),
wanted as (select i, t, count(*)::bigint as k from (select i, unnest({_SPLIT}) as t from items) group by all),
weighed as (select t, floor(1000 * ln((2.0 * docs + 2) / (2.0 * df + 1)))::bigint as w
    from (select t, count(*) as df from times where t in (select t from wanted) group by t), totals),
scored as (select i, r, doc_id,
    sum(k * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::bigint as score
    from wanted join weighed using (t) join times using (t) join damped using (r) group by all),
ranked as (select i, doc_id, score,
    (row_number() over (partition by i order by score desc, doc_id nulls first))::integer as rank
    from scored where score > 0)
select item_id, rank, doc_id, score from ranked join items using (i) where rank <= {BEST}
"""
