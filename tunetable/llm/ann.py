"""Approximate nearest neighbours by cosine, with randomly rotated one-bit codes.

An inverted file of spherical k-means centres (fitted on a bounded sample) places every vector in its
nearest cluster; a query looks into its nearest clusters. Inside a cluster each vector's unit residual to
the centre is rotated at random and kept as one bit per dimension, packed, with two correction
scalars: its length and the inner product of the residual with its own code. From these the inner
product with a query's residual is estimated, and its error is bounded with high probability by
EPSILON * sqrt((1 - a^2) / (a^2 (D - 1))), a being that inner product (Gao and Long 2024). Vectors whose
upper bound reaches the k-th largest lower bound are scored exactly on the original values.

Equal vectors are one class. A query's own id is one id, so the rows of the best k + 1 different ids hold its
answer, at most k rows of each: a class keeps its k + 1 smallest ids with the number of rows of each, and a
vector that a third of all rows repeat costs as much as any other. Clusters and query sets are cut
into blocks of bounded size, and a block pair is one group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tunetable.llm.base import table
from tunetable.session import ship_package, written

NEAREST = 5
#: Bounds of the fit: centres, sample vectors per centre, k-means rounds.
MOST_CENTRES = 4096
SAMPLE_PER_CENTRE = 48
ROUNDS = 8
#: Clusters that a query looks into: this share, the nearest first, and more until they hold enough
#: vectors. Vectors without much structure need a large share; measured recall is in the README.
PROBE_SHARE = 0.65
LEAST_CANDIDATES = 256
#: Vectors and queries per group of work.
BLOCK = 1 << 14
QUERY_BLOCK = 1 << 10
#: Width of the error bound; 1.9 misses less than one vector in a thousand.
EPSILON = 1.9
SEED = 9

FOUND = "q_id long, q_tie long, vec_id long, copies long, score double"


def valid(vector: Column) -> Column:
    """Not null, not zero, all components finite."""
    usable = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(
        F.forall(vector, usable) & F.exists(vector, lambda x: x != 0), F.lit(False)
    )


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)


def _unit(x: np.ndarray) -> np.ndarray:
    # scaled first, so that squares neither overflow nor vanish
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit_centres(sample: np.ndarray, count: int) -> np.ndarray:
    """Spherical k-means; a centre that loses all its vectors keeps its place."""
    random = np.random.default_rng(SEED)
    centres = sample[random.choice(len(sample), min(count, len(sample)), replace=False)]
    for _ in range(ROUNDS):
        owner = np.concatenate(
            [(part @ centres.T).argmax(axis=1) for part in np.array_split(sample, len(sample) // 4096 + 1)]
        )
        order = np.argsort(owner, kind="stable")
        heads = np.flatnonzero(np.diff(owner[order], prepend=-1))
        sums = np.add.reduceat(sample[order], heads, axis=0)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        moved = owner[order][heads][length[:, 0] > 0]
        centres[moved] = (sums / np.where(length > 0, length, 1))[length[:, 0] > 0]
    return centres


def rotation(dimension: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dimension, dimension)))
    return q * np.sign(np.diag(r))


class Codes:
    """Packed one-bit codes of the vectors of one cluster."""

    def __init__(self, unit: np.ndarray, centre: np.ndarray, turn: np.ndarray):
        self.centre, self.turn = centre, turn
        residual = (unit - centre) @ turn
        self.length = np.linalg.norm(residual, axis=1)
        residual /= np.where(self.length > 0, self.length, 1)[:, None]
        self.packed = np.packbits(residual > 0, axis=1)
        self.dimension = residual.shape[1]
        self.own = np.abs(residual).sum(axis=1) / math.sqrt(self.dimension)

    def estimate(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(estimated cosines, error bounds) of each query (row) with each vector."""
        residual = (unit - self.centre) @ self.turn
        length = np.linalg.norm(residual, axis=1)
        residual /= np.where(length > 0, length, 1)[:, None]
        signs = np.unpackbits(self.packed, axis=1, count=self.dimension).astype(np.float32) * 2 - 1
        own = np.where(self.own > 0, self.own, 1)
        inner = (residual.astype(np.float32) @ signs.T) / math.sqrt(self.dimension) / own
        error = EPSILON * np.sqrt(
            np.maximum(0, 1 - own**2) / (own**2 * max(1, self.dimension - 1))
        )
        scale = length[:, None] * self.length
        base = 1 - (length[:, None] ** 2 + self.length**2) / 2
        return base + scale * inner, scale * error + 1e-5


def cosines(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact scores in double precision, each row by itself, so equal rows have equal scores."""
    a, b = np.abs(vectors).max(axis=1, keepdims=True), np.abs(query).max()
    vectors, query = vectors / a, query / b
    dots = (vectors * query).sum(axis=1)
    return dots / (np.sqrt((vectors * vectors).sum(axis=1)) * math.sqrt((query * query).sum()))


def search(codes: Codes, vectors, ids, query_units, queries, keep: int):
    """Per query (row indices, exact scores) of the vectors of its `keep` best ids, ties to smaller ids.

    An id with several vectors is placed by its best one; `keep` of its vectors are returned at most.
    """
    about, error = codes.estimate(query_units)
    order = np.argsort(ids, kind="stable")
    heads = np.flatnonzero(np.diff(ids[order], prepend=ids[order[:1]] - 1))
    low = np.maximum.reduceat((about - error)[:, order], heads, axis=1)
    k = min(keep, len(heads))
    floor = np.partition(low, len(heads) - k, axis=1)[:, len(heads) - k]
    for number, query in enumerate(queries):
        chosen = np.flatnonzero(about[number] + error[number] >= floor[number])
        scores = cosines(vectors[chosen], query)
        best = np.lexsort((ids[chosen], -scores))
        _, first, of = np.unique(ids[chosen][best], return_index=True, return_inverse=True)
        if len(first) < len(best):
            place = np.argsort(np.argsort(first))[of]
            nth = np.zeros(len(best), np.int64)
            by_id = np.argsort(of, kind="stable")
            nth[by_id] = np.arange(len(best)) - np.searchsorted(of[by_id], of[by_id])
            best = best[(place < keep) & (nth < keep)]
        else:
            best = best[:keep]
        yield number, chosen[best], scores[best]


def nearest(
    vectors: DataFrame, is_query: Column, k: int = NEAREST, share: float = PROBE_SHARE
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found of each query row.

    `vectors` has vec_id and embedding. Rows whose vector is null, zero, or holds a null or a
    non-finite component take no part, nor do those whose length differs from the most frequent one
    (the larger on ties), or those without vec_id. Repeated rows are candidates of their own, but a
    query is asked once; a vec_id with several vectors is asked with each.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("embedding").cast("array<double>").alias("vec"),
        is_query.alias("is_query"),
    ).filter(valid(F.col("vec")) & F.col("vec_id").isNotNull())
    sizes = rows.groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("n"))
    most = sizes.agg(F.max(F.struct("n", "d")).alias("m")).first()["m"]
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if most is None:
        return empty
    dimension, total = most["d"], most["n"]
    rows = rows.filter(F.size("vec") == dimension)
    rows = rows.withColumn("one", F.xxhash64("vec")).withColumn("two", F.xxhash64(F.lit(1), "vec"))
    by_id = rows.groupBy("one", "two", "vec_id")
    by_id = by_id.agg(F.first("vec").alias("vec"), F.count("*").alias("copies"))
    nth = F.row_number().over(W.partitionBy("one", "two").orderBy("vec_id"))
    kept = written(by_id.withColumn("nth", nth).filter(F.col("nth") <= k + 1), "vectors")
    asked = rows.filter("is_query").select("vec_id", "one", "two").distinct()
    classes = rows.filter("is_query").groupBy("one", "two").agg(F.first("vec").alias("vec"))

    count = min(MOST_CENTRES, math.ceil(math.sqrt(total)))
    wanted = min(1.0, 1.2 * count * SAMPLE_PER_CENTRE / total)
    drawn = kept.filter("nth = 1").filter(
        F.pmod(F.xxhash64(F.lit(SEED), "vec_id"), F.lit(1 << 20)) < int(wanted * (1 << 20)) + 1
    )
    sample = drawn.orderBy(F.xxhash64(F.lit(SEED), "vec_id")).limit(count * SAMPLE_PER_CENTRE)
    sample = np.array([r["vec"] for r in sample.select("vec").collect()]).reshape(-1, dimension)
    if not len(sample):
        return empty
    centres = fit_centres(_unit(sample), count)
    turn = rotation(dimension)
    sent = spark.sparkContext.broadcast((centres, turn))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                unit = _unit(_matrix(batch["vec"], dimension))
                owner = (unit @ sent.value[0].T).argmax(axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(owner), batch["vec_id"], batch["copies"], batch["vec"]],
                    ["cluster", "id", "copies", "vec"],
                )

    places = kept.select("vec_id", "copies", "vec").mapInArrow(
        assign, "cluster int, id long, copies long, vec array<double>"
    )
    places = written(places, "clusters")
    probes = math.ceil(share * len(centres))
    held = np.zeros(len(centres), np.int64)
    for row in places.groupBy("cluster").count().collect():
        held[row["cluster"]] = row["count"]

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = _unit(_matrix(batch["vec"], dimension))
            order = np.argsort(-(unit @ sent.value[0].T), axis=1, kind="stable")
            seen = np.cumsum(held[order], axis=1) - held[order]
            rank = np.arange(order.shape[1])
            look = (held[order] > 0) & ((rank < probes) | (seen < LEAST_CANDIDATES))
            row, at = np.nonzero(look)
            yield pa.RecordBatch.from_arrays(
                [pa.array(order[row, at].astype(np.int32))]
                + [batch[c].take(pa.array(row)) for c in ("one", "two", "vec")],
                ["cluster", "one", "two", "vec"],
            )

    looks = written(
        classes.mapInArrow(probe, "cluster int, one long, two long, vec array<double>"), "probes"
    )
    asks = np.zeros(len(centres), np.int64)
    for row in looks.groupBy("cluster").count().collect():
        asks[row["cluster"]] = row["count"]
    cuts = spark.createDataFrame(
        [
            (c, max(1, -(-int(held[c]) // BLOCK)), max(1, -(-int(asks[c]) // QUERY_BLOCK)))
            for c in range(len(centres))
        ],
        "cluster int, parts int, qparts int",
    )
    cuts = F.broadcast(cuts)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    base = places.join(cuts, "cluster").select(
        "cluster",
        F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"),
        every("qparts").alias("qpart"),
        F.lit(False).alias("is_query"),
        "id",
        F.col("copies").alias("tie"),
        "vec",
    )
    look = looks.join(cuts, "cluster").select(
        "cluster",
        every("parts").alias("part"),
        F.pmod(F.xxhash64("one", "two"), F.col("qparts")).cast("int").alias("qpart"),
        F.lit(True).alias("is_query"),
        F.col("one").alias("id"),
        F.col("two").alias("tie"),
        "vec",
    )

    def answer(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        query = group["is_query"].to_numpy()
        matrix = _matrix(group["vec"].combine_chunks(), dimension)
        ids, ties = group["id"].to_numpy(), group["tie"].to_numpy()
        vectors, queries = matrix[~query], matrix[query]
        columns: list[list[np.ndarray]] = [[], [], [], [], []]
        if len(vectors) and len(queries):
            all_centres, turned = sent.value
            codes = Codes(_unit(vectors), all_centres[group["cluster"][0].as_py()], turned)
            own, copies = ids[~query], ties[~query]
            for number, chosen, scores in search(
                codes, vectors, own, _unit(queries), queries, k + 1
            ):
                columns[0].append(np.full(len(chosen), ids[query][number]))
                columns[1].append(np.full(len(chosen), ties[query][number]))
                columns[2].append(own[chosen])
                columns[3].append(copies[chosen])
                columns[4].append(scores)
        kinds = (np.int64, np.int64, np.int64, np.int64, np.float64)
        return pa.table(
            [
                pa.array(np.concatenate(c) if c else np.zeros(0, kind))
                for c, kind in zip(columns, kinds)
            ],
            names=["q_id", "q_tie", "vec_id", "copies", "score"],
        )

    found = base.unionByName(look).groupBy("cluster", "part", "qpart").applyInArrow(answer, FOUND)
    of_id = W.partitionBy("q_id", "q_tie", "vec_id").orderBy(F.desc("score"))
    found = found.withColumn("nth", F.row_number().over(of_id)).filter(F.col("nth") <= k)
    in_order = W.partitionBy("q_id", "q_tie").orderBy(F.desc("score"), "vec_id", "nth")
    ids_before = F.sum(F.when(F.col("nth") == 1, 1).otherwise(0)).over(
        in_order.rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    found = found.withColumn("ids", ids_before).filter(F.col("ids") <= k + 1)
    every_copy = F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(k)))).alias("copy")
    found = found.select(
        F.col("q_id").alias("one"), F.col("q_tie").alias("two"), "vec_id", "score", every_copy
    )
    pairs = asked.withColumnRenamed("vec_id", "query_id").join(found, ["one", "two"])
    best = W.partitionBy("query_id", "one", "two").orderBy(F.desc("score"), "vec_id")
    pairs = pairs.filter("vec_id <> query_id").withColumn("rank", F.row_number().over(best))
    return pairs.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest rows of every fiftieth vector."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, NEAREST)
