"""Deterministic sampling, splitting, numbering and batching.

Rows are ordered by ``md5(seed:key)``. Every operator here needs a key that is unique per row.
The exact operators find one cut-off hash from a few small counting passes over the key column and
then run as a plain filter, so the data itself is neither sorted nor shuffled.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tunetable.functions.text import as_column
from tunetable.session import written

# The seed and evaluation share of the reference job.
DEFAULT_SEED = 42
DEFAULT_EVAL_FRACTION = 0.05

DIGEST_DIGITS = 32
BUCKET_DIGITS = 4  # hex digits per counting pass: at most 65,536 counters reach the driver
RANKED_ROWS = 50_000  # a bucket of at most this many (hash, key) rows is ranked directly


def hash_order(key: Column | str, seed: int = DEFAULT_SEED) -> Column:
    """A null key is ordered like an empty one."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(as_column(key).cast("string"), F.lit(""))))


def hash_prefix(digest: Column, digits: int = BUCKET_DIGITS) -> Column:
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("long")


@dataclass(frozen=True)
class CutOff:
    """The hash (and key, for equal hashes) of the last row that is still inside."""

    digest: str
    key: object

    def includes(self, digest: Column, key: Column) -> Column:
        # null is the smallest key
        before = key.isNull() if self.key is None else key.isNull() | (key <= F.lit(self.key))
        return (digest < self.digest) | ((digest == self.digest) & before)


def keyed_digests(df: DataFrame, key: str, seed: int = DEFAULT_SEED) -> DataFrame:
    return df.select(F.col(key).alias("key"), hash_order(key, seed).alias("digest"))


def prefix_counts(keyed: DataFrame, prefix: str = "") -> list[tuple[str, int]]:
    """Rows per next four hex digits of the digests that start with ``prefix``, in order."""
    counts = (
        keyed.filter(F.col("digest").startswith(prefix))
        .groupBy(F.substring("digest", len(prefix) + 1, BUCKET_DIGITS).alias("part"))
        .count()
        .collect()
    )
    return sorted((r["part"], r["count"]) for r in counts)


def cut_off(keyed: DataFrame, n: int, counts: list[tuple[str, int]] | None = None) -> CutOff:
    """Cut-off of the first ``n`` of some (key, digest) rows; needs ``1 <= n <= rows``.

    Counts the rows per hash prefix inside the prefix that holds row ``n``, until few enough rows
    are left to rank. Two rounds are enough for 10**14 rows.
    """
    counts = prefix_counts(keyed) if counts is None else counts
    prefix, rank = "", n
    while True:
        for part, rows in counts:
            if rank <= rows:
                break
            rank -= rows
        else:
            raise ValueError(f"asked for row {n} of a smaller table")
        prefix += part
        if rows <= RANKED_ROWS or len(prefix) == DIGEST_DIGITS:
            break
        counts = prefix_counts(keyed, prefix)
    last = (
        keyed.filter(F.col("digest").startswith(prefix))
        .orderBy("digest", "key")
        .offset(rank - 1)
        .limit(1)
        .collect()[0]
    )
    return CutOff(last["digest"], last["key"])


def sample_exact(
    df: DataFrame, n: int | None, key: str, seed: int = DEFAULT_SEED, write_keys: bool = False
) -> DataFrame:
    """Exactly ``n`` rows without replacement; unchanged if ``n`` is falsy or not below the size.

    Not a sorted limit: that would send ``n`` whole rows of every input partition to one task.
    ``write_keys`` stores the keys and hashes in the shared folder before they are counted; use it
    when ``df`` is expensive to compute.
    """
    if not n:
        return df
    keyed = keyed_digests(df, key, seed)
    if write_keys:
        keyed = written(keyed, "sample-keys")
    counts = prefix_counts(keyed)
    if n >= sum(rows for _, rows in counts):
        return df
    cut = cut_off(keyed, n, counts)
    return df.filter(cut.includes(hash_order(key, seed), F.col(key)))


def split_exact(
    df: DataFrame,
    key: str,
    eval_fraction: float = DEFAULT_EVAL_FRACTION,
    seed: int = DEFAULT_SEED,
    write_keys: bool = False,
) -> DataFrame:
    """Adds ``split``: exactly ``ceil(fraction * rows)`` rows are ``eval``, the others ``train``.

    ``write_keys`` as in ``sample_exact``.
    """
    keyed = keyed_digests(df, key, seed)
    if write_keys:
        keyed = written(keyed, "split-keys")
    counts = prefix_counts(keyed)
    n_eval = math.ceil(eval_fraction * sum(rows for _, rows in counts))
    if n_eval == 0:
        return df.withColumn("split", F.lit("train"))
    is_eval = cut_off(keyed, n_eval, counts).includes(hash_order(key, seed), F.col(key))
    return df.withColumn("split", F.when(is_eval, "eval").otherwise("train"))


def split_stable(
    df: DataFrame,
    key: str,
    eval_fraction: float = DEFAULT_EVAL_FRACTION,
    seed: int = DEFAULT_SEED,
) -> DataFrame:
    """Adds ``split`` from the row's own hash: sizes are approximate, membership never changes."""
    limit = f"{int(eval_fraction * 2**32):08x}"  # digests compare like their first hex digits
    is_eval = hash_order(key, seed) < limit
    return df.withColumn("split", F.when(is_eval, "eval").otherwise("train"))


def head(df: DataFrame, n: int, *order: str | Column) -> DataFrame:
    """First ``n`` rows in an explicit order."""
    return df.orderBy(*order).limit(n)


def tail(df: DataFrame, n: int, order: str) -> DataFrame:
    """Last ``n`` rows by ``order``, returned in ascending order."""
    return df.orderBy(F.desc(order)).limit(n).orderBy(order)


def _key_source(df: DataFrame, key: str, write_keys: bool) -> DataFrame:
    return written(df.select(key), "index-keys") if write_keys else df


def _number(
    df: DataFrame, keys: DataFrame, bucket: Column, order: list[Column], name: str
) -> DataFrame:
    """Row numbers from 0 in (bucket, order): bounded bucket offsets plus a rank per bucket.

    ``bucket`` depends on the key only, so the buckets are counted over ``keys``.
    """
    counts = keys.groupBy(bucket.alias("_bucket")).count().collect()
    buckets = sorted((r["_bucket"], r["count"]) for r in counts)
    before = [0, *accumulate(rows for _, rows in buckets)][: len(buckets)]
    offsets = df.sparkSession.createDataFrame(
        pa.table(
            {
                "_bucket": pa.array([b for b, _ in buckets], pa.int64()),
                "_before": pa.array(before, pa.int64()),
            }
        )
    )
    rank = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order))
    return (
        df.withColumn("_bucket", bucket)
        .join(F.broadcast(offsets), "_bucket")
        .withColumn(name, F.col("_before") + rank - 1)
        .drop("_bucket", "_before")
    )


def row_index_hashed(
    df: DataFrame,
    key: str,
    seed: int = DEFAULT_SEED,
    name: str = "row_index",
    write_keys: bool = False,
) -> DataFrame:
    """Dense row index in hash order; at most 65,536 offsets are broadcast."""
    digest = hash_order(key, seed)
    keys = _key_source(df, key, write_keys)
    return _number(df, keys, hash_prefix(digest), [digest, F.col(key)], name)


def _among_equal(rows: DataFrame, key: str, content: Column, name: str) -> DataFrame:
    """Numbers the rows of each key from 0 in the order of ``content``, a 64-bit value.

    Equal contents are told apart by the stored file they are in. Counts go up in three steps: rows of one
    content in one file, those of a 65,536th of the contents, and these ranges of a key. Each sum
    is over few rows, and so is each ranking, also where one key or one content has most of all rows.
    """
    part = F.shiftright("_content", 48)
    stored = written(rows.withColumn("_content", content).withColumn("_file", F.spark_partition_id()), "equal-keys")
    k = F.col(key).alias("_k")
    small = stored.groupBy(k, part.alias("_part"), "_content", "_file").agg(F.count("*").alias("_n"))
    small = written(small, "equal-counts")
    ranges = small.groupBy("_k", "_part").agg(F.sum("_n").alias("_m"))

    def earlier(n: str, *by: str, order: tuple[str, ...]) -> Column:
        before = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(n).over(before), F.lit(0))

    ranges = ranges.withColumn("_before", earlier("_m", "_k", order=("_part",))).drop("_m")
    small = small.withColumn("_inside", earlier("_n", "_k", "_part", order=("_content", "_file")))
    same = [F.col(f"s.{c}").eqNullSafe(F.col(f"r.{c}")) for c in ("_k", "_part")]
    first = small.alias("s").join(ranges.alias("r"), same).select(
        "s._k", "s._content", "s._file", (F.col("_before") + F.col("_inside")).alias("_start")
    )
    among = F.row_number().over(Window.partitionBy(key, "_content", "_file").orderBy(F.lit(0))) - 1
    numbered = stored.withColumn("_nth", among).alias("d")
    on = F.col(f"d.{key}").eqNullSafe(F.col("f._k"))
    on = on & (F.col("d._content") == F.col("f._content")) & (F.col("d._file") == F.col("f._file"))
    joined = numbered.join(first.alias("f"), on)
    return joined.select(
        *(F.col(f"d.{c}") for c in rows.columns), (F.col("_start") + F.col("_nth")).alias(name)
    )


def row_index_ordered(
    df: DataFrame, key: str, name: str = "row_index", content: Column | None = None
) -> DataFrame:
    """Dense row index in the order of a key of any orderable type.

    Only the distinct keys are sorted: Spark cuts them into ranges by their number, the stored ranges
    are counted, and each is summed up by itself. The rows are joined with their numbers by key. Rows
    with the same key are numbered one after another, in the order of ``content`` (a 64-bit value, by
    default a hash of all columns; rows that are equal in it in any order).
    """
    keys = df.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_rows")).orderBy("_key")
    ranges = written(keys.withColumn("_part", F.spark_partition_id()), "index-ranges")
    counts = ranges.groupBy("_part").agg(F.sum("_rows").alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition of the sort
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_part").orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("_before") + F.coalesce(F.sum("_rows").over(inside), F.lit(0))
    numbered = ranges.join(F.broadcast(offsets), "_part").select("_key", first.alias("_first"))
    rows = df.join(numbered, F.col(key).eqNullSafe(F.col("_key")))
    if ranges.filter("_rows > 1").isEmpty():
        return rows.withColumn(name, F.col("_first")).drop("_key", "_first")
    content = F.xxhash64(*(F.col(f"`{c}`") for c in df.columns)) if content is None else content
    rows = _among_equal(rows.drop("_key"), key, content, "_among")
    return rows.withColumn(name, F.col("_first") + F.col("_among")).drop("_first", "_among")


ACCUMULATION_STEPS = 4


def assign_batches(
    df: DataFrame,
    key: str,
    batch_size: int,
    accumulation: int = ACCUMULATION_STEPS,
    seed: int = DEFAULT_SEED,
) -> DataFrame:
    """Adds ``batch_id``, the optimizer step that a row in shuffled order belongs to."""
    indexed = row_index_hashed(df, key, seed, "_index")
    step = F.floor(F.col("_index") / (batch_size * accumulation)).cast("long")
    return indexed.withColumn("batch_id", step).drop("_index")


def batch_stats(df: DataFrame, chars: str = "chars") -> DataFrame:
    """Rows and text lengths per optimizer step; measure the texts before they are numbered."""
    return df.groupBy("batch_id").agg(
        F.count("*").alias("n_rows"),
        F.sum(chars).alias("sum_chars"),
        F.max(chars).alias("max_chars"),
    )
