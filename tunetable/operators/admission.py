"""First-hit windows over a whole request log, with one client's log in many tasks.

A window begins at a client's first request and lasts ``seconds``; the next one begins at the first request
at or after its end. Each window depends on the one before, so the log is cut into spans of ``SPAN``
windows. A span can be entered at its first request or at one within its first window length. For each such
entry the span's windows are followed on its own and tell where the next span is entered: a jump pointer. Jumps
are doubled over all spans at once and then taken from the first request of every client, largest first, which
gives the one true entry of each span. Windows and ranks follow span by span.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tunetable.operators.usage import GENERATE_LIMIT
from tunetable.session import written

#: Windows of a span: what one task follows at once.
SPAN = 1024
#: Requests of a bucket of spans.
BUCKET_ROWS = 1 << 17


def _starts(us: np.ndarray, first: int, length: int) -> list[int]:
    """Window starts from the request at index `first` on."""
    out = []
    at = first
    while at < len(us):
        out.append(int(us[at]))
        at = int(np.searchsorted(us, us[at] + length))
    return out


def _ends(us: np.ndarray, length: int) -> np.ndarray:
    """Per request: the end of the last window in the span, if a window begins at that request."""
    n = len(us)
    jump = np.append(np.searchsorted(us, us + length), n)
    last = np.arange(n + 1)
    while (jump[:n] < n).any():  # pointer doubling within the span
        last = np.where(jump < n, last[jump], last)
        jump = jump[jump]
    return us[last[:n]] + length


def _groups(bucket: pa.Table) -> list[tuple[int, int]]:
    """(first row, end row) of each client's span in a bucket sorted by both."""
    k = pc.rank(bucket["k"], tiebreaker="dense").to_numpy()
    span = bucket["span"].to_numpy()
    new = np.flatnonzero((np.diff(k, prepend=-1) != 0) | (np.diff(span, prepend=span[:1] - 1) != 0))
    return list(zip(new.tolist(), [*new[1:].tolist(), len(k)]))


def span_jumps(hits: DataFrame, length: int) -> DataFrame:
    """(``k``, ``span``, ``entry``, ``then``): the entries of each span and when the window after it may begin.

    ``hits`` are different (``k``, ``span``, ``us``) with the ``begin`` and the ``bucket`` of their span.
    """

    def jumps(bucket: pa.Table) -> pa.Table:
        bucket = bucket.sort_by([("k", "ascending"), ("span", "ascending"), ("us", "ascending")])
        us, begin = bucket["us"].to_numpy(), bucket["begin"].to_numpy()
        kept, then = [], []
        for a, b in _groups(bucket):
            # the requests within one length, and one beyond
            near = min(int(np.searchsorted(us[a:b], begin[a] + length)) + 1, b - a)
            kept.append(np.arange(a, a + near))
            then.append(_ends(us[a:b], length)[:near])
        out = bucket.take(pa.array(np.concatenate(kept))).select(["k", "span", "us"])
        return out.append_column("then", pa.array(np.concatenate(then))).rename_columns(
            ["k", "span", "entry", "then"]
        )

    return hits.groupBy("bucket").applyInArrow(jumps, "k string, span long, entry long, then long")


def _next_entry(jumps: DataFrame, span_us: int) -> DataFrame:
    """(``k``, ``entry``, ``then``, ``next``): the first entry of a later span at or after ``then``."""
    # spans that have requests, each with the first request of the next one
    firsts = jumps.groupBy("k", "span").agg(F.min("entry").alias("first"))
    after = F.lead("first").over(Window.partitionBy("k").orderBy("span"))
    firsts = firsts.withColumn("following", after)
    into = F.floor(F.col("then") / span_us).cast("long")
    asked = jumps.select("k", into.alias("into"), F.col("then").alias("t"), F.lit(0).alias("kind"), "entry", "span")
    held = jumps.select(
        "k", F.col("span").alias("into"), F.col("entry").alias("t"), F.lit(1).alias("kind"),
        F.lit(None).cast("long").alias("entry"), "span",
    )
    ahead = Window.partitionBy("k", "into").orderBy("t", "kind").rowsBetween(0, Window.unboundedFollowing)
    seen = F.first(F.when(F.col("kind") == 1, F.col("t")), ignorenulls=True).over(ahead)
    found = asked.unionByName(held).withColumn("seen", seen).filter("kind = 0")
    out = found.join(firsts.select("k", "span", "following"), ["k", "span"])
    # nothing at or after the end in the very next span: the first request beyond it, if that is later
    beyond = firsts.select("k", F.col("span").alias("into"), F.col("following").alias("beyond"))
    out = out.join(beyond, ["k", "into"], "left")
    late = F.when(F.col("following") >= F.col("t"), F.col("following")).otherwise(F.col("beyond"))
    return out.select("k", "entry", F.col("t").alias("then"), F.coalesce("seen", late).alias("next"))


def true_entries(jumps: DataFrame, span_us: int) -> DataFrame:
    """(``k``, ``entry``, ``then``): where each client's windows enter spans, and when they end."""
    level = written(_next_entry(jumps, span_us), "jumps")
    levels = [level.filter("next is not null").select("k", "entry", "next")]
    while True:
        far = levels[-1]
        on = far.select("k", F.col("entry").alias("next"), F.col("next").alias("far"))
        more = written(far.join(on, ["k", "next"]).select("k", "entry", F.col("far").alias("next")), "jumps")
        if more.isEmpty():
            break
        levels.append(more)
    known = jumps.groupBy("k").agg(F.min("entry").alias("entry"))
    for far in reversed(levels):
        known = known.union(known.join(far, ["k", "entry"]).select("k", F.col("next").alias("entry")))
        known = written(known.distinct(), "entries")
    return known.join(level.select("k", "entry", "then"), ["k", "entry"])


def first_hit_admission(
    requests: DataFrame,
    key: str,
    limit: int = GENERATE_LIMIT,
    seconds: int = 60,
    ts: str = "ts",
    order: str = "event_id",
    span: int = SPAN,
) -> DataFrame:
    """Every request with a time: ``window_start`` (microseconds), ``rank`` in its window, ``admitted``.

    Blocked requests do not move a window; the result equals ``streaming.limits.first_hit_windows``. A null
    key is one client. Requests without a time have no row. The requests of one window are ranked in one task.
    """
    length, span_us = seconds * 1_000_000, seconds * 1_000_000 * span
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    # the client as text, so that a null one is equal to itself
    rows = requests.filter(F.col(ts).isNotNull()).select(
        F.to_json(F.struct(F.col(key))).alias("k"), F.col(key).alias("c"), F.col(order).alias("o"), us.alias("us")
    )
    rows = rows.withColumn("span", F.floor(F.col("us") / span_us).cast("long"))
    hits = written(rows.select("k", "span", "us").distinct(), "hits")
    buckets = 1 + hits.count() // BUCKET_ROWS
    bucket = F.pmod(F.xxhash64("k", "span"), F.lit(buckets)).alias("bucket")
    hits = hits.select("k", "span", "us", (F.col("span") * span_us).alias("begin"), bucket)
    entries = true_entries(written(span_jumps(hits, length), "span-jumps"), span_us)
    within = lambda c: F.floor(F.col(c) / span_us).cast("long")
    none = F.lit(None).cast("long")
    # the last window of a span may go on in the next one, whether or not that is entered
    going_on = entries.filter(within("then") > within("entry")).select(
        "k", within("then").alias("span"), none.alias("entry"), F.col("then").alias("until")
    )
    entries = entries.select("k", within("entry").alias("span"), "entry", none.alias("until"))
    entries = entries.union(going_on).groupBy("k", "span").agg(
        F.max("entry").alias("entry"), F.max("until").alias("until")
    )

    def windows(bucket: pa.Table) -> pa.Table:
        bucket = bucket.sort_by([("k", "ascending"), ("span", "ascending"), ("us", "ascending")])
        us, entry, until = (bucket[c].to_numpy() for c in ("us", "entry", "until"))
        own = np.zeros(len(us), np.int64)
        for a, b in _groups(bucket):
            first = b if np.isnan(entry[a]) else a + int(np.searchsorted(us[a:b], int(entry[a])))
            if first > a:
                own[a:first] = int(until[a]) - length
            if first < b:
                starts = np.array(_starts(us[a:b], first - a, length))
                own[first:b] = starts[np.searchsorted(starts, us[first:b], "right") - 1]
        return bucket.select(["k", "us"]).append_column("window_start", pa.array(own))

    # small enough times for doubles: microseconds of 285 years
    both = hits.join(entries, ["k", "span"]).select(
        "bucket", "k", "span", "us", *(F.col(c).cast("double").alias(c) for c in ("entry", "until"))
    )
    placed = both.groupBy("bucket").applyInArrow(windows, "k string, us long, window_start long")
    every = rows.join(placed, ["k", "us"])
    rank = F.row_number().over(Window.partitionBy("k", "window_start").orderBy("us", "o"))
    return every.select(
        F.col("c").alias(key), F.col("o").alias(order), "window_start", rank.alias("rank"),
        (rank <= limit).alias("admitted"),
    )
