"""Rate limiting over a stream of requests."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tunetable.operators.usage import GENERATE_LIMIT, WINDOW, window_counts
from tunetable.streaming.buckets import bucket, key_name, key_of
from tunetable.streaming.runs import each_batch, overwrite_batch

LATENESS = "10 minutes"


def live_window_counts(
    requests: DataFrame,
    key: tuple[str, ...],
    limit: int = GENERATE_LIMIT,
    window: str = WINDOW,
    lateness: str = LATENESS,
) -> DataFrame:
    """Clock-aligned windows: updated counts per micro-batch; state expires with the watermark.

    Requests of windows that ended more than ``lateness`` before the newest request of earlier
    micro-batches are discarded and not counted; raise it if requests come later.
    """
    return window_counts(requests.withWatermark("ts", lateness), key, limit, window)


def collect_window_counts(counts: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Runs the counts as an update query; the newest value of a window is its largest."""
    spark = counts.sparkSession
    out = each_batch(counts, "window-counts", "update", overwrite_batch)
    columns = [c for c in counts.columns if c not in (*key, "window_start")]
    return (
        spark.read.parquet(out)
        .groupBy(*key, "window_start")
        .agg(*[F.max(c).alias(c) for c in columns])
    )


def first_hit_windows(
    requests: DataFrame,
    key: str,
    limit: int = GENERATE_LIMIT,
    seconds: int = 60,
    lateness: str = LATENESS,
) -> DataFrame:
    """Admission with windows that start at a key's first hit after the previous window ended.

    Blocked requests do not move the window. State per key is the window start and its hit count; it
    is removed once the watermark has passed the end of the window. Keys are dealt to buckets whose state is
    one list of windows. A micro-batch is sorted per bucket, so its size (``max_files`` of the source) bounds
    the memory.

    Requests that lie more than ``lateness`` behind the newest one of the micro-batches before are
    discarded and get no row; raise it if requests come later. State is kept that much longer.
    """
    length = seconds * 1_000_000
    kind = requests.schema[key].dataType.simpleString()
    schema = "name string, event_id long, window_start long, rank int, admitted boolean"

    def admit(
        k: tuple, batches: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        passed = state.getCurrentWatermarkMs()
        windows = {n: (s, h) for n, s, h in json.loads(state.get[0])} if state.exists else {}
        if not state.hasTimedOut:
            rows = pd.concat(list(batches), ignore_index=True).sort_values(["us", "event_id"])
            starts, ranks = [], []
            for name, us in zip(rows["name"].tolist(), rows["us"].tolist()):
                start, hits = windows.get(name, (None, 0))
                if start is None or us >= start + length:
                    start, hits = us, 0
                hits += 1
                windows[name] = start, hits
                starts.append(start)
                ranks.append(hits)
        # a window is over for good once no request that it could hold is let through
        left = [(n, s, h) for n, (s, h) in windows.items() if (s + length) // 1000 + 1 >= passed]
        if left:
            state.update((json.dumps(left),))
            ends = (min(s for _, s, _ in left) + length) // 1000 + 1
            state.setTimeoutTimestamp(max(ends, passed + 1))
        elif state.exists:
            state.remove()
        if not state.hasTimedOut:
            yield pd.DataFrame(
                {
                    "name": rows["name"].to_numpy(),
                    "event_id": rows["event_id"].to_numpy(),
                    "window_start": starts,
                    "rank": ranks,
                    "admitted": [r <= limit for r in ranks],
                }
            )

    micros = F.unix_micros(F.col("ts").cast("timestamp")).alias("us")
    out = (
        requests.withWatermark("ts", lateness)
        .select(key_name(key).alias("name"), "event_id", "ts", micros)
        .withColumn("bucket", bucket())
        .groupBy(F.col("bucket"))
        .applyInPandasWithState(
            admit, schema, "windows string", "append", GroupStateTimeout.EventTimeTimeout
        )
    )
    return out.select(key_of("name", kind).alias(key), "event_id", "window_start", "rank", "admitted")
