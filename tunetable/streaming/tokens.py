"""Token-stream folding with state: text and count per stream until its done frame."""

from __future__ import annotations

import json
from collections.abc import Iterator
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tunetable.operators.frames import parse_lines
from tunetable.streaming.buckets import bucket, key_name, key_of

STATE_SCHEMA = "streams string"
IDLE = 3600  # seconds of event time after which an unfinished stream is given up


def _fold(rows: list[tuple], known: list) -> tuple[list, list[tuple]]:
    """(state, what is emitted) of one stream after a batch's rows (attempt, seq, token, done, ms).

    The state is (text, count, finished, attempt). After the done frame it only remembers that the stream is
    finished, so that later frames are ignored. A higher attempt starts the stream anew, and frames of lower
    ones are ignored.
    """
    text, count, finished, attempt = known
    pieces, shown = [text], []
    for start, _, token, done, _ in sorted(rows, key=itemgetter(0, 1)):
        if start > attempt:
            pieces, count, finished, attempt = [], 0, False, int(start)
        if finished or start < attempt:
            continue
        if done:
            finished = True
            shown.append(("".join(pieces), count, True))
            pieces = []
        else:
            pieces.append(token)
            count += 1
    return ["".join(pieces), count, finished, attempt], shown


def _fold_bucket(
    batches: Iterator[pd.DataFrame], state: GroupState, idle_ms: int | None
) -> list[tuple]:
    """Adds a bucket's rows to its streams; (name, text, count, done) of those that are done or given up."""
    streams = json.loads(state.get[0]) if state.exists else {}
    watermark = None if idle_ms is None else state.getCurrentWatermarkMs()
    shown, arrived = [], {}
    columns = ("attempt", "seq", "token", "done", "ms")
    if not state.hasTimedOut:
        for b in batches:
            for name, *frame in zip(b["name"], *(b[c] for c in columns)):
                arrived.setdefault(name, []).append(tuple(frame))
    for name, rows in arrived.items():
        *known, _ = streams.get(name, ("", 0, False, 0, None))
        after, ended = _fold(rows, known)
        shown += [(name, *end) for end in ended]
        due = None if idle_ms is None else max(int(max(ms for *_, ms in rows)), watermark) + idle_ms
        streams[name] = [*after, due]
    if idle_ms is not None:
        over = [n for n, s in streams.items() if s[4] < watermark and n not in arrived]
        for name in over:
            text, count, finished, *_ = streams.pop(name)
            if not finished:
                shown.append((name, text, count, False))
    if streams:
        state.update((json.dumps(streams),))
        if idle_ms is not None:
            state.setTimeoutTimestamp(max(min(s[4] for s in streams.values()), watermark + 1))
    elif state.exists:
        state.remove()
    return shown


def fold_stream(
    lines: DataFrame,
    stream: str,
    ts: str | None = None,
    attempt: str | None = None,
    idle: int = IDLE,
) -> DataFrame:
    """Streaming lines (``stream``, ``seq``, ``line``) -> one row per finished stream.

    With an event time ``ts`` the state of idle streams is removed, and streams that never finished
    are emitted with ``done`` false; without one the state is kept. ``attempt`` numbers the starts of a
    stream from 0; a new start resets its text and count. Frames of one stream have to arrive in
    order from micro-batch to micro-batch; within one they are sorted (``streaming.ordered`` takes any order).

    ``idle`` seconds of event time is how long a stream may pause and how late a frame may come: frames that lie
    further behind the newest one of earlier micro-batches are discarded by the watermark, whole
    streams of them without a row. Without ``ts`` nothing is discarded.
    """
    frames = parse_lines(lines)
    millis = F.lit(0).cast("long")
    if ts is not None:
        frames = frames.withWatermark(ts, f"{idle} seconds")
        millis = F.unix_millis(ts)
    start = F.lit(0) if attempt is None else F.col(attempt)
    key_type = frames.schema[stream].dataType.simpleString()
    carried = [key_name(stream).alias("name"), start.cast("long").alias("attempt"), "seq", "token", "done", millis.alias("ms")]
    frames = frames.select(*carried, *([] if ts is None else [ts]))
    idle_ms = None if ts is None else 1000 * idle

    def fold(key, batches, state):
        shown = _fold_bucket(batches, state, idle_ms)
        if shown:
            yield pd.DataFrame(shown, columns=["name", "text", "token_count", "done"])

    timeout = GroupStateTimeout.NoTimeout if ts is None else GroupStateTimeout.EventTimeTimeout
    out = frames.withColumn("bucket", bucket()).groupBy(F.col("bucket")).applyInPandasWithState(
        fold, "name string, text string, token_count long, done boolean", STATE_SCHEMA, "append", timeout
    )
    return out.select(key_of("name", key_type).alias(stream), "text", "token_count", "done")
