"""Streams that are cut at any byte or arrive out of order, with keyed state that survives micro-batches."""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tunetable.operators.frames import parse_lines
from tunetable.streaming.buckets import bucket, key_name, key_of

#: Frames that wait for an earlier one, per entry of the state.
WAITING_BLOCK = 256
#: Seconds of event time after which a missing frame is given up, and by which frames may be late.
PATIENCE = 3600
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_state(spark: SparkSession):
    """The state store that several named states per key need; run the query inside."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def _by_name(rows: Iterator[pd.DataFrame], *columns: str) -> dict[str, list[tuple]]:
    """The rows of a bucket, as tuples of the columns, by the name of their key."""
    found: dict[str, list[tuple]] = {}
    for part in rows:
        for name, *row in zip(part["name"], *(part[c] for c in columns)):
            found.setdefault(name, []).append(tuple(row))
    return found


def _held(state, *key) -> tuple | None:
    """The value of a map state, None where there is none."""
    return state.getValue(key) if state.containsKey(key) else None


class CutLines(StatefulProcessor):
    """Complete lines of the streams of byte chunks of one bucket.

    The state of a stream is the number of lines so far and the bytes after the last newline: the cut line, and in
    it perhaps the first bytes of a cut character. Bytes are decoded when their line is complete.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rest = handle.getMapState("rest", "name string", "n_lines long, bytes binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        names, numbers, texts = [], [], []
        for name, chunks in _by_name(rows, "place", "piece").items():
            known = _held(self.rest, name)
            number, rest = (int(known[0]), bytes(known[1])) if known is not None else (0, b"")
            chunks = sorted((o, bytes(d)) for o, d in chunks)
            *lines, rest = b"".join([rest, *(data for _, data in chunks)]).split(b"\n")
            self.rest.updateValue((name,), (number + len(lines), rest))
            names += [name] * len(lines)
            numbers += range(number, number + len(lines))
            texts += [line.decode("utf-8", "replace") for line in lines]
        if names:
            yield pd.DataFrame({"name": names, "seq": numbers, "line": texts})

    def close(self) -> None:
        pass


def byte_chunk_lines(
    chunks: DataFrame, stream: str, seq: str = "chunk_seq", data: str = "data"
) -> DataFrame:
    """Complete lines (``stream``, ``seq`` from 0, ``line``) of a streaming table of binary chunks.

    Chunks may be cut anywhere, also within a character. Those of a stream have to arrive in order from
    micro-batch to micro-batch; within one they are sorted. A null chunk is empty; bytes that are not
    UTF-8 become the replacement character. A last line without its newline stays in the state. Run
    the query inside ``keyed_state``.
    """
    kind = chunks.schema[stream].dataType.simpleString()
    empty = F.coalesce(F.col(data), F.lit(b""))
    rows = chunks.select(key_name(stream).alias("name"), F.col(seq).alias("place"), empty.alias("piece"))
    lines = rows.withColumn("bucket", bucket()).groupBy(F.col("bucket")).transformWithStateInPandas(
        CutLines(), "name string, seq long, line string", "append", "none"
    )
    return lines.select(key_of("name", kind).alias(stream), "seq", "line")


class Reorder(StatefulProcessor):
    """Frames of the streams of one bucket in the order of their numbers, the longest complete prefix per micro-batch.

    Frames that come too early wait in a map from streams and blocks of numbers to frames. A missing frame is
    given up after ``patience`` seconds of event time: the stream then goes on with the first frame that
    waits, and the gap is counted. A finished stream is only remembered, for as long. The bucket has one timer, for
    the stream that is due first.
    """

    COLUMNS = ["name", "attempt", "first", "text", "n", "done", "gaps"]

    def __init__(self, patience: int):
        self.patience = patience * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        place = "attempt long, next long, finished boolean, gaps long, due long, blocks string"
        self.places = handle.getMapState("places", "name string", place)
        self.waiting = handle.getMapState("waiting", "name string, block long", "frames string")
        self.alarm = handle.getValueState("alarm", "due long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        shown, first = [], None
        for name, found in _by_name(rows, "attempt", "seq", "token", "done", "ms").items():
            known = _held(self.places, name)
            attempt, after, finished, gaps, _, held = known if known is not None else (0, 0, False, 0, 0, "")
            blocks = {int(b) for b in held.split()}
            frames: dict[int, tuple] = {}
            latest = 0
            for start, number, token, done, ms in found:
                start, number = int(start), int(number)
                latest = max(latest, int(ms))
                if start > attempt:  # a new start: nothing of the former one counts
                    attempt, after, finished, gaps = start, 0, False, 0
                    frames = {}
                    self._forget(name, blocks)
                if start == attempt and not finished and number >= after:
                    frames[number] = (token, bool(done))
            started = after
            tokens, after, finished = self._prefix(name, blocks, frames, after, finished)
            self._rest(name, blocks, frames, finished)
            due = latest + self.patience
            self._place(name, attempt, after, finished, gaps, due, blocks)
            first = due if first is None else min(first, due)
            if after > started:
                shown.append((name, attempt, started, "".join(tokens), len(tokens), finished, gaps))
        if first is not None:
            self._wake(first)
        if shown:
            yield pd.DataFrame(shown, columns=self.COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        over = max(now, expiredTimerInfo.getExpiryTimeInMs())
        self.alarm.clear()
        shown, first = [], None
        for (name,), place in list(self.places.iterator()):
            attempt, _, finished, gaps, due, held = place
            if due <= over:
                blocks = set() if finished else {int(b) for b in held.split()}
                if not blocks:
                    self.places.removeKey((name,))
                    continue
                waits = json.loads(self.waiting.getValue((name, min(blocks)))[0])
                started = min(n for n, *_ in waits)
                frames: dict[int, tuple] = {}
                tokens, after, finished = self._prefix(name, blocks, frames, started, False)
                self._rest(name, blocks, frames, finished)
                due = now + self.patience
                self._place(name, attempt, after, finished, gaps + 1, due, blocks)
                shown.append((name, attempt, started, "".join(tokens), len(tokens), finished, gaps + 1))
            first = due if first is None else min(first, due)
        if first is not None:
            self._wake(first)
        if shown:
            yield pd.DataFrame(shown, columns=self.COLUMNS)

    def _prefix(
        self, name: str, blocks: set[int], frames: dict[int, tuple], after: int, finished: bool
    ) -> tuple[list, int, bool]:
        """(tokens of the complete prefix, next number, whether it ended); takes waiting blocks as needed."""
        tokens, block = [], -1
        while not finished:
            if after // WAITING_BLOCK != block:
                block = after // WAITING_BLOCK
                if block in blocks:
                    for n, token, done in json.loads(self.waiting.getValue((name, block))[0]):
                        frames.setdefault(n, (token, done))
                    self._forget(name, blocks, block)
            if after not in frames:
                break
            token, finished = frames.pop(after)
            after += 1
            if token is not None and not finished:
                tokens.append(token)
        return tokens, after, finished

    def _rest(self, name: str, blocks: set[int], frames: dict[int, tuple], finished: bool) -> None:
        """Stores what waits; nothing of a finished stream does."""
        if finished:
            self._forget(name, blocks)
        new: dict[int, list] = {}
        for n in () if finished else frames:
            new.setdefault(n // WAITING_BLOCK, []).append([n, *frames[n]])
        for block, rows in new.items():
            if block in blocks:
                held = {row[0]: row for row in json.loads(self.waiting.getValue((name, block))[0])}
                rows = [*(held | {row[0]: row for row in rows}).values()]
            self.waiting.updateValue((name, block), (json.dumps(rows),))
            blocks.add(block)

    def _forget(self, name: str, blocks: set[int], *some: int) -> None:
        for block in some or sorted(blocks):
            self.waiting.removeKey((name, block))
            blocks.discard(block)

    def _place(self, name, attempt, after, finished, gaps, due, blocks) -> None:
        held = " ".join(map(str, sorted(blocks)))
        self.places.updateValue((name,), (attempt, after, finished, gaps, due, held))

    def _wake(self, due: int) -> None:
        """The timer of the bucket rings at the earliest time that any of its streams is due."""
        set_for = self.alarm.get()
        if set_for is not None and int(set_for[0]) <= due:
            return
        if set_for is not None:
            self.handle.deleteTimer(int(set_for[0]))
        self.handle.registerTimer(due)
        self.alarm.update((due,))

    def close(self) -> None:
        pass


def reordered_prefixes(
    lines: DataFrame, stream: str, ts: str, attempt: str | None = None, patience: int = PATIENCE
) -> DataFrame:
    """Streaming frame lines (``stream``, ``seq``, ``line``) in any order -> what each micro-batch completes.

    One row per stream and micro-batch that prolongs its complete prefix: ``attempt``, ``first`` (the number
    of its first frame), ``text``, ``n`` tokens, ``done`` and ``gaps`` given up so far. Numbers of a stream
    count from 0 without holes, over lines of every kind; lines that are no frames take their number and
    add nothing. A higher ``attempt`` starts the stream anew, repeated numbers and lower attempts are ignored.

    Frames more than ``patience`` seconds of event time ``ts`` behind the newest one of earlier micro-batches
    are discarded by the watermark. Run the query inside ``keyed_state``.
    """
    kind = lines.schema[stream].dataType.simpleString()
    start = F.lit(0) if attempt is None else F.col(attempt)
    frames = parse_lines(lines, keep_others=True).withWatermark(ts, f"{patience} seconds")
    rows = frames.select(
        key_name(stream).alias("name"),
        start.cast("long").alias("attempt"),
        "seq",
        "token",
        "done",
        F.unix_millis(ts).alias("ms"),
        ts,
    )
    schema = "name string, attempt long, first long, text string, n long, done boolean, gaps long"
    grouped = rows.withColumn("bucket", bucket()).groupBy(F.col("bucket"))
    out = grouped.transformWithStateInPandas(Reorder(patience), schema, "append", "EventTime")
    return out.select(key_of("name", kind).alias(stream), *Reorder.COLUMNS[1:])


def whole_streams(prefixes: DataFrame, stream: str) -> DataFrame:
    """The stored prefixes put together: one row per stream, of its last attempt."""
    piece = F.struct("first", "text", "n", "done", "gaps")
    last = prefixes.groupBy(stream, "attempt").agg(F.sort_array(F.collect_list(piece)).alias("p"))
    latest = F.max(F.struct("attempt", "p")).alias("_s")
    end = F.element_at("_s.p", -1)
    return last.groupBy(stream).agg(latest).select(
        stream,
        F.array_join("_s.p.text", "").alias("text"),
        F.aggregate("_s.p.n", F.lit(0).cast("long"), lambda a, n: a + n).alias("token_count"),
        end["done"].alias("done"),
        end["gaps"].alias("gaps"),
    )


class RecentPrompts(StatefulProcessor):
    """The most recent distinct prompts of the users of one bucket: a used prompt moves to the front."""

    def __init__(self, n: int, ttl_ms: int | None):
        self.n, self.ttl_ms = n, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getMapState("recent", "name string", "prompts string", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        used: dict[str, dict[str, int]] = {}
        for part in rows:
            for name, prompt, us in zip(part["name"], part["prompt"], part["us"]):
                recent = used.setdefault(name, {})
                recent[prompt] = max(int(us), recent.get(prompt, int(us)))
                if len(recent) > 64 * self.n:
                    used[name] = self._first(recent)
        shown = []
        for name, recent in used.items():
            known = _held(self.recent, name)
            for prompt, us in json.loads(known[0]) if known is not None else ():
                recent[prompt] = max(us, recent.get(prompt, us))
            recent = self._first(recent)
            self.recent.updateValue((name,), (json.dumps([*recent.items()]),))
            version = max(recent.values())
            shown += [(name, version, rank, prompt) for rank, prompt in enumerate(recent, 1)]
        if shown:
            yield pd.DataFrame(shown, columns=["name", "version", "rank", "prompt"]).astype({"rank": "int32"})

    def _first(self, recent: dict[str, int]) -> dict[str, int]:
        return dict(sorted(recent.items(), key=lambda r: (-r[1], r[0].encode()))[: self.n])

    def close(self) -> None:
        pass


def live_recent_prompts(
    history: DataFrame, user: str = "user_id", n: int = 5, ts: str = "ts", ttl_ms: int | None = None
) -> DataFrame:
    """Streaming (``user``, ``prompt``, ``ts``) -> the user's whole list after each micro-batch that uses it.

    ``version`` is the newest time of the list. Prompts are stripped, blank ones and those without a time
    ignored. With ``ttl_ms`` of processing time a list that is not used that long is forgotten. Prompts of
    equal time are listed in code-point order. Run the query inside ``keyed_state``.
    """
    from tunetable.functions.text import strip

    kind = history.schema[user].dataType.simpleString()
    used = history.select(
        key_name(user).alias("name"),
        strip("prompt").alias("prompt"),
        F.unix_micros(F.col(ts).cast("timestamp")).alias("us"),
    ).filter((F.col("prompt") != "") & F.col("us").isNotNull())
    mode = "none" if ttl_ms is None else "ProcessingTime"
    out = used.withColumn("bucket", bucket()).groupBy(F.col("bucket")).transformWithStateInPandas(
        RecentPrompts(n, ttl_ms), "name string, version long, rank int, prompt string", "update", mode
    )
    return out.select(key_of("name", kind).alias(user), "version", "rank", "prompt")
