"""Token-stream frames: encoding texts, decoding lines, folding streams back to texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tunetable.functions.formats import js_round
from tunetable.session import written

# Line formats, and the elapsed seconds below which no speed is shown.
DATA_PREFIX = "data: "
TOKEN_OPEN = 'data: {"token": '
DONE_LINE = 'data: {"done": true}'
MIN_ELAPSED = 0.5
BLOCK = 4096  # frames of one stream that are assembled by one task


def json_string(c: Column) -> Column:
    """A string as a quoted JSON literal."""
    wrapped = F.to_json(F.struct(c.alias("t")))
    return F.substr(wrapped, F.lit(len('{"t":') + 1), F.length(wrapped) - len('{"t":}'))


def encode_frames(texts: DataFrame, stream: tuple[str, ...], text: str = "text") -> DataFrame:
    """Texts -> frame lines (``seq``, ``line``): one per space-separated word, then a done frame.

    The done frame is the element after the last word of the same array, so one generator produces
    all lines and the table is read once.
    """
    pieces = F.split(text, " ", -1)
    last = F.size("pieces") - 1
    framed = texts.select(*stream, pieces.alias("pieces")).select(
        *stream,
        last.alias("last"),
        F.posexplode(F.concat("pieces", F.array(F.lit("")))).alias("seq", "word"),
    )
    token = F.when(F.col("seq") < F.col("last"), F.concat("word", F.lit(" "))).otherwise(
        F.col("word")
    )
    line = F.when(F.col("seq") > F.col("last"), DONE_LINE).otherwise(
        F.concat(F.lit(TOKEN_OPEN), json_string(token), F.lit("}"))
    )
    return framed.select(*stream, F.col("seq").cast("long").alias("seq"), line.alias("line"))


# The body is read inside an array with a null after it, so that anything after its end is seen.
FRAMES = "array<struct<token variant, done variant>>"
STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def _truthy(value: str, kind: str) -> Column:
    """Whether a JSON value counts as true: not null, false, 0 or an empty text."""
    kind = F.col(kind)
    read = {t: F.try_variant_get(value, "$", t) for t in ("string", "boolean", "double")}
    return F.coalesce(
        F.when(kind.isNull() | (kind == "VOID"), False)
        .when(kind == "STRING", read["string"] != "")
        .when(kind == "BOOLEAN", read["boolean"])
        .when(kind.startswith("OBJECT") | kind.startswith("ARRAY"), True)
        .otherwise(read["double"] != 0),
        F.lit(False),
    )


def _shown(value: str, kind: str) -> Column:
    """A JSON value as the text that is appended; whole numbers have no fraction."""
    text, number = (F.try_variant_get(value, "$", t) for t in ("string", "double"))
    whole = (number == F.floor(number)) & (F.abs(number) < 1e15)
    return (
        F.when(F.col(kind).isin("STRING", "BOOLEAN"), text)
        .when(whole, F.floor(number).cast("string"))
        .otherwise(text)
    )


def parse_lines(lines: DataFrame, line: str = "line", keep_others: bool = False) -> DataFrame:
    """Adds ``token`` and ``done``; other lines, malformed JSON and empty tokens are dropped.

    With ``keep_others`` they stay, without a token and not done.

    Only the two fields are read, and keep their JSON types: 0, false, null and "" are neither a token
    nor an end. ``explode`` makes the read values and their kinds plain columns: a line is parsed
    once, and a kind is found once, however often they are used further on.
    """
    others = [c for c in lines.columns if c != line]
    body = F.concat(F.lit("["), F.substr(line, F.lit(len(DATA_PREFIX) + 1)), F.lit(",null]"))
    read = F.from_json(body, FRAMES, STRICT)
    is_frame = F.col(line).startswith(DATA_PREFIX)
    if keep_others:
        framed, read = lines, F.when(is_frame, read)
    else:
        framed = lines.filter(is_frame)
    parsed = framed.select(*others, F.explode(F.array(read)).alias("_f"))
    first = F.get("_f", F.lit(0))
    whole = (F.size("_f") == 2) & first.isNotNull() & F.get("_f", F.lit(1)).isNull()
    if keep_others:
        first = F.when(whole, first)
    else:
        parsed = parsed.filter(whole)
    fields = [first[c].alias(f"_{c}") for c in ("token", "done")]
    kinds = [F.schema_of_variant(first[c]).alias(f"_{c}_kind") for c in ("token", "done")]
    parsed = parsed.select(*others, F.inline(F.array(F.struct(*fields, *kinds))))
    token = F.when(
        ~F.col("done") & _truthy("_token", "_token_kind"), _shown("_token", "_token_kind")
    )
    out = parsed.withColumn("done", _truthy("_done", "_done_kind")).withColumn("token", token)
    if not keep_others:
        out = out.filter(F.col("done") | F.col("token").isNotNull())
    return out.select(*others, "token", "done")


def decode_frames(lines: DataFrame, stream: tuple[str, ...], line: str = "line") -> DataFrame:
    """Token rows up to, and not including, the first done frame of their stream.

    Only lines that may hold the done field (it may be written with escapes) are looked at for the ends.
    """
    ending = F.col(line).contains("done") | F.col(line).contains("\\")
    ends = parse_lines(lines.filter(ending), line).filter("done")
    ends = ends.groupBy(*stream).agg(F.min("seq").alias("_end"))
    return (
        parse_lines(lines, line)
        .join(ends, list(stream), "left")
        .filter(~F.col("done") & (F.col("_end").isNull() | (F.col("seq") < F.col("_end"))))
        .drop("_end", "done")
    )


def latest_attempts(frames: DataFrame, stream: tuple[str, ...], attempt: str) -> DataFrame:
    """Only the frames of each stream's last start: a new start resets its text, count and clock."""
    last = frames.groupBy(*stream).agg(F.max(attempt).alias(attempt))
    return frames.join(last, [*stream, attempt], "left_semi")


def fold_streams(
    frames: DataFrame,
    stream: tuple[str, ...],
    ts: str | None = None,
    started: str | None = None,
    attempt: str | None = None,
) -> DataFrame:
    """One row per stream: reassembled ``text``, ``token_count``, ``done`` and, with times, speed.

    Blocks of consecutive frames are folded first, each up to its first done frame; a stream is its
    blocks up to the first one that is done. No task sees more than one block of a long stream
    before its tokens are joined. ``started`` is the request time of the stream. Of several starts,
    numbered by ``attempt``, the last one counts (as in ``latest_attempts``); it is chosen among the
    folded blocks, so the frames are read once.
    """
    timed = ts is not None
    starts = [] if attempt is None else [F.col(attempt).alias("attempt")]
    carried = [F.col(ts).alias("ts"), F.col(started).alias("started")] if timed else []

    def times(array: str) -> list[Column]:
        if not timed:
            return []
        latest, first = F.array_max(f"{array}.ts"), F.array_min(f"{array}.started")
        return [latest.alias("ts"), first.alias("started")]

    def first_done(array: str) -> Column:
        """Position of the first finished element, 0 if there is none."""
        return F.array_position(F.col(f"{array}.done"), F.lit(True))

    def up_to(array: str, n: Column) -> Column:
        return F.when(first_done(array) > 0, F.slice(array, F.lit(1), n)).otherwise(F.col(array))

    frame = F.struct("seq", "token", "done", *carried)
    blocks = (
        frames.groupBy(*stream, *starts, F.floor(F.col("seq") / BLOCK).alias("block"))
        .agg(F.sort_array(F.collect_list(frame)).alias("f"))
        .withColumn("done", first_done("f") > 0)
        .withColumn("f", up_to("f", first_done("f") - 1))
        .select(
            *stream,
            *(["attempt"] if starts else []),
            "block",
            F.array_join("f.token", "").alias("text"),
            F.size("f").alias("n"),
            "done",
            *times("f"),
        )
    )
    folded = [c for c in blocks.columns if c not in stream]
    last_start = F.col("b")
    if starts:
        latest = F.array_max("b.attempt")
        last_start = F.filter("b", lambda block: block["attempt"].eqNullSafe(latest))
    whole = (
        blocks.groupBy(*stream)
        .agg(F.sort_array(F.collect_list(F.struct(*folded))).alias("b"))
        .withColumn("b", last_start)
        .withColumn("done", first_done("b") > 0)
        .withColumn("b", up_to("b", first_done("b")))
        .select(
            *stream,
            "done",
            F.array_join("b.text", "").alias("text"),
            F.aggregate("b.n", F.lit(0).cast("long"), lambda a, n: a + n).alias("token_count"),
            *times("b"),
        )
    )
    return with_speed(whole) if timed else whole


def with_speed(folded: DataFrame) -> DataFrame:
    """Adds ``elapsed`` seconds since the request and rounded ``tokens_per_sec`` (null if short)."""
    last, start = (F.unix_micros(F.col(c).cast("timestamp")) for c in ("ts", "started"))
    speed = js_round(F.col("token_count") / F.col("elapsed"))
    return (
        folded.withColumn("elapsed", (last - start) / 1e6)
        .withColumn("tokens_per_sec", F.when(F.col("elapsed") > MIN_ELAPSED, speed))
        .drop("ts", "started")
    )


def still_running(streams: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Whether any stream of a prompt has not finished."""
    return streams.groupBy(*by).agg(
        F.bool_or(~F.col("done")).alias("is_generating"), F.count("*").alias("n_streams")
    )


def _differs(column: pa.Array) -> np.ndarray:
    """Whether a value is another one than that before it; nulls are equal."""
    now, before = column[1:], column[:-1]
    other = pc.fill_null(pc.not_equal(now, before), False)
    one_null = pc.xor(now.is_null(), before.is_null())
    return pc.or_(other, one_null).to_numpy(zero_copy_only=False)


def _runs(chunks: DataFrame, stream: tuple[str, ...], seq: str, data: str) -> DataFrame:
    """(stream, ``o``, ``data``, ``ends``): chunks that follow each other where they lie as one row.

    ``o`` is the number of the first chunk, ``ends`` where each chunk ends in the bytes of ``data``. A run lies in
    one block. Chunks are not moved for it, so a shuffle of runs carries little more than the text.
    """
    rows = chunks.select(*stream, F.col(seq).cast("long").alias("o"), F.coalesce(data, F.lit("")).alias("data"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            new = np.ones(n, bool)
            number = batch["o"]
            step = pc.subtract(number[1:], number[:-1])
            at_edge = pc.fill_null(pc.equal(pc.bit_wise_and(number[1:], BLOCK - 1), 0), True)
            new[1:] = pc.fill_null(pc.not_equal(step, 1), True).to_numpy(zero_copy_only=False)
            new[1:] |= at_edge.to_numpy(zero_copy_only=False)
            for c in stream:
                new[1:] |= _differs(batch[c])
            text = batch["data"].cast(pa.large_string())
            offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + n + 1]
            first = np.flatnonzero(new)
            cuts = np.append(first, n)
            start = np.repeat(offsets[first], np.diff(cuts))
            ends = pa.array((offsets[1:] - start).astype(np.int32))
            bounds = pa.py_buffer(np.ascontiguousarray(offsets[cuts]))
            pieces = pa.Array.from_buffers(pa.large_string(), len(first), [None, bounds, text.buffers()[2]])
            kept = [batch[c].take(pa.array(first)) for c in (*stream, "o")]
            lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), ends)
            yield pa.RecordBatch.from_arrays(
                [*kept, pieces.cast(pa.string()), lists], [*stream, "o", "data", "ends"]
            )

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in (*stream, "o", "data"))
    return rows.mapInArrow(joined, f"{kinds}, ends array<int>")


def _text_of_runs(runs: str) -> Column:
    """The text of sorted runs; runs that overlap, as numbers came twice, are sorted chunk by chunk."""

    def chunks(run: Column) -> Column:
        raw = run["data"].cast("binary")

        def chunk(end: Column, i: Column) -> Column:
            start = F.when(i > 0, F.get(run["ends"], i - 1)).otherwise(F.lit(0))
            return F.struct((run["o"] + i).alias("o"), F.substring(raw, start + 1, end - start).cast("string").alias("data"))

        return F.transform(run["ends"], chunk)

    overlaps = F.exists(
        F.arrays_zip(F.slice(runs, 1, F.size(runs) - 1).alias("a"), F.slice(runs, 2, F.size(runs)).alias("b")),
        lambda pair: F.coalesce(pair["a"]["o"] + F.size(pair["a"]["ends"]) > pair["b"]["o"], F.lit(False)),
    )
    one_by_one = F.sort_array(F.flatten(F.transform(runs, chunks)))
    return F.when(overlaps, F.array_join(F.transform(one_by_one, lambda c: c["data"]), "")).otherwise(
        F.array_join(F.col(runs)["data"], "")
    )


def chunks_to_lines(
    chunks: DataFrame, stream: tuple[str, ...], seq: str = "chunk_seq", data: str = "data"
) -> DataFrame:
    """Complete lines (``seq``, ``line``) of streams that were cut into arbitrary chunks.

    Chunks that follow each other in a task are joined there, and then blocks of chunks to one text each. A line inside a block is complete; pieces at the
    edges of blocks are joined by line number, the number of newlines before them. A last line
    without its newline is not complete and is left out. The blocks are stored, so that the chunks are
    read and assembled once for the offsets and the pieces.
    """
    runs = F.sort_array(F.collect_list(F.struct("o", "data", "ends"))).alias("p")
    blocks = (
        _runs(chunks, stream, seq, data)
        .groupBy(*stream, F.floor(F.col("o") / BLOCK).alias("block"))
        .agg(runs)
        .select(*stream, "block", F.split(_text_of_runs("p"), "\n", -1).alias("pieces"))
        .withColumn("n", F.size("pieces") - 1)
    )
    blocks = written(blocks, "chunk-blocks")
    earlier = (
        Window.partitionBy(*stream).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = blocks.select(
        *stream, "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")
    )
    placed = (
        blocks.join(offsets, [*stream, "block"])
        .select(*stream, "block", "before", "n", F.posexplode("pieces").alias("i", "piece"))
        .withColumn("seq", F.col("before") + F.col("i"))
    )
    inside = (F.col("i") > 0) & (F.col("i") < F.col("n"))
    edges = (
        placed.filter(~inside)
        .groupBy(*stream, "seq")
        .agg(
            F.sort_array(F.collect_list(F.struct("block", "piece"))).alias("p"),
            F.bool_or(F.col("i") < F.col("n")).alias("complete"),
        )
        .filter("complete")
        .select(*stream, "seq", F.array_join("p.piece", "").alias("line"))
    )
    whole = placed.filter(inside).select(*stream, "seq", F.col("piece").alias("line"))
    return whole.unionByName(edges)
