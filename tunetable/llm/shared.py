"""Which positions of which rows carry a key that other positions carry too, without shuffling rows.

Each map task packs its (key, row, position) entries into one binary value per bucket of keys, so
that a shuffled entry costs 8 to 12 bytes. Keys that repeat inside a slice of a task's rows (2 MB of text)
are settled there: their positions are passed on as found and one representative stands for them in the
bucket. A key that a third of all rows carry therefore sends one entry per slice to its bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tunetable.llm.tokens import mixed

PACKED = "bucket int, settled boolean, packed binary"
HOMES = "bucket int, packed binary"
MARKS = "k_id long, k_tie long, n_marks long, marks binary"

#: (row, position, high key, low key or None) of the entries of a slice of rows
Entries = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]
#: (batch) -> runs of (k_id, k_tie, entries)
Source = Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray, Entries]]]


def _planes(values: np.ndarray, width: int) -> bytes:
    """The low `width` bytes of each value, byte by byte: planes of equal bytes compress well."""
    return values.view(np.uint8).reshape(len(values), values.itemsize)[:, :width].T.tobytes()


def _unplaned(raw: memoryview, at: int, count: int, width: int, dtype) -> tuple[np.ndarray, int]:
    out = np.zeros((count, np.dtype(dtype).itemsize), np.uint8)
    end = at + count * width
    out[:, :width] = np.frombuffer(raw[at:end], np.uint8).reshape(width, count).T
    return out.reshape(-1).view(dtype), end


def _pack(ids, ties, rows, positions, weights, high, low) -> bytes:
    """Entries sorted by row; rows are numbered within the packed value."""
    new = np.flatnonzero(np.diff(rows, prepend=-1))
    row = rows[new]
    counts = np.diff(np.append(new, len(rows))).astype(np.uint32)
    tied = bool(ties[row].any())
    head = np.array([len(rows), len(row), tied, low is not None], np.int32)
    parts = [head.tobytes(), _planes(counts, 4), _planes(ids[row], 8)]
    if tied:
        parts.append(_planes(ties[row], 8))
    parts += [_planes(positions.astype(np.uint32), 4), _planes(weights.astype(np.uint8), 1)]
    parts.append(_planes(high, 8 if low is not None else 6))
    if low is not None:
        parts.append(_planes(low, 8))
    return b"".join(parts)


def _unpack(raw: memoryview):
    entries, rows, tied, double = np.frombuffer(raw[:16], np.int32)
    counts, at = _unplaned(raw, 16, rows, 4, np.uint32)
    ids, at = _unplaned(raw, at, rows, 8, np.int64)
    ties = np.zeros(rows, np.int64)
    if tied:
        ties, at = _unplaned(raw, at, rows, 8, np.int64)
    positions, at = _unplaned(raw, at, entries, 4, np.uint32)
    weights, at = _unplaned(raw, at, entries, 1, np.uint8)
    high, at = _unplaned(raw, at, entries, 8 if double else 6, np.uint64)
    low = np.zeros(0, np.uint64)
    if double:
        low, at = _unplaned(raw, at, entries, 8, np.uint64)
    return np.repeat(ids, counts), np.repeat(ties, counts), positions, weights, high, low


def _grouped(high, low, order_by) -> tuple[np.ndarray, np.ndarray]:
    """(order, group number of each entry in that order); equal keys are one group."""
    keys = [*order_by, *([low] if low is not None and len(low) else []), high]
    order = np.lexsort(keys)
    change = np.zeros(len(order), bool)
    change[1:] = high[order][1:] != high[order][:-1]
    if low is not None and len(low):
        change[1:] |= low[order][1:] != low[order][:-1]
    return order, np.cumsum(change)


def _later(order, group, ids, ties, positions) -> np.ndarray:
    """Entries that differ from the first one of their group, in the given order."""
    first = order[np.searchsorted(group, np.arange(group[-1] + 1))][group]
    return (
        (ids[order] != ids[first])
        | (ties[order] != ties[first])
        | (positions[order] != positions[first])
    )


def _marks(ids, ties, positions, buckets: int, counts_only: bool) -> tuple[np.ndarray, list[bytes]]:
    """Marked positions packed by the home bucket of their document: (buckets, packed values)."""
    home = mixed((ids ^ ties).view(np.uint64)) % np.uint64(buckets)
    order = np.lexsort((positions, ties, ids, home))
    ids, ties, positions, home = ids[order], ties[order], positions[order], home[order]
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (ties[1:] != ties[:-1])
    new = np.flatnonzero(new)
    counts = np.diff(np.append(new, len(ids))).astype(np.uint32)
    cuts = np.flatnonzero(np.diff(home[new].astype(np.int64), prepend=-1))
    packed = []
    for a, b in zip(cuts, np.append(cuts[1:], len(new))):
        rows, end = new[a:b], new[b] if b < len(new) else len(ids)
        marks = positions[new[a] : end]
        head = np.array([len(rows), 0 if counts_only else len(marks)], np.int32)
        parts = [head.tobytes(), _planes(ids[rows], 8), _planes(ties[rows], 8)]
        parts.append(_planes(counts[a:b], 4))
        if not counts_only:
            parts.append(_planes(marks.astype(np.uint32), 4))
        packed.append(b"".join(parts))
    return home[new][cuts].astype(np.int32), packed


def _unmarked(raw: memoryview):
    rows, marks = np.frombuffer(raw[:8], np.int32)
    ids, at = _unplaned(raw, 8, rows, 8, np.int64)
    ties, at = _unplaned(raw, at, rows, 8, np.int64)
    counts, at = _unplaned(raw, at, rows, 4, np.uint32)
    positions, at = _unplaned(raw, at, marks, 4, np.uint32)
    return ids, ties, counts, positions


def shared_positions(
    rows: DataFrame, source: Source, buckets: int, *, keep_first: bool, counts_only: bool = False
) -> DataFrame:
    """(k_id, k_tie, n_marks, marks): per document the positions whose key some other entry has.

    Documents without such a position do not appear. With `keep_first` the first entry of a key, by
    (k_id, k_tie, position), is not marked. Marks are little-endian 32-bit positions; `counts_only`
    leaves them empty and only counts.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, ties, entries in source(batch):
                row, position, high, low = entries
                if not len(row):
                    continue
                by = (position, ties[row], ids[row]) if keep_first else ()
                order, group = _grouped(high, low, by)
                sizes = np.bincount(group)
                if keep_first:
                    found = order[_later(order, group, ids[row], ties[row], position)]
                else:
                    found = order[sizes[group] > 1]
                home, marked = _marks(
                    ids[row[found]], ties[row[found]], position[found], buckets, counts_only
                )
                heads = order[np.searchsorted(group, np.arange(len(sizes)))]
                bucket, packed = _sent(ids, ties, entries, heads, sizes, buckets)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([home, bucket])),
                        pa.array(np.arange(len(home) + len(bucket)) < len(home)),
                        pa.array(marked + packed, pa.binary()),
                    ],
                    ["bucket", "settled", "packed"],
                )

    def settle(group: pa.Table) -> pa.Table:
        out = [group.filter(group["settled"]).select(["bucket", "packed"])]
        packed = group.filter(pc.invert(group["settled"]))["packed"]
        if len(packed):
            pieces = [_unpack(memoryview(x.as_buffer())) for x in packed]
            ids, ties, positions, weights, high, low = (
                np.concatenate(part) for part in zip(*pieces)
            )
            order, number = _grouped(high, low, (positions, ties, ids) if keep_first else ())
            if keep_first:
                chosen = order[_later(order, number, ids, ties, positions)]
            else:
                total = np.bincount(number, weights[order])
                chosen = order[(total[number] > 1) & (weights[order] == 1)]
            home, marked = _marks(
                ids[chosen], ties[chosen], positions[chosen], buckets, counts_only
            )
            out.append(pa.table([pa.array(home), pa.array(marked, pa.binary())], ["bucket", "packed"]))
        return pa.concat_tables(out)

    def gather(group: pa.Table) -> pa.Table:
        pieces = [_unmarked(memoryview(x.as_buffer())) for x in group["packed"]]
        ids, ties, counts, positions = (np.concatenate(part) for part in zip(*pieces))
        order = np.lexsort((ties, ids))
        new = np.ones(len(ids), bool)
        new[1:] = (np.diff(ids[order]) != 0) | (np.diff(ties[order]) != 0)
        heads = np.flatnonzero(new)
        n = np.add.reduceat(counts[order].astype(np.int64), heads)
        ends = np.zeros(len(heads) + 1, np.int64)
        if not counts_only:
            ends[1:] = np.cumsum(n)
            begin = np.cumsum(counts.astype(np.int64)) - counts
            length = counts[order].astype(np.int64)
            at = np.repeat(begin[order] - (np.cumsum(length) - length), length)
            positions = positions[at + np.arange(len(at))]
        marks = pa.Array.from_buffers(
            pa.large_binary(),
            len(heads),
            [None, pa.py_buffer(ends * 4), pa.py_buffer(positions.astype(np.int32))],
        )
        first = order[heads]
        return pa.table(
            [pa.array(ids[first]), pa.array(ties[first]), pa.array(n), marks.cast(pa.binary())],
            ["k_id", "k_tie", "n_marks", "marks"],
        )

    found = rows.mapInArrow(pack, PACKED).groupBy("bucket").applyInArrow(settle, HOMES)
    return found.groupBy("bucket").applyInArrow(gather, MARKS)


def _sent(ids, ties, entries: Entries, heads, sizes, buckets: int):
    """(buckets, packed entries); a key that repeats in the task counts twice and is settled."""
    row, position, high, low = entries
    bucket = ((high[heads] >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    order = np.lexsort((position[heads], row[heads], bucket))
    bucket, heads, weights = bucket[order].astype(np.int32), heads[order], sizes[order]
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
    packed = [
        _pack(ids, ties, row[e], position[e], w, high[e], None if low is None else low[e])
        for e, w in zip(np.split(heads, cuts[1:]), np.split(np.minimum(weights, 2), cuts[1:]))
    ]
    return bucket[cuts], packed
