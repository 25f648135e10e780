"""Spelling variants by a bit-sliced position index.

Words are the runs of `[A-Za-z\\u00C0-\\u00FF]` with A-Z lower-cased; all their letters are code points
below 256, so a word is a row of bytes, one per code point. Two words are near if one inserted, deleted or
replaced code point turns one into the other.

Method: the vocabulary is dealt into blocks of words of one length. Per position and letter a block has a
bitset over its words. A word that asks walks through its letters and carries two bitsets at once, one bit
per word of the block: words that agree so far without an error, and words that agree with one error.
Replaced letters compare at the same position, letters that the block's words have in excess or lack at the
next or the previous one; which of the three applies follows from the lengths.

Blocks: the words of length L are indexed twice, by their first L // 2 letters and by the remaining ones. One
error leaves one of the two parts intact, so a word asks only where it has the same first or last part. A pair
is taken where the first parts agree if they do, and where the last parts agree otherwise, that is once.
A part that more than BLOCK_WORDS words have is dealt over several blocks, all of which are asked.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunetable.llm.base import checked, table
from tunetable.llm.tokens import LOWER, text_slices, word_hashes, word_spans
from tunetable.session import ship_package, written

LEAST_LETTERS = 6
LEAST_COUNT = 5
#: A form is at least so many times as frequent as its variant.
FORM_RATIO = 5
#: One run in so many, by the checksum of document and run, loses a letter; 0 turns that off.
SLIP = 199
#: Words of a block of the index.
BLOCK_WORDS = 1024
#: Distinct words that a counting task holds before it hands them on.
HELD_WORDS = 1 << 18
SLICE_BYTES = 8 << 20

_GAP = np.zeros(256, bool)
_GAP[0] = True
_LETTER = np.zeros(256, np.uint8)
_LETTER[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)

_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1)


def latin_letters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 rows as one byte per letter, the code point, and 0 for everything else; new row offsets."""
    follows = np.zeros(len(data), bool)
    follows[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] < 0xC0)
    codes = _LETTER[LOWER[data]]
    codes[follows] = data[follows] + 0x40
    kept = np.ones(len(data), bool)
    kept[:-1] = ~follows[1:]
    before = np.zeros(len(data) + 1, np.int64)
    np.cumsum(kept, out=before[1:])
    return codes[kept], before[offsets]


def _checksums(codes, starts, lengths, state: np.ndarray) -> np.ndarray:
    """CRC-32 of `state`'s bytes followed by each word in UTF-8."""
    crc = ~state
    step = lambda c, byte: _CRC[(c ^ byte) & 0xFF] ^ (c >> np.uint32(8))
    todo = np.arange(len(starts))
    for at in range(64):
        todo = todo[lengths[todo] > at]
        if not len(todo):
            break
        letter = codes[starts[todo] + at].astype(np.uint32)
        now = crc[todo]
        high = letter >= 0x80
        now = np.where(high, step(now, np.uint32(0xC3)), now)
        crc[todo] = step(now, np.where(high, letter - np.uint32(0x40), letter))
    crc = ~crc
    for i in todo[lengths[todo] > 64]:
        rest = codes[starts[i] + 64 : starts[i] + lengths[i]].tobytes().decode("latin-1")
        crc[i] = zlib.crc32(rest.encode(), int(crc[i]))
    return crc


def counted(ids: list[int | None], data: np.ndarray, offsets: np.ndarray, least: int, slip: int):
    """Counter of the words of at least `least` letters in rows of bytes."""
    out: Counter[str] = Counter()
    codes, offsets = latin_letters(data, offsets)
    starts, ends, first = word_spans(codes, offsets, _GAP)
    row = np.repeat(np.arange(len(ids)), np.diff(first))
    long = np.flatnonzero(ends - starts >= least)
    starts, ends, row = starts[long], ends[long], row[long]
    lengths = ends - starts
    if slip:
        heads = [zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids]
        crc = _checksums(codes, starts, lengths, np.array(heads, np.uint32)[row])
        hit = crc % np.uint32(slip) == 0
        for i in np.flatnonzero(hit & (lengths > least)):
            word = codes[starts[i] : ends[i]].tobytes().decode("latin-1")
            at = int(crc[i]) % len(word)
            out[word[:at] + word[at + 1 :]] += 1
        starts, ends = starts[~hit], ends[~hit]
    if len(starts):
        hashes = word_hashes(codes, starts, ends)
        _, place, times = np.unique(hashes, return_index=True, return_counts=True)
        raw = codes.tobytes()
        for a, b, n in zip(starts[place].tolist(), ends[place].tolist(), times.tolist()):
            out[raw[a:b].decode("latin-1")] += n
    return out


def word_counts(
    docs: DataFrame,
    least_letters: int = LEAST_LETTERS,
    least_count: int = LEAST_COUNT,
    slip: int = SLIP,
) -> DataFrame:
    """(word, n): the words of all texts with at least so many letters and occurrences.

    A null text has no words; repeated rows count as often as they stand there. With `slip`, a run whose
    checksum with its doc_id (a null one is empty) it divides loses the letter at checksum modulo length.
    Tasks add up their words first, so a word of a third of all occurrences sends a few rows per task.
    """
    ship_package(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            rows = [pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())]
            return pa.RecordBatch.from_arrays(rows, ["word", "n"])

        for batch in batches:
            ids = batch["id"].to_pylist()
            for low, high, data, offsets in text_slices(batch["body"], SLICE_BYTES):
                held.update(counted(ids[low:high], data, offsets, least_letters, slip))
                if len(held) > HELD_WORDS:
                    yield out()
                    held = Counter()
        yield out()

    rows = docs.select(
        F.col("doc_id").cast("long").alias("id"), F.col("text").cast("binary").alias("body")
    )
    found = rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return found.filter(F.col("n") >= least_count)


class PositionIndex:
    """Bitsets over words of one length, per position and letter.

    Words are numbered in the given order; bit j of a row of 64-bit values stands for word j.
    """

    def __init__(self, words: list[str]):
        self.length, self.count = len(words[0]), len(words)
        raw = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
        self.letters = raw.reshape(self.count, self.length)
        self.width = -(-self.count // 64)
        everyone = np.zeros(self.width * 64, np.uint8)
        everyone[: self.count] = 1
        self.everyone = np.packbits(everyone, bitorder="little").view(np.uint64)
        self.slices: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def at(self, position: int) -> tuple[np.ndarray, np.ndarray]:
        """(row of each letter, bitset rows) at a position; row 0 is empty. Three positions are held."""
        known = self.slices.get(position)
        if known is None:
            row = np.zeros(256, np.int64)
            if 0 <= position < self.length:
                column = self.letters[:, position]
                present = np.flatnonzero(np.bincount(column, minlength=256))
                row[present] = np.arange(1, len(present) + 1)
                dense = np.zeros((len(present) + 1, self.width * 64), np.uint8)
                dense[row[column], np.arange(self.count)] = 1
                bits = np.packbits(dense, axis=1, bitorder="little").view(np.uint64)
            else:
                bits = np.zeros((1, self.width), np.uint64)
            self.slices.pop(position - 3, None)
            known = self.slices[position] = row, bits
        return known

    def having(self, position: int, letters: np.ndarray) -> np.ndarray:
        row, bits = self.at(position)
        return bits[row[letters]]

    def near(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For words of one length, as rows of letters: (bitsets of near words, of those among them and
        others with the same first half)."""
        self.slices.clear()
        rows, length = asked.shape
        exact = np.repeat(self.everyone[None, :], rows, axis=0)
        half = exact
        off = np.zeros_like(exact)
        for i in range(length):
            letters = asked[:, i]
            if length == self.length:
                same = self.having(i, letters)
                off = (off & same) | (exact & ~same)
            elif length < self.length:
                off = (off | exact) & self.having(i + 1, letters)
                same = self.having(i, letters)
            else:
                off = (off & self.having(i - 1, letters)) | exact
                same = self.having(i, letters)
            exact = exact & same
            if i + 1 == self.length // 2:
                half = exact
        return (off | exact if length < self.length else off), half


def block_answers(words: list[str], counts: list[int], asked: list[str], first: bool):
    """(word, near words, count of the best, the best) for the asked words with a near word in a block.

    The best is the most frequent one, ties to the smaller. `first` says which part the block is by.
    """
    order = sorted(range(len(words)), key=lambda j: (-counts[j], words[j]))
    words, counts = [words[j] for j in order], [counts[j] for j in order]
    index = PositionIndex(words)
    by_length: dict[int, list[str]] = {}
    for word in asked:
        by_length.setdefault(len(word), []).append(word)
    for length, rows in by_length.items():
        step = max(1, (1 << 16) // index.width)
        for low in range(0, len(rows), step):
            some = rows[low : low + step]
            raw = np.frombuffer("".join(some).encode("latin-1"), np.uint8)
            found, half = index.near(raw.reshape(len(some), length))
            found = found & (half if first else ~half)
            hit = np.flatnonzero(found.any(axis=1))
            if not len(hit):
                continue
            bits = np.unpackbits(found[hit].view(np.uint8), axis=1, bitorder="little")
            best, total = bits.argmax(axis=1), bits.sum(axis=1, dtype=np.int64)
            for i, j, n in zip(hit.tolist(), best.tolist(), total.tolist()):
                yield some[i], n, counts[j], words[j]


def near_words(vocabulary: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(word, n_near, best_n, best): for each word of a stored (word, n) that has near words."""
    spark = vocabulary.sparkSession
    ship_package(spark)
    words = vocabulary.withColumn("len", F.char_length("word"))
    half = lambda length: F.floor(length / 2).cast("int")

    def entries(shifts: list[int], is_query: bool) -> DataFrame:
        parts = []
        for shift in shifts:
            length = F.col("len") + shift
            head = F.substring("word", F.lit(1), half(length))
            tail = F.right("word", length - half(length))
            for first, part in ((True, head), (False, tail)):
                key = F.xxhash64(length, F.lit(first), part)
                parts.append(F.struct(length.alias("length"), F.lit(first).alias("first"), key.alias("key")))
        out = words.select("word", "n", F.explode(F.array(*parts)).alias("e"))
        return out.select("e.*", F.lit(is_query).alias("is_query"), "word", "n")

    index, asking = entries([0], False), entries([-1, 0, 1], True)
    lengths = words.groupBy(F.col("len").alias("length")).agg(F.count("*").alias("words"))
    lengths = checked(lengths, "word-lengths")
    often = index.groupBy("key").agg(F.count("*").alias("often"))
    often = checked(often.filter(F.col("often") > block_words), "frequent-parts")
    parts = F.coalesce(F.ceil(F.col("often") / block_words).cast("int"), F.lit(1))
    index = index.join(often, "key", "left")
    index = index.withColumn("sub", F.pmod(F.xxhash64("word"), parts).cast("int"))
    asking = asking.join(often, "key", "left")
    asking = asking.withColumn("sub", F.explode(F.sequence(F.lit(0), parts - 1)))
    both = index.drop("often").unionByName(asking.drop("often")).join(lengths, "length")
    blocks = F.ceil(F.col("words") / block_words)
    both = both.withColumn("block", F.pmod(F.xxhash64("key", "sub"), blocks).cast("int"))

    def answer(group: pa.Table) -> pa.Table:
        query = group["is_query"].to_numpy()
        held, asked = group.filter(pa.array(~query)), group.filter(pa.array(query))
        found = []
        if held.num_rows and asked.num_rows:
            first = group["first"][0].as_py()
            held_words, times = held["word"].to_pylist(), held["n"].to_pylist()
            # the parts of a frequent key may have come to the same block
            asked_words = pc.unique(asked["word"]).to_pylist()
            found = list(block_answers(held_words, times, asked_words, first))
        columns = list(zip(*found)) or [[], [], [], []]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.table(
            [pa.array(c, kind) for c, kind in zip(columns, kinds)],
            names=["word", "n_near", "best_n", "best"],
        )

    found = (
        both.select("length", "first", "block", "is_query", "word", "n")
        .groupBy("length", "first", "block")
        .applyInArrow(answer, "word string, n_near long, best_n long, best string")
    )
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("b")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select(
        "word", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.best").alias("best")
    )


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of a table (word, form) without circles: each word's last form, by pointer doubling.

    Counts grow by FORM_RATIO along a chain, so a few rounds do; each is stored.
    """
    known = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = known.select(F.col("word").alias("root"), F.col("root").alias("next"))
        known = written(
            known.join(on, "root", "left").select(
                "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")
            ),
            "roots",
        )
        if known.filter("moved").isEmpty():
            return known.select("word", "root")
        known = known.select("word", "root")


def spelling_groups(docs: DataFrame, slip: int = 0, **bounds: int) -> DataFrame:
    """(word, form, root, n, n_near, form_n): the vocabulary of all texts with its variants grouped.

    `form` is the near word with the largest count (ties to the smaller one) if it has at least FORM_RATIO
    times the word's, else null; `root` is the last word along forms, the word itself without one. Empty
    tables and texts without long words give no rows. `bounds` go to `word_counts`.
    """
    vocabulary = written(word_counts(docs, slip=slip, **bounds), "vocabulary")
    near = written(near_words(vocabulary), "near-words")
    has = F.col("best_n") >= FORM_RATIO * F.col("n")
    rows = vocabulary.join(near, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(has, F.col("best")).alias("form"),
        F.when(has, F.col("best_n")).alias("form_n"),
    )
    rows = written(rows, "spellings")
    last = roots(rows.filter("form is not null").select("word", "form"))
    return rows.join(last, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents, each with its number of near words, its form and its root."""
    return spelling_groups(table(spark, sf_dir, "documents"), slip=SLIP)


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: 64 characters that no word has stand for the letters of two bytes, since edit distance counts bytes.
_ACCENTED = "".join(chr(c) for c in range(0xC0, 0x100))
_STAND_IN = "".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).islower() and c not in (0x27, 0x5C))[:64]

SQL = f"""
with recursive
bytes as (select b, list_reduce([b::ubigint, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda a, x: xor(a >> 1, (a & 1) * 3988292384)) as c from (select unnest(range(256)) as b)),
crc_table as materialized (select list(c order by b) as t from bytes),
runs as (select coalesce(doc_id::varchar, '') as id,
    unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) as run from documents),
lowered as (select id, translate(run, '{_UPPER}', '{_UPPER.lower()}') as run, count(*) as k
    from runs where length(run) >= {LEAST_LETTERS} group by all),
summed as (select run, k, xor(list_reduce(
    list_prepend(4294967295::ubigint, list_transform(range(1, octet_length(encode(id || ':' || run)) + 1),
        lambda i: ('0x' || substr(hex(encode(id || ':' || run)), (2 * i - 1)::integer, 2))::ubigint)),
    lambda a, x: xor(a >> 8, t[((xor(a, x) & 255) + 1)::integer])), 4294967295) as h
    from lowered, crc_table),
words as (select case when h % {SLIP} = 0
    then substr(run, 1, (h % length(run))::integer) || substr(run, (h % length(run))::integer + 2)
    else run end as word, k from summed),
vocabulary as materialized (select word, sum(k)::bigint as n, length(word) as len,
    translate(word, '{_ACCENTED}', '{_STAND_IN}') as plain
    from words where length(word) >= {LEAST_LETTERS} group by word having sum(k) >= {LEAST_COUNT}),
near as materialized (select a.word, a.n, b.word as other, b.n as other_n
    from vocabulary a join vocabulary b on b.len between a.len - 1 and a.len + 1
    where levenshtein(a.plain, b.plain) = 1),
best as (select word, n, count(*)::bigint as n_near,
    first(other order by other_n desc, encode(other)) as other, max(other_n) as other_n from near group by all),
formed as materialized (select v.word, v.n, coalesce(n_near, 0)::bigint as n_near,
    case when other_n >= {FORM_RATIO} * v.n then other end as form,
    case when other_n >= {FORM_RATIO} * v.n then other_n end as form_n
    from vocabulary v left join best using (word)),
chain as (select word, word as root from formed
    union all select c.word, f.form from chain c join formed f on f.word = c.root where f.form is not null),
last as (select c.word, c.root from chain c join formed f on f.word = c.root where f.form is null)
select word, form, root, n, n_near, form_n from formed join last using (word)
"""
