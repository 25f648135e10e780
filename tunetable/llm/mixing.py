"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Sources, ordered by code point with null last, weigh 5, 2, 1, repeating. They share `budget` times all
words by weight; a source's target stops at `most` times its own words and the excess is shared
again, so targets are min(most * size, level * weight) for one level.

Method: each source's documents are shuffled by a hash and laid end to end, `most` times over; the
first floor(target) words are taken, cut into blocks of `block` words. Slot n of the mix belongs to
the source in whose part of [0, 1) the van der Corput point of n falls; parts are as wide as the
sources' shares. The r-th slot of a source draws its block r; slots beyond a source's blocks draw nothing.
The few blocks left over, because points follow the shares within O(log n) only, are drawn by slots after
the last one, lower blocks first. Documents are joined to the slots through their blocks; the words
that are taken of a document are those in the blocks that slots draw.

Nothing is ranked in one task: prefix sums go over hash buckets, and slot ranks over runs of slots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tunetable.llm.base import checked, doc_id_of, keyed_rows, table
from tunetable.session import written

WEIGHTS = (5.0, 2.0, 1.0)
BUDGET = 1.5
MOST = 2
BLOCK = 1024
SEED = 42

#: Slots per run of ranks, and binary digits of a van der Corput point.
RUN = 1 << 16
DIGITS = 48
#: Cells of [0, 1) in which slots look for their source: at least so many, and so many per source.
CELLS = 1 << 12
CELLS_PER_SOURCE = 4

KEY = ["k_id", "k_tie"]
WORD = r"[^\x20\x09-\x0D]+"


def _ranked(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Numbers distinct rows from 0 in a global order, range by range."""
    ranges = written(rows.orderBy(*order).withColumn("part", F.spark_partition_id()), "ranges")
    counts = ranges.groupBy("part").agg(F.count("*").alias("n"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    number = F.row_number().over(W.partitionBy("part").orderBy(*order)) - 1
    numbered = ranges.withColumn(name, number).join(F.broadcast(offsets), "part")
    return numbered.withColumn(name, F.col(name) + F.col("offset")).drop("part", "offset")


def _level(sources: DataFrame, budget: float, most: int) -> float:
    """The level at which the targets min(most * size, level * weight) add up to the budget."""
    cap, weight = F.col("source_size") * most, F.col("weight")
    level, before = 0.0, -1
    while True:
        full = (F.lit(level) * weight >= cap) if before >= 0 else F.lit(False)
        row = sources.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(full, cap).otherwise(0)).alias("stopped"),
            F.sum(F.when(full, 0.0).otherwise(weight)).alias("free"),
            F.count_if(full).alias("n"),
        ).first()
        if row["n"] == before or not row["free"]:
            return level
        before = row["n"]
        level = (budget * row["all"] - row["stopped"]) / row["free"]


def source_targets(
    sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, most: int = MOST
) -> DataFrame:
    """(source, s, source_size, weight, target, words): one row per source; `words` is whole."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = _ranked(sources, [F.col("source").asc_nulls_last()], "s")
    by_rank = F.array(*(F.lit(w) for w in weights))
    weight = F.get(by_rank, (F.col("s") % len(weights)).cast("int"))
    ranked = written(ranked.withColumn("weight", weight), "sources")
    level = _level(ranked, budget, most)
    target = F.least((F.col("source_size") * most).cast("double"), F.lit(level) * F.col("weight"))
    return ranked.withColumn("target", target).withColumn("words", F.floor("target").cast("long"))


def _offsets(sizes: DataFrame) -> DataFrame:
    """Adds the place of each document's first word in its source's shuffled stream."""
    order = F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(doc_id_of().cast("string"), F.lit(""))))
    rows = sizes.withColumn("order", order).withColumn("bucket", F.substring("order", 1, 3))
    totals = rows.groupBy("s", "bucket").agg(F.sum("size").alias("n"))
    before = W.partitionBy("s").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select("s", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = W.partitionBy("s", "bucket").orderBy("order", *KEY)
    inside = inside.rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(checked(totals, "bucket-offsets"), ["s", "bucket"])
    return rows.withColumn("at", F.col("base") + F.col("inner")).drop("base", "inner", "bucket")


def schedule(targets: DataFrame, block: int = BLOCK) -> tuple[DataFrame, int]:
    """(s, rank, slot): which source each slot of the mix draws from, and the number of slots."""
    blocks = F.ceil(F.col("words") / block).cast("long")
    shares = targets.filter("words > 0").select("s", blocks.alias("blocks"))
    sums = shares.agg(F.sum("blocks").alias("blocks"), F.count("*").alias("sources")).first()
    total, cells = sums["blocks"] or 0, max(CELLS, CELLS_PER_SOURCE * sums["sources"])
    shares = _ranked(shares.select("s", "blocks"), [F.col("s").asc()], "r").drop("r")
    run = F.floor(F.col("s") / RUN)
    ends = shares.groupBy(run.alias("g")).agg(F.sum("blocks").alias("n"))
    before = W.orderBy("g").rowsBetween(W.unboundedPreceding, -1)
    ends = ends.select("g", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = W.partitionBy("g").orderBy("s").rowsBetween(W.unboundedPreceding, 0)
    shares = shares.withColumn("g", run)
    shares = shares.withColumn("high", F.sum("blocks").over(inside)).join(ends, "g")
    high = (F.col("base") + F.col("high")) / F.lit(max(total, 1)).cast("double")
    low = (F.col("base") + F.col("high") - F.col("blocks")) / F.lit(max(total, 1)).cast("double")
    parts = shares.select("s", low.alias("low"), high.alias("high"))
    cell = F.explode(
        F.sequence(
            F.floor(F.col("low") * cells),
            F.least(F.floor(F.col("high") * cells), F.lit(cells - 1).cast("long")),
        )
    )
    parts = checked(parts.select("s", "low", "high", cell.alias("cell")), "shares")
    spark = targets.sparkSession
    digits = F.reverse(F.lpad(F.bin("id"), DIGITS, "0"))
    point = F.conv(digits, 2, 10).cast("double") / float(1 << DIGITS)
    slots = spark.range(total).select(F.col("id").alias("slot"), point.alias("x"))
    slots = slots.withColumn("cell", F.floor(F.col("x") * cells)).join(parts, "cell")
    slots = slots.filter("x >= low and x < high").select("s", "slot")
    slots = written(slots.withColumn("run", F.floor(F.col("slot") / RUN)), "slots")
    counts = slots.groupBy("s", "run").agg(F.count("*").alias("n"))
    before = W.partitionBy("s").orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select("s", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rank = F.row_number().over(W.partitionBy("s", "run").orderBy("slot")) - 1
    slots = slots.withColumn("inner", rank).join(checked(counts, "slot-runs"), ["s", "run"])
    return slots.select("s", (F.col("base") + F.col("inner")).alias("rank"), "slot"), total


def draws(targets: DataFrame, block: int = BLOCK) -> DataFrame:
    """(s, rank, slot): the slot that draws each block, for every block of every source."""
    slots, total = schedule(targets, block)
    slots = written(slots, "drawn")
    drawn = slots.groupBy("s").agg(F.count("*").alias("drawn"))
    blocks = F.ceil(F.col("words") / block).cast("long")
    blocks = targets.filter("words > 0").select("s", blocks.alias("blocks"))
    short = blocks.join(drawn, "s", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
    rest = F.explode(F.sequence("drawn", F.col("blocks") - 1)).alias("rank")
    late = _ranked(short.filter("drawn < blocks").select("s", rest), [F.col("rank"), F.col("s")], "slot")
    late = late.select("s", "rank", (F.col("slot") + total).alias("slot"))
    return slots.select("s", "rank", "slot").unionByName(late)


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    budget: float = BUDGET,
    most: int = MOST,
    block: int = BLOCK,
) -> DataFrame:
    """(k_id, k_tie, doc_id, source, size, source_size, target, taken, first_slot, n_slots) per row of `docs`.

    `taken` counts the words that the mix takes of a document, repeats included, `first_slot` is the
    first slot that draws words of it (null if nothing is taken) and `n_slots` how many do. A null text has no words. A null source is a
    source of its own, the last. Repeated rows are separate documents with the same key: together they
    get what their places in the stream get, shared evenly.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = keyed_rows(docs, "text", "source")
    sizes = written(rows.select(*KEY, "source", size.alias("size")), "sizes")
    targets = checked(source_targets(sizes, weights, budget, most), "targets")
    placed = sizes.join(targets, sizes["source"].eqNullSafe(targets["source"])).select(
        *KEY, targets["source"], "size", "s", "source_size", "target", "words"
    )
    # repeated rows become one document that is `copies` times as long
    placed = placed.groupBy(*KEY, "source", "s", "source_size", "target", "words").agg(
        F.sum("size").alias("size"), F.count("*").alias("copies")
    )
    placed = written(_offsets(placed), "stream")
    passes = F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("pass")
    start = F.col("pass") * F.col("source_size") + F.col("at")
    spans = placed.filter("size > 0").select(*KEY, "s", "size", "at", "source_size", "words", passes)
    spans = spans.withColumn("a", start)
    spans = spans.withColumn("b", F.least(F.col("a") + F.col("size"), F.col("words")))
    pieces = spans.filter("b > a").select(
        *KEY,
        "s",
        "a",
        "b",
        F.explode(F.sequence(F.expr(f"a div {block}"), F.expr(f"(b - 1) div {block}"))).alias("rank"),
    )
    inside = F.least(F.col("b"), (F.col("rank") + 1) * block) - F.greatest(
        F.col("a"), F.col("rank") * block
    )
    drawn = pieces.withColumn("n", inside).join(draws(targets, block), ["s", "rank"])
    drawn = drawn.groupBy("s", *KEY).agg(
        F.sum("n").alias("taken"),
        F.min("slot").alias("first_slot"),
        F.count_distinct("slot").alias("n_slots"),
    )
    out = placed.join(drawn, ["s", *KEY], "left")
    return out.select(
        *KEY,
        doc_id_of().alias("doc_id"),
        "source",
        (F.col("size") / F.col("copies")).cast("long").alias("size"),
        "source_size",
        "target",
        F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
        "first_slot",
        F.coalesce("n_slots", F.lit(0)).alias("n_slots"),
        "copies",
    )


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its size, its source's size and target, the words taken of it and the slots that draw them."""
    return mixed_rows(table(spark, sf_dir, "documents"))


def mixed_rows(docs: DataFrame) -> DataFrame:
    """One row per row of `docs`; repeated rows share what their document got, the first ones more.

    `first_slot` and `n_slots` are those of the document, the same in all its repeated rows.
    """
    out = mix(docs)
    copy = F.posexplode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("copy", "zero")
    slots = ["first_slot", "n_slots"]
    out = out.select("doc_id", "size", "source_size", "target", "taken", *slots, "copies", copy)
    share = F.floor((F.col("taken") + F.col("copies") - 1 - F.col("copy")) / F.col("copies"))
    taken = share.cast("long").alias("taken")
    return out.select("doc_id", "size", "source_size", "target", taken, *slots)


#: The same in SQL: the closed form of the targets, the van der Corput schedule, and the overlap of each
#: document with the blocks that slots draw.
SQL = r"""
with doc as (
  select doc_id, source,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size
  from documents),
src as (
  select source, sum(size)::bigint as source_size,
    row_number() over (order by source nulls last) - 1 as s
  from doc group by source),
weighed as (
  select *, (case s % 3 when 0 then 5 when 1 then 2 else 1 end)::double as weight from src),
filled as (
  select *, coalesce(sum(2 * source_size) over w, 0) as stopped,
    (sum(weight) over ()) - coalesce(sum(weight) over w, 0) as free,
    1.5 * (sum(source_size) over ()) as budget
  from weighed
  window w as (order by 2 * source_size / weight, s rows between unbounded preceding and 1 preceding)),
level as (
  select coalesce(
    max(case when ((budget - stopped)::double / free) * weight <= 2 * source_size
      then (budget - stopped)::double / free end), 0) as level
  from filled),
target as (
  select source, s, source_size, least((2 * source_size)::double, level * weight) as target
  from weighed, level),
placed as (
  select d.doc_id, d.size, t.s, t.source_size, t.target, floor(t.target)::bigint as words,
    coalesce(sum(d.size) over (
      partition by d.source order by md5('42:' || coalesce(d.doc_id::varchar, '')), d.doc_id
      rows between unbounded preceding and 1 preceding), 0) as begin_at
  from doc d join target t on d.source is not distinct from t.source),
share as (
  select s, ceil(floor(target) / 1024)::bigint as blocks,
    coalesce(sum(ceil(floor(target) / 1024)) over (order by s rows between unbounded preceding and 1 preceding), 0)
      as before,
    (sum(ceil(floor(target) / 1024)) over ())::bigint as total
  from target where target >= 1),
point as (
  select slot, list_sum(list_transform(range(48), lambda k: ((slot >> k::integer) & 1) / pow(2.0, k + 1))) as x
  from (select unnest(range((select max(total) from share))) as slot)),
owned as (
  select s, slot, row_number() over (partition by s order by slot) - 1 as rank
  from point asof join (select s, before / total::double as low from share) p on x >= low),
late as (
  select s, rank, (select max(total) from share) + row_number() over (order by rank, s) - 1 as slot
  from (select s, unnest(range(blocks)) as rank from share) b
  where not exists (from owned o where o.s = b.s and o.rank = b.rank)),
drawn as (select s, rank, slot from owned union all select s, rank, slot from late),
span as (
  select doc_id, s, begin_at + pass * source_size as a,
    least(begin_at + pass * source_size + size, words) as b
  from placed, (values (0), (1)) v(pass) where size > 0),
piece as (
  select doc_id, s, a, b, unnest(range((a // 1024)::bigint, ((b - 1) // 1024)::bigint + 1)) as rank
  from span where b > a),
got as (
  select doc_id, sum(least(b, (rank + 1) * 1024) - greatest(a, rank * 1024)) as taken,
    min(slot) as first_slot, count(distinct slot) as n_slots
  from piece join drawn using (s, rank) group by doc_id)
select doc_id, size, source_size, target, coalesce(taken, 0)::bigint as taken,
  first_slot::bigint as first_slot, coalesce(n_slots, 0)::bigint as n_slots
from placed left join got using (doc_id)
"""
