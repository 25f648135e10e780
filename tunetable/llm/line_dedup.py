"""Removal of lines that many sites share, by merged distinct-site sketches.

A line is the text between newlines; it is recognised without the white space around it, and blank
lines are never boilerplate. A line is boilerplate if it occurs at `min_sites` distinct sites or more
(a null site counts for none). Its first occurrence, by document and line number, stays.

Method: one HyperLogLog sketch of sites per line hash, merged by the aggregation. Lines whose estimate is
further from the threshold than the sketch's error band are decided by it; lines inside the band get
an exact distinct count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tunetable.llm.base import beside, checked, doc_id_of, keyed_rows, table
from tunetable.session import written

MIN_SITES = 10
#: log2 of the registers of a sketch; the relative standard error is 1.04 / sqrt(2 ** LG_K).
LG_K = 8
#: Width of the band around the threshold, in standard errors.
SIGMAS = 4.0

BLANK = " \t\r\u000b\u000c"
KEY = ["k_id", "k_tie"]


def _bare(line: Column) -> Column:
    return F.trim(line, F.lit(BLANK))


def _lines(docs: DataFrame, site: str) -> DataFrame:
    """(k_id, k_tie, pos, h1, h2, site) of every line that is not blank."""
    rows = keyed_rows(docs, "text", site).select(*KEY, "text", F.col(site).alias("site"))
    lines = rows.select(*KEY, "site", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    bare = _bare(F.col("line"))
    lines = lines.select(*KEY, "pos", "site", bare.alias("line")).filter(F.length("line") > 0)
    return lines.select(
        *KEY, "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), "site"
    )


def shared_lines(docs: DataFrame, min_sites: int = MIN_SITES, site: str = "source") -> DataFrame:
    """(h1, h2, first): the lines at `min_sites` sites or more and where each occurs first."""
    lines = _lines(docs, site)
    spread = lines.groupBy("h1", "h2").agg(
        F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"),
        F.min(F.struct(*KEY, "pos")).alias("first"),
    )
    band = SIGMAS * 1.04 / (2 ** (LG_K / 2))
    spread = spread.withColumn("sites", F.hll_sketch_estimate("sketch")).drop("sketch")
    spread = written(spread.filter(F.col("sites") >= min_sites / (1 + band)), "line-spread")
    clear = spread.filter(F.col("sites") > min_sites * (1 + band))
    near = checked(spread.filter(F.col("sites") <= min_sites * (1 + band)), "near-lines")
    exact = (
        lines.join(near.select("h1", "h2"), ["h1", "h2"], "left_semi")
        .select("h1", "h2", "site")
        .distinct()
        .groupBy("h1", "h2")
        .agg(F.count("site").alias("exact"))
        .filter(F.col("exact") >= min_sites)
    )
    decided = near.join(exact, ["h1", "h2"])
    return clear.select("h1", "h2", "first").unionByName(decided.select("h1", "h2", "first"))


def without_shared_lines(
    docs: DataFrame, min_sites: int = MIN_SITES, site: str = "source"
) -> DataFrame:
    """(k_id, k_tie, row, n_lines, n_removed, text): each row of `docs` and its text without the lines.

    `row` holds all columns of `docs`. A null text has no lines and stays null. Rows that agree in
    doc_id and text are one document and get the same result.
    """
    shared = checked(shared_lines(docs, min_sites, site), "shared-lines")
    lines = _lines(docs, site)
    gone = (
        lines.join(shared, ["h1", "h2"])
        .filter(F.struct(*KEY, "pos") != F.col("first"))
        .select(*KEY, "pos")
        .groupBy(*KEY)
        .agg(F.collect_set("pos").alias("gone"))
    )
    joined = beside(keyed_rows(docs, whole=True), gone, "left")
    text, touched = F.col("row.text"), F.col("gone").isNotNull()
    parts = F.split(text, "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("gone"))
    rest = F.concat_ws("\n", F.transform(kept, lambda i: F.get(parts, i)))
    return joined.select(
        *KEY,
        "row",
        F.when(text.isNull(), 0).otherwise(F.size(parts)).cast("long").alias("n_lines"),
        F.when(touched, F.size("gone")).otherwise(0).cast("long").alias("n_removed"),
        F.when(touched, rest).otherwise(text).alias("text"),
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the number of its lines, of the removed ones, and a digest of the rest."""
    out = without_shared_lines(table(spark, sf_dir, "documents"))
    return out.select(
        doc_id_of().alias("doc_id"),
        "n_lines",
        "n_removed",
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


#: The same in SQL; min_sites and the white space are written out.
SQL = r"""
with doc as (select doc_id, source, text, string_split(text, chr(10)) as parts from documents),
lines as (
  select doc_id, source, pos, trim(parts[pos], chr(32) || chr(9) || chr(13) || chr(11) || chr(12)) as line
  from (select doc_id, source, parts, unnest(range(1, len(parts) + 1)) as pos from doc)),
shared as (
  select line, min(struct_pack(d := doc_id, p := pos)) as first
  from lines where line <> '' group by line having count(distinct source) >= 10),
gone as (
  select l.doc_id, l.pos from lines l join shared s using (line)
  where struct_pack(d := l.doc_id, p := l.pos) <> s.first),
kept as (
  select l.doc_id, count(g.pos) as n_removed
  from lines l left join gone g on l.doc_id = g.doc_id and l.pos = g.pos group by l.doc_id),
rest as (
  select e.doc_id, string_agg(e.part, chr(10) order by e.pos) as text
  from (select doc_id, parts[pos] as part, pos
        from (select doc_id, parts, unnest(range(1, len(parts) + 1)) as pos from doc)) e
  left join gone g on e.doc_id = g.doc_id and e.pos = g.pos
  where g.pos is null group by e.doc_id)
select d.doc_id, coalesce(len(d.parts), 0)::bigint as n_lines,
  coalesce(k.n_removed, 0)::bigint as n_removed, sha256(coalesce(r.text, '')) as kept_sha256
from doc d left join kept k using (doc_id) left join rest r using (doc_id)
"""
