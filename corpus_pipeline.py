"""Corpus preparation in five stages, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last
return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunetable.llm import decontamination, jaccard_join, language_id, line_dedup, mixing
from tunetable.llm.base import beside, keyed_rows, table, with_text
from tunetable.session import scratch_path, written

KEY = ["k_id", "k_tie"]


def _without(docs: DataFrame, keys: DataFrame, label: str) -> DataFrame:
    """The rows of `docs` whose key is not among `keys`."""
    rows = keyed_rows(docs, whole=True)
    return beside(rows, written(keys.select(*KEY).distinct(), label), "left_anti")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, and those in no learned language or an undecided one, go."""
    return language_id.in_a_learned_language(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cross-site lines go from the texts; a document that consisted of them goes as a whole."""
    out = line_dedup.without_shared_lines(docs)
    emptied = (F.col("n_removed") > 0) & ~F.coalesce(F.col("text"), F.lit("")).rlike(r"\S")
    out = with_text(out.filter(~emptied).select("row", "text", "n_removed"), docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one with the smallest doc_id."""
    groups = jaccard_join.near_duplicate_groups(docs)
    others = groups.filter((F.col("k_id") != F.col("c_id")) | (F.col("k_tie") != F.col("c_tie")))
    kept = _without(docs, others, "duplicates")
    repeated = groups.filter("n > 0").groupBy(*KEY).count().filter("count > 1")
    if not repeated.isEmpty():
        nothing = ~F.coalesce(F.col("row.text"), F.lit("")).rlike(r"\S")
        # of rows equal in doc_id and text, the same one in every run
        first = F.min_by("row", F.xxhash64("row")).alias("row")
        same = kept.filter(~nothing).groupBy(*KEY).agg(first)
        kept = kept.filter(nothing).unionByName(same)
    return kept.select("row.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    pairs = decontamination.contaminated_pairs(docs, table(spark, sf_dir, "benchmark"))
    return _without(docs, pairs, "contaminated").select("row.*")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the training mix takes of each remaining document, and in which slots."""
    return mixing.mixed_rows(docs)


STAGES = [
    ("language_id", language),
    ("line_dedup", lines),
    ("jaccard_join", near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mixture),
]

#: The language model and the tilings have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; every stage is stored, so a lost executor costs one at most."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
