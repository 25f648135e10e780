"""Rows of text files by their place: line numbers, pairing by position, keys for rows without one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tunetable.session import written

SPLIT = ("_file", "_block")


def text_rows(spark: SparkSession, path: str | list[str], blank: bool = False) -> DataFrame:
    """(``_file``, ``_block``, ``_at``, ``value``): the lines of text files, blank ones only if asked for, stored.

    ``_block`` is the byte where the line's input split begins and ``_at`` counts on within it, so
    (``_file``, ``_block``, ``_at``) is the order of the files by name and of their lines. A split is read by one
    task in order, so nothing is sorted or shuffled.
    """
    meta = [F.col(f"_metadata.{c}").alias(n) for c, n in (("file_path", "_file"), ("file_block_start", "_block"))]
    lines = spark.read.text(path).select(*meta, "value")
    if not blank:
        lines = lines.filter(F.col("value").rlike(r"\S"))
    return written(lines.select(*SPLIT, F.monotonically_increasing_id().alias("_at"), "value"), "lines")


def with_position(rows: DataFrame, name: str = "position") -> DataFrame:
    """Adds the place of each row of ``text_rows`` in the whole input, from 0.

    One row per input split is summed up in order and joined back; the rows stay where they are.
    """
    splits = rows.groupBy(*SPLIT).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    earlier = Window.orderBy(*SPLIT).rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    place = F.col("_before") + F.col("_at") - F.col("_first")
    return rows.join(splits.drop("_n"), list(SPLIT)).withColumn(name, place).drop("_before", "_first")


def json_rows(rows: DataFrame, schema: StructType | str) -> DataFrame:
    """The fields of JSON lines beside their place; a malformed line is an error."""
    parsed = F.from_json("value", schema, {"mode": "FAILFAST"})
    return rows.withColumn("_row", parsed).select(*(c for c in rows.columns if c != "value"), "_row.*")


def align_by_position(
    spark: SparkSession,
    predictions: str | list[str],
    references: str | list[str],
    prediction: str = "prediction",
    reference: str = "reference",
) -> DataFrame:
    """(``position``, ``prediction``, ``reference``): the n-th line of both inputs, of JSON lines without keys.

    Pairs stop at the shorter input; ``pairing_counts`` tells by how much. Both sides are shuffled by their
    position only.
    """
    sides = []
    for path, field, name in ((predictions, prediction, "prediction"), (references, reference, "reference")):
        rows = json_rows(with_position(text_rows(spark, path)), f"`{field}` string")
        sides.append(rows.select("position", F.col(field).alias(name)))
    return sides[0].join(sides[1], "position")


def pairing_counts(spark: SparkSession, predictions: str | list[str], references: str | list[str]) -> DataFrame:
    """One row: ``n_predictions`` (the denominator of mean scores), ``n_references``, ``n_pairs``."""
    sides = [
        spark.read.text(path).filter(F.col("value").rlike(r"\S")).select(F.lit(side).alias("side"))
        for side, path in enumerate((predictions, references))
    ]
    counts = sides[0].union(sides[1]).agg(
        F.count_if(F.col("side") == 0).alias("n_predictions"), F.count_if(F.col("side") == 1).alias("n_references")
    )
    return counts.withColumn("n_pairs", F.least("n_predictions", "n_references"))


def occurrence_keys(rows: DataFrame, content: str | Column = "value", name: str = "row_key") -> DataFrame:
    """Adds a key to rows of ``text_rows``: a digest of the content and how often it stood before.

    Equal rows get the numbers 1, 2, ... in the order of the files. They are counted per input split
    first, a few rows per split are summed up per content, and only the rows of one split are
    numbered together, so a line that fills a third of the input is numbered by all its splits.
    """
    content = F.col(content) if isinstance(content, str) else content
    rows = rows.withColumn("_digest", F.md5(content.cast("binary")))
    rows = rows.withColumn("_digest", F.coalesce("_digest", F.lit("")))
    splits = rows.groupBy("_digest", *SPLIT).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("_digest").orderBy(*SPLIT).rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    among = F.row_number().over(Window.partitionBy("_digest", *SPLIT).orderBy("_at"))
    return (
        rows.withColumn("_among", among)
        .join(splits, ["_digest", *SPLIT])
        .withColumn(name, F.concat_ws(":", "_digest", F.col("_before") + F.col("_among")))
        .drop("_digest", "_before", "_among")
    )


def with_problems(rows: DataFrame, schema: StructType) -> DataFrame:
    """Adds ``reason``: why a JSON line of ``text_rows`` does not fit the schema, null if it does.

    ``malformed``: no JSON value, or something after it. ``not an object``: another kind of value.
    ``missing: a, b``: fields that may not be null are absent. ``type: a, b``: values that are no such type.
    Lines are parsed once, as variants, each as the only element of an array, so that nothing may follow.
    """
    array = F.try_parse_json(F.concat(F.lit("["), "value", F.lit("]"))).try_cast("array<variant>")
    parsed = rows.withColumn("_a", F.explode(F.array(array)))
    parsed = parsed.withColumn("_v", F.when(F.size("_a") == 1, F.get("_a", F.lit(0))))
    kinds = F.schema_of_variant("_v")
    raw = {f.name: F.try_variant_get("_v", f"$['{f.name}']", "variant") for f in schema}
    none = {n: v.isNull() | F.is_variant_null(v) for n, v in raw.items()}
    typed = {f.name: F.try_variant_get("_v", f"$['{f.name}']", f.dataType.simpleString()) for f in schema}
    kinds_of = {n: F.schema_of_variant(v) for n, v in raw.items()}
    expected = {"string": ["STRING"], "boolean": ["BOOLEAN"]}
    wrong = {}
    for f in schema:
        kind, wanted = kinds_of[f.name], expected.get(f.dataType.simpleString())
        fits = kind.isin(wanted) if wanted else ~kind.isin("STRING", "BOOLEAN")
        wrong[f.name] = ~none[f.name] & (typed[f.name].isNull() | ~fits)
    listed = lambda flags: F.concat_ws(", ", *(F.when(c, F.lit(n)) for n, c in flags.items()))
    absent = listed({f.name: none[f.name] for f in schema if not f.nullable})
    mistyped = listed(wrong)
    reason = (
        F.when(F.col("_v").isNull(), "malformed")
        .when(~kinds.startswith("OBJECT"), "not an object")
        .when(absent != "", F.concat(F.lit("missing: "), absent))
        .when(mistyped != "", F.concat(F.lit("type: "), mistyped))
    )
    return parsed.withColumn("reason", reason).select(*rows.columns, "reason", *(v.alias(n) for n, v in typed.items()))


def read_with_bad_rows(
    spark: SparkSession, path: str | list[str], schema: StructType
) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows) of JSON lines, split in one pass.

    Good rows have the fields of the schema and their ``position``; bad ones the ``file``, the ``position``
    among the lines that are not blank, the line and a ``reason``, so they can be counted and found.
    """
    checked = with_problems(with_position(text_rows(spark, path)), schema)
    stored = written(checked, "checked-rows")
    good = stored.filter("reason is null").select("position", *schema.names)
    bad = stored.filter("reason is not null")
    return good, bad.select(F.col("_file").alias("file"), "position", F.col("value").alias("line"), "reason")
