"""Input views of the registered queries, derived from the given tables over whole rows and texts.

The given tables hold prose, so instruction rows, predictions, code answers, logs and requests are
derived columns; ``plans/oracle.py`` states the same derivations in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tunetable.operators.frames import encode_frames
from tunetable.operators.prep import turn_pairs
from tunetable.sources.readers import read_table


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return read_table(spark, sf, name)


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    return turn_pairs(table(spark, sf, "conversations"))


def instruction_docs(spark: SparkSession, sf: str) -> DataFrame:
    """First line as instruction, the other lines as output, input null, empty or the language."""
    first = F.substring_index("text", "\n", 1)
    return table(spark, sf, "documents").select(
        "doc_id",
        first.alias("instruction"),
        F.when(F.col("doc_id") % 3 == 1, "")
        .when(F.col("doc_id") % 3 == 2, F.col("lang"))
        .alias("input"),
        F.substr("text", F.length(first) + 2).alias("output"),
    )


def alpaca(spark: SparkSession, sf: str) -> DataFrame:
    """Rendered pairs: one residue of seven has no marker, one has two."""
    rendered = F.concat(
        F.lit("### Instruction:\n"), "instruction", F.lit("\n\n### Response:\n"), "output"
    )
    kind = (F.col("conv_id") + F.col("turn")) % 7
    return pairs(spark, sf).select(
        "sample_id",
        F.when(kind == 0, F.concat("instruction", "output"))
        .when(kind == 1, F.concat(rendered, F.lit("### Response:\nextra")))
        .otherwise(rendered)
        .alias("text"),
    )


REWORDED = ((" the ", " a "), (" la ", " le "), (" und ", " oder "), (" el ", " un "))


def reworded(c: Column) -> Column:
    for old, new in REWORDED:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Two "models" per pair: the repeated question, and the answer with other small words.

    Both are made of one row each, so the table is read and joined once.
    """
    models = F.array(
        F.struct(F.lit("base").alias("model"), F.col("instruction").alias("prediction")),
        F.struct(F.lit("finetuned").alias("model"), reworded(F.col("output")).alias("prediction")),
    )
    return pairs(spark, sf).select(
        "sample_id", F.col("output").alias("reference"), F.inline(models)
    )


def code_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Answers in seven shapes around the whole text as Python comment lines."""
    comment = F.concat(F.lit("# "), F.replace(F.col("text"), F.lit("\n"), F.lit("\n# ")))
    size = F.col("n_chars").cast("string")

    def glue(*parts: str | Column) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    kind = F.col("doc_id") % 7
    answer = (
        F.when(
            kind == 0,
            glue("Sure:\n```python\n", comment, "\nx = ", size, "\n```\nDone.\n```py\ny = 1\n```"),
        )
        .when(kind == 1, glue("```\n", comment, "\ndef f(a):\n    return a + ", size, "\n```"))
        .when(kind == 2, glue(comment, "\nx = (", size))
        .when(kind == 3, F.lit(""))
        .when(kind == 4, glue("see ```python\n", comment, "\nz = ", size, "``` end"))
        .when(kind == 5, glue(comment, "\ndef f(:\n    return ", size))
        .otherwise(glue(comment, "\nvalue = ", size))
    )
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("sample_id"),
        F.when(F.col("doc_id") % 2 == 0, "base").otherwise("finetuned").alias("model"),
        answer.alias("text"),
    )


def loss_log_of(events: DataFrame) -> DataFrame:
    """All-string log rows with bad and very large steps, empty and malformed losses, empty epochs."""
    n = F.col("event_id")
    epoch = F.concat(
        F.floor(n / 2000).cast("string"),
        F.lit("."),
        F.lpad(((n % 2000) * 5).cast("string"), 4, "0"),
    )
    return events.select(
        F.col("event_type").alias("run_id"),
        F.when(n % 97 == 0, "bad")
        .when(n % 89 == 0, (n + 3_000_000_000).cast("string"))
        .otherwise(n.cast("string"))
        .alias("step"),
        F.when(n % 11 == 0, "")
        .when(n % 101 == 0, "n/a")
        .when(n % 103 == 0, "1.5d")
        .otherwise(F.col("value").cast("string"))
        .alias("loss"),
        F.when(n % 13 == 0, "").otherwise(epoch).alias("epoch"),
    )


def loss_log(spark: SparkSession, sf: str) -> DataFrame:
    return loss_log_of(table(spark, sf, "events"))


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """Generation requests with empty prompts, missing fields and values out of range."""
    n = F.col("event_id")
    return table(spark, sf, "events").select(
        "event_id",
        "user_id",
        F.col("event_type").alias("route"),
        "ts",
        F.when(n % 17 == 0, "").otherwise(F.concat_ws(" ", "event_type", "props")).alias("prompt"),
        F.when(n % 5 != 0, (n % 2500).cast("int")).alias("max_tokens"),
        F.when(n % 4 != 0, F.col("value") / 20.0).alias("temperature"),
    )


def token_nll(spark: SparkSession, sf: str) -> DataFrame:
    """Token losses: one text per user, two "models" by event type."""
    return table(spark, sf, "events").select(
        F.when(F.col("event_type").isin("click", "view"), "base")
        .otherwise("finetuned")
        .alias("model"),
        F.col("user_id").alias("text_id"),
        (F.col("value") / 20.0).alias("nll"),
    )


STREAM = ("conv_id", "turn")


# Lines that a reader of frames has to skip: malformed, falsy or of another kind.
NOISE = (
    'data: {"token": "a"}, "x": 1',
    'data: {"token": "c"},"f":{"done":true}',
    'data: {"token": 0}',
    'data: {"token": false}',
    'data: {"token": ""}',
    'data: {"token": NaN}',
    'data: {"done": 0.0}',
    'data: {"done": ""}',
    "data: {'token': 'b'}",
    "data: ",
    "event: ping",
    '{"token": "d"}',
)


def noisy_frame_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The frame lines with noise before the first one and a token after the last one."""
    streams = table(spark, sf, "conversations").select(*STREAM)
    noise = F.explode(F.array(*[F.lit(line) for line in NOISE])).alias("line")
    early = streams.select(*STREAM, F.lit(-1).cast("long").alias("seq"), noise)
    late = streams.select(
        *STREAM, F.lit(1 << 40).alias("seq"), F.lit('data: {"token": "late"}').alias("line")
    )
    return frame_lines(spark, sf).unionByName(early).unionByName(late)


def frame_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Frame lines of all messages."""
    return encode_frames(table(spark, sf, "conversations").select(*STREAM, "text"), STREAM)
