"""Schemas of the file formats."""

from pyspark.sql import types as T

INSTRUCTIONS = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("instruction", "input", "output", "text")]
)

LOSS_LOG_TEXT = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("step", "loss", "learning_rate", "epoch")]
)

METRIC_RECORD = T.StructType(
    [T.StructField("model", T.StringType())]
    + [
        T.StructField(c, T.DoubleType())
        for c in ("rouge1", "rouge2", "rougeL", "bleu", "perplexity", "avg_response_length")
    ]
    + [T.StructField("num_samples", T.LongType())]
)

METRICS_DOCUMENT = T.StructType(
    [
        T.StructField("results", T.ArrayType(METRIC_RECORD)),
        T.StructField("eval_samples", T.LongType()),
        T.StructField("note", T.StringType()),
    ]
)

PROBLEMS = T.StructType(
    [T.StructField("prompt", T.StringType()), T.StructField("generated_code", T.StringType())]
)
