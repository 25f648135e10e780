"""The registered queries: name -> (spark, folder of the tables) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce, wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tunetable.functions import prompts, quality
from tunetable.functions.formats import exponent, fixed
from tunetable.functions.quality import QualityRules
from tunetable.functions.text import alnum_tokens, extract_code, or_empty, strip, word_count
from tunetable.operators import (
    admission,
    alignment,
    bleu,
    bootstrap,
    frames,
    fused,
    lengths,
    perplexity,
    positions,
    prep,
    report,
    rouge,
    sampling,
    syntax,
    telemetry,
    usage,
)
from tunetable.plans import inputs
from tunetable.plans.inputs import STREAM, table
from tunetable.session import scratch_path, ship_package
from tunetable.sources import inline, readers, writers
from tunetable.sources.schemas import INSTRUCTIONS
from tunetable.streaming import limits as live_limits
from tunetable.streaming import loss as live_loss
from tunetable.streaming import ordered, snapshots
from tunetable.streaming import tokens as live_tokens
from tunetable.streaming.runs import append_to_files, each_batch, file_stream, overwrite_batch, slices

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# The pairs are prose, so the markers are common words; the budget is 256 tokens.
PROSE_RULES = QualityRules(markers=(" the ", " la ", " und "), max_chars=1024)
DAY = "1 day"


def query(f: Query) -> Query:
    @wraps(f)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        ship_package(spark)
        return f(spark, sf)

    QUERIES[f.__name__] = run
    return run


# --- preparation ---------------------------------------------------------------------------------


@query
def q_prep_pipeline(spark, sf):
    prepared = prep.prepare(inputs.pairs(spark, sf), "sample_id", rules=PROSE_RULES)
    return prep.split_report(prepared)


@query
def q_prep_rows(spark, sf):
    return prep.prepare(
        inputs.pairs(spark, sf), "sample_id", rules=PROSE_RULES, exact_split=False
    )


@query
def q_prep_sampled(spark, sf):
    """The sample is drawn before the rows are formatted and filtered."""
    return prep.prepare(
        inputs.pairs(spark, sf), "sample_id", max_samples=150, rules=PROSE_RULES
    ).select("sample_id", "split")


@query
def q_prep_stages(spark, sf):
    """Rows after each stage of the same run."""
    return prep.prepare_stages(
        inputs.pairs(spark, sf), "sample_id", max_samples=150, rules=PROSE_RULES
    )


@query
def q_prep_custom(spark, sf):
    """User-supplied renderer and predicate."""

    def renderer():
        return {
            "instruction": strip(or_empty("instruction")),
            "output": strip(or_empty("output")),
            "text": prompts.render_alpaca("instruction", "output"),
        }

    return prep.prepare(
        inputs.pairs(spark, sf),
        "sample_id",
        predicate=word_count("output") >= 100,
        renderer=renderer,
        exact_split=False,
    )


@query
def q_user_content(spark, sf):
    content = prompts.user_content("instruction", "input")
    return inputs.pairs(spark, sf).select("sample_id", content.alias("content"))


@query
def q_messages_render(spark, sf):
    user = prompts.user_content("instruction", "input")
    training = prompts.turns(user, F.col("output"))
    plain = prompts.turns(F.col("instruction"), system=None)
    roles = F.transform(prompts.messages(training), lambda m: m["role"])
    return inputs.pairs(spark, sf).select(
        "sample_id",
        F.array_join(roles, ",").alias("roles"),
        prompts.render_exchange(training).alias("text"),
        prompts.render_exchange(prompts.turns(user)).alias("generation_prompt"),
        prompts.render_exchange(plain).alias("plain_prompt"),
    )


@query
def q_conversation_render(spark, sf):
    return prep.render_conversations(table(spark, sf, "conversations"))


@query
def q_alpaca_render(spark, sf):
    return inputs.pairs(spark, sf).select(
        "sample_id",
        prompts.render_alpaca("instruction").alias("prompt"),
        prompts.render_alpaca("instruction", "output").alias("text"),
    )


@query
def q_alpaca_parse(spark, sf):
    parsed = prompts.parse_alpaca("text")
    return inputs.alpaca(spark, sf).select(
        "sample_id", *[c.alias(name) for name, c in parsed.items()]
    )


@query
def q_strip_defaults(spark, sf):
    padded = F.concat(F.lit("\t "), "text", F.lit("\xa0\u3000 \n"))
    given = F.when(F.col("doc_id") % 7 != 0, padded)
    return table(spark, sf, "documents").select(
        "doc_id",
        strip(or_empty(given)).alias("instruction"),
        or_empty(F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit(" "), "lang"))).alias("input"),
    )


@query
def q_preview(spark, sf):
    return prep.preview(table(spark, sf, "documents"), "doc_id")


def _formatted_docs(spark, sf):
    return prep.format_rows(inputs.instruction_docs(spark, sf), ("doc_id",))


@query
def q_quality_filter(spark, sf):
    return prep.quality_filter(_formatted_docs(spark, sf))


@query
def q_reject_reasons(spark, sf):
    marked = prep.with_reject_reasons(_formatted_docs(spark, sf))
    return marked.select(
        "doc_id",
        F.array_join("reject_reasons", ",").alias("reject_reasons"),
        (F.size("reject_reasons") == 0).alias("accepted"),
    )


@query
def q_funnel(spark, sf):
    digest = sampling.hash_order("doc_id")
    sampled = sampling.hash_prefix(digest) < 1 << 15
    flagged = sampling.split_stable(_formatted_docs(spark, sf), "doc_id")
    return prep.funnel(flagged, sampled, quality.passes(PROSE_RULES), F.col("split"))


# --- sampling ------------------------------------------------------------------------------------


@query
def q_sample_exact(spark, sf):
    docs = table(spark, sf, "documents")
    return sampling.sample_exact(docs, 500, "doc_id").select("doc_id", "lang", "n_chars")


@query
def q_sample_cutoff(spark, sf):
    """A smaller sample, from stored keys."""
    docs = table(spark, sf, "documents")
    sampled = sampling.sample_exact(docs, 150, "doc_id", write_keys=True)
    return sampled.select("doc_id", "lang", "n_chars")


@query
def q_split_exact(spark, sf):
    return sampling.split_exact(table(spark, sf, "documents"), "doc_id").select("doc_id", "split")


@query
def q_split_stable(spark, sf):
    return sampling.split_stable(table(spark, sf, "documents"), "doc_id").select("doc_id", "split")


@query
def q_head(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    return sampling.head(events, 50, "event_id")


@query
def q_tail(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    return sampling.tail(events, 10, "event_id")


@query
def q_batches(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.length("text").alias("chars"))
    return sampling.batch_stats(sampling.assign_batches(docs, "doc_id", batch_size=4))


@query
def q_truncate_stats(spark, sf):
    return lengths.truncation_stats(table(spark, sf, "documents"), "text", by=("lang",))


@query
def q_truncate(spark, sf):
    """The texts as the evaluation sees them: at most 512 words."""
    cut = lengths.truncate_texts(
        table(spark, sf, "documents"), "text", lengths.EVAL_MAX_TOKENS
    )
    return cut.select("doc_id", F.array_join("tokens", " ").alias("text"), "truncated")


@query
def q_word_count(spark, sf):
    return table(spark, sf, "documents").select("doc_id", word_count("text").alias("n_words"))


# --- alignment and metrics -----------------------------------------------------------------------


def _plain_rouge(spark, sf, order):
    return rouge.rouge_n(inputs.predictions(spark, sf), orders=(order,))


def _asked_and_answers(spark, sf):
    turns = table(spark, sf, "conversations")
    asked = turns.filter("role = 'user'").select(
        "conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("prediction")
    )
    answers = turns.filter("role = 'assistant'").select(
        "conv_id", "turn", F.col("text").alias("reference")
    )
    return asked, answers


@query
def q_align(spark, sf):
    """Every user turn against the assistant turn after it; the last user turns have none."""
    return alignment.align(*_asked_and_answers(spark, sf), ["conv_id", "turn"])


@query
def q_align_unmatched(spark, sf):
    """Assistant turns that follow no question of an even conversation."""
    asked, answers = _asked_and_answers(spark, sf)
    asked = asked.filter(F.col("conv_id") % 2 == 0)
    return alignment.unmatched_references(asked, answers, ["conv_id", "turn"])


@query
def q_align_counts(spark, sf):
    return alignment.alignment_counts(q_align(spark, sf))


@query
def q_rouge1(spark, sf):
    return _plain_rouge(spark, sf, 1)


@query
def q_rouge2(spark, sf):
    return _plain_rouge(spark, sf, 2)


@query
def q_rouge_mean(spark, sf):
    return rouge.mean_scores(rouge.rouge_n(inputs.predictions(spark, sf)), ("rouge1", "rouge2"))


@query
def q_rouge_l(spark, sf):
    return rouge.rouge_l(inputs.predictions(spark, sf))


@query
def q_rouge_stemmed(spark, sf):
    return rouge.rouge_n(inputs.predictions(spark, sf), use_stemmer=True)


@query
def q_rouge_l_stemmed(spark, sf):
    return rouge.rouge_l(inputs.predictions(spark, sf), use_stemmer=True)


@query
def q_rouge_bootstrap(spark, sf):
    scores = rouge.rouge_n(inputs.predictions(spark, sf))
    out = bootstrap.bootstrap(scores, ("rouge1", "rouge2"), "sample_id")
    return out.select("model", "metric", *[F.round(c, 6).alias(c) for c in ("low", "mid", "high")])


@query
def q_bleu(spark, sf):
    scored = bleu.corpus_bleu(bleu.bleu_counts(inputs.predictions(spark, sf)))
    return scored.withColumn("bleu", F.round("bleu", 6))


@query
def q_mean_length(spark, sf):
    out = lengths.mean_length(inputs.predictions(spark, sf))
    return out.withColumn("avg_response_length", F.round("avg_response_length", 6))


def _perplexities(spark, sf):
    return perplexity.perplexity(inputs.token_nll(spark, sf), "text_id", ("model",))


@query
def q_perplexity(spark, sf):
    return _perplexities(spark, sf).withColumn("perplexity", F.round("perplexity", 6))


@query
def q_perplexity_first(spark, sf):
    """Only the first twenty texts, as the original evaluation does."""
    nll = perplexity.first_texts(inputs.token_nll(spark, sf), "text_id", 20)
    out = perplexity.perplexity(nll, "text_id")
    return out.withColumn("perplexity", F.round("perplexity", 2))


@query
def q_unigram_perplexity(spark, sf):
    docs = sampling.split_stable(table(spark, sf, "documents"), "doc_id")
    out = perplexity.unigram_perplexity(docs)
    return out.withColumn("perplexity", F.round("perplexity", 4))


def _report(spark, sf):
    measured = _perplexities(spark, sf).select(
        "model", F.lit("perplexity").alias("metric"), F.round("perplexity", 2).alias("value")
    )
    return report.evaluate(
        inputs.predictions(spark, sf),
        ("text_unstemmed",),
        extra=measured,
    )


@query
def q_eval_report(spark, sf):
    return _report(spark, sf)


@query
def q_eval_report_stemmed(spark, sf):
    return report.evaluate(inputs.predictions(spark, sf))


@query
def q_metrics_document(spark, sf):
    """The report written as one nested document and read back."""
    made = _report(spark, sf)
    doc = report.metrics_document(made, F.max("num_samples"), note="derived predictions")
    path = writers.write_document(doc, scratch_path(spark, "metrics"))
    records = readers.metric_records(
        readers.read_metrics_document(spark, [path + "-missing", path])
    )
    return report.first_record(records, "position")


@query
def q_metric_long(spark, sf):
    return report.metric_long(_report(spark, sf))


@query
def q_metric_compare(spark, sf):
    return report.metric_compare(_report(spark, sf))


@query
def q_side_by_side(spark, sf):
    return alignment.side_by_side(
        inputs.predictions(spark, sf), "sample_id", ("base", "finetuned")
    )


# --- telemetry -----------------------------------------------------------------------------------


def _typed_log(spark, sf):
    return telemetry.typed_log(inputs.loss_log(spark, sf))


@query
def q_loss_typed(spark, sf):
    return _typed_log(spark, sf)


@query
def q_loss_points(spark, sf):
    """The plotted points with their display texts."""
    points = telemetry.log_rows(_typed_log(spark, sf))
    return points.select(
        "run_id",
        "step",
        fixed("loss").alias("loss_text"),
        fixed("epoch", 1).alias("epoch_text"),
        exponent((F.col("step") * 7 + 1) / 7e7).alias("rate_text"),
    )


@query
def q_loss_min(spark, sf):
    return telemetry.loss_minimum(_typed_log(spark, sf))


@query
def q_epoch_boundaries(spark, sf):
    return telemetry.epoch_boundaries(_typed_log(spark, sf))


@query
def q_loss_thin(spark, sf):
    return telemetry.thin(telemetry.with_loss(_typed_log(spark, sf)))


@query
def q_loss_tail(spark, sf):
    return telemetry.last_steps(telemetry.with_loss(_typed_log(spark, sf)))


# --- usage ---------------------------------------------------------------------------------------


@query
def q_request_check(spark, sf):
    checked = usage.check_requests(inputs.requests(spark, sf))
    return checked.select(
        "event_id",
        "max_tokens",
        "temperature",
        F.array_join("violations", ",").alias("violations"),
        "accepted",
    )


def _day(c: str):
    return F.date_format(c, "yyyy-MM-dd").alias("day")


@query
def q_rate_limit(spark, sf):
    kept = usage.admitted(inputs.requests(spark, sf), ("user_id",), window=DAY)
    return kept.select("event_id", "user_id", _day("window_start"), "rank")


@query
def q_rate_limit_routes(spark, sf):
    """Five per minute, client and route; at this traffic nearly all are admitted."""
    counts = usage.window_counts(
        inputs.requests(spark, sf), ("user_id", "route"), usage.limit_of("route")
    )
    names = ("n_requests", "n_admitted", "n_blocked")
    return counts.groupBy("route").agg(*[F.sum(n).alias(n) for n in names])


@query
def q_rate_limit_mixed(spark, sf):
    """Different daily limits per route."""
    limits = usage.limit_of("route", {"click": 1, "view": 2}, other=3)
    kept = usage.admitted(
        inputs.requests(spark, sf), ("user_id", "route"), 3, DAY, route_limit=limits
    )
    return kept.select("event_id", "user_id", "route", _day("window_start"), "rank")


@query
def q_rate_counts(spark, sf):
    counts = usage.window_counts(inputs.requests(spark, sf), ("user_id",), window=DAY)
    return counts.withColumn("day", _day("window_start")).drop("window_start")


@query
def q_admission(spark, sf):
    flagged = usage.with_admission(inputs.requests(spark, sf), ("user_id",), window=DAY)
    return flagged.select("event_id", "user_id", _day("window_start"), "admitted")


@query
def q_recent_prompts(spark, sf):
    recent = usage.recent_prompts(inputs.requests(spark, sf))
    return recent.select("user_id", "prompt", "rank")


# --- code checks ---------------------------------------------------------------------------------


@query
def q_fence_extract(spark, sf):
    return inputs.code_answers(spark, sf).select("sample_id", extract_code("text").alias("code"))


@query
def q_syntax_valid(spark, sf):
    checked = syntax.with_syntax(inputs.code_answers(spark, sf))
    return checked.select("sample_id", "model", "valid", "line")


@query
def q_syntax_panels(spark, sf):
    answers = inputs.code_answers(spark, sf).withColumn("done", F.col("model") == "base")
    return syntax.checked_panels(answers).select("sample_id", "valid", "message")


@query
def q_syntax_rate(spark, sf):
    rate = syntax.validity_rate(syntax.with_syntax(inputs.code_answers(spark, sf)))
    return rate.withColumn("valid_share", F.round("valid_share", 6))


@query
def q_syntax_errors(spark, sf):
    return syntax.frequent_errors(syntax.with_syntax(inputs.code_answers(spark, sf)))


# --- token streams -------------------------------------------------------------------------------


@query
def q_sse_encode(spark, sf):
    return inputs.frame_lines(spark, sf)


@query
def q_sse_decode(spark, sf):
    return frames.decode_frames(inputs.noisy_frame_lines(spark, sf), STREAM)


@query
def q_stream_fold(spark, sf):
    """The second of two starts counts; the first one stopped within the text."""
    lines = inputs.noisy_frame_lines(spark, sf).withColumn("attempt", F.lit(1))
    first = inputs.frame_lines(spark, sf).filter("seq < 3").withColumn("attempt", F.lit(0))
    parsed = frames.parse_lines(lines.unionByName(first))
    return frames.fold_streams(parsed, STREAM, attempt="attempt")


@query
def q_stream_rate(spark, sf):
    """Speed when a message's frames arrive 28 ms apart, starting 300 ms after the request."""
    start = F.timestamp_seconds(F.lit(1_700_000_000))
    millis = 300 + 28 * F.col("seq")
    timed = (
        frames.parse_lines(inputs.frame_lines(spark, sf))
        .withColumn("started", start)
        .withColumn("ts", F.timestamp_millis(F.lit(1_700_000_000_000) + millis))
    )
    return frames.fold_streams(timed, STREAM, "ts", "started").select(
        *STREAM, "token_count", "tokens_per_sec", "done"
    )


@query
def q_streams_open(spark, sf):
    """Messages of a conversation as parallel streams; those of user turns lost their done frame."""
    turns = table(spark, sf, "conversations")
    lines = frames.encode_frames(turns.select(*STREAM, "role", "text"), (*STREAM, "role"))
    cut = lines.filter((F.col("role") != "user") | (F.col("line") != frames.DONE_LINE))
    folded = frames.fold_streams(frames.parse_lines(cut), STREAM)
    return frames.still_running(folded, ("conv_id",))


@query
def q_chunk_lines(spark, sf):
    """Lines of documents whose text arrives as one chunk per word, blanks included."""
    pieces = F.regexp_extract_all("text", F.lit("[^ ]* |[^ ]+$"), F.lit(0))
    chunks = table(spark, sf, "documents").select(
        "doc_id", F.posexplode(pieces).alias("chunk_seq", "data")
    )
    return frames.chunks_to_lines(chunks, ("doc_id",))


# --- streaming -----------------------------------------------------------------------------------


def _stream(spark, sf, name, order):
    """The table as a stream of several micro-batches, so that state is carried between them."""
    rows = table(spark, sf, name)
    folder, files = slices(rows, order, f"{name}-stream")
    return file_stream(spark, folder, rows.schema, max_files=files)


@query
def q_stream_loss(spark, sf):
    return live_loss.append_live_log(
        inputs.loss_log_of(_stream(spark, sf, "events", "event_id"))
    )


@query
def q_stream_loss_min(spark, sf):
    return live_loss.running_minimum(
        inputs.loss_log_of(_stream(spark, sf, "events", "event_id"))
    )


@query
def q_loss_snapshots(spark, sf):
    """The loss log as each of its versions shows it: points, runs and smallest loss."""
    log = live_loss.live_log(inputs.loss_log_of(_stream(spark, sf, "events", "event_id")))
    folder = snapshots.versioned_log(log, "loss-versions", compact_after=2)
    parts = []
    for row in snapshots.versions(spark, folder).orderBy("version").collect():
        seen = snapshots.read_version(spark, folder, row["version"]).agg(
            F.count("*").alias("n_points"),
            F.count_distinct("run_id").alias("n_runs"),
            F.min("loss").alias("min_loss"),
        )
        parts.append(seen.withColumn("version", F.lit(row["version"]).cast("long")))
    return reduce(DataFrame.unionByName, parts)


@query
def q_stream_tokens(spark, sf):
    turns = _stream(spark, sf, "conversations", "conv_id").select(
        F.concat_ws(":", "conv_id", "turn").alias("stream"), "text"
    )
    lines = frames.encode_frames(turns, ("stream",)).withColumn(
        "ts", F.timestamp_millis(F.lit(1_700_000_000_000) + 28 * F.col("seq"))
    )
    folded = live_tokens.fold_stream(lines, "stream", "ts")
    return spark.read.schema(folded.schema).parquet(append_to_files(folded, "streams"))


@query
def q_stream_chunks(spark, sf):
    """Lines of documents that arrive as chunks of 61 bytes, a third of each document per micro-batch."""
    body = F.col("text").cast("binary")
    number = F.sequence(F.lit(0), F.floor(F.octet_length(body) / 61).cast("int"))
    chunks = table(spark, sf, "documents").filter("text is not null").select(
        "doc_id", body.alias("body"), F.size(number).alias("n"), F.explode(number).alias("chunk_seq")
    )
    chunks = chunks.select(
        "doc_id",
        "chunk_seq",
        F.substring("body", 61 * F.col("chunk_seq") + 1, F.lit(61)).alias("data"),
        F.floor(3 * F.col("chunk_seq") / F.col("n")).alias("third"),
    )
    folder, files = slices(chunks, "third", "chunk-stream")
    arriving = file_stream(spark, folder, chunks.schema, max_files=files)
    lines = ordered.byte_chunk_lines(arriving, "doc_id")
    with ordered.keyed_state(spark):
        return spark.read.schema(lines.schema).parquet(append_to_files(lines, "chunk-lines"))


@query
def q_stream_reordered(spark, sf):
    """Message frames that arrive in any order over three micro-batches, with a first start that stopped."""
    whole = inputs.frame_lines(spark, sf).withColumn("attempt", F.lit(1))
    lines = whole.unionByName(whole.filter("seq < 3").withColumn("attempt", F.lit(0))).select(
        F.concat_ws(":", *STREAM).alias("stream"),
        "attempt",
        "seq",
        "line",
        F.timestamp_millis(F.lit(1_700_000_000_000) + 28 * F.col("seq")).alias("ts"),
        F.pmod(F.xxhash64(*STREAM, "attempt", "seq"), F.lit(3)).alias("third"),
    )
    folder, files = slices(lines, "third", "shuffled-frames")
    arriving = file_stream(spark, folder, lines.schema, max_files=files)
    prefixes = ordered.reordered_prefixes(arriving, "stream", "ts", "attempt")
    with ordered.keyed_state(spark):
        stored = append_to_files(prefixes, "prefixes")
    return ordered.whole_streams(spark.read.schema(prefixes.schema).parquet(stored), "stream")


@query
def q_stream_recent(spark, sf):
    """The recent prompts of each user after the last of three micro-batches."""
    rows = inputs.requests(spark, sf)
    folder, files = slices(rows, "event_id", "prompt-stream")
    lists = ordered.live_recent_prompts(file_stream(spark, folder, rows.schema, max_files=files))
    with ordered.keyed_state(spark):
        out = each_batch(lists, "recent-prompts", "update", overwrite_batch)
    stored = spark.read.parquet(out)
    last = stored.groupBy("user_id").agg(F.max("batch").alias("batch"))
    return stored.join(last, ["user_id", "batch"], "left_semi").select("user_id", "prompt", "rank")


def _stream_requests(spark, sf):
    events = _stream(spark, sf, "events", "event_id")
    return events.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))


@query
def q_stream_rate_limit(spark, sf):
    counts = live_limits.live_window_counts(_stream_requests(spark, sf), ("user_id",), window=DAY)
    out = live_limits.collect_window_counts(counts, ("user_id",))
    return out.withColumn("day", _day("window_start")).drop("window_start")


@query
def q_stream_first_hit(spark, sf):
    admitted = live_limits.first_hit_windows(
        _stream_requests(spark, sf), "user_id", seconds=24 * 3600
    )
    out = spark.read.schema(admitted.schema).parquet(append_to_files(admitted, "admission"))
    return out.select("event_id", "user_id", "rank", "admitted")


# --- reports and files ---------------------------------------------------------------------------


@query
def q_human_report(spark, sf):
    problems = inputs.pairs(spark, sf).select(
        "sample_id", F.col("instruction").alias("prompt"), F.col("output").alias("generated_code")
    )
    return report.review_report(problems, "sample_id")


@query
def q_review_file(spark, sf):
    """The review document written and read back line by line."""
    path = writers.write_review(q_human_report(spark, sf), scratch_path(spark, "review"))
    lines = spark.read.text(path).withColumnRenamed("value", "line")
    return lines.groupBy("line").agg(F.count("*").alias("n"))


@query
def q_review_places(spark, sf):
    """Every line of the written review document with its number; the sample problems follow those of the tables."""
    problems = inputs.pairs(spark, sf).select(
        "sample_id", F.col("instruction").alias("prompt"), F.col("output").alias("generated_code")
    )
    samples = inline.review_problems(spark).withColumn("sample_id", F.concat(F.lit("sample:"), "prompt"))
    blocks = report.review_report(problems.unionByName(samples), "sample_id")
    path = writers.write_review(blocks, scratch_path(spark, "review"))
    lines = positions.with_position(positions.text_rows(spark, path, blank=True))
    return lines.select((F.col("position") + 1).alias("line_no"), F.col("value").alias("line"))


@query
def q_jsonl_roundtrip(spark, sf):
    rows = sampling.split_stable(_formatted_docs(spark, sf), "doc_id").drop("doc_id")
    path = writers.write_jsonl(rows, scratch_path(spark, "jsonl"))
    files = {s: f"{path}/split={s}" for s in ("train", "eval")}
    return readers.read_splits(spark, files, INSTRUCTIONS)


@query
def q_union_available(spark, sf):
    """Prediction files of two models out of three expected ones, united."""
    schema = "sample_id long, prediction string, reference string"
    preds = inputs.predictions(spark, sf)
    path = scratch_path(spark, "predictions")
    preds.write.partitionBy("model").json(path)
    expected = {m: f"{path}/model={m}" for m in ("base", "finetuned", "distilled")}
    found, missing = readers.union_available(spark, expected, schema)
    return found.groupBy("model").agg(
        F.count("*").alias("n_rows"),
        F.sum(F.length("prediction")).alias("prediction_chars"),
        F.lit(",".join(missing)).alias("missing"),
    )


@query
def q_split_publish(spark, sf):
    docs = sampling.split_stable(table(spark, sf, "documents"), "doc_id")
    path = writers.publish_splits(docs, scratch_path(spark, "published"))
    published = readers.read_published(spark, path)
    return published.select("doc_id", "lang", "n_chars", "split")


def _lines_of(rows, label):
    """A table of a column ``value`` as text files, in the order of its key."""
    path = scratch_path(rows.sparkSession, label)
    rows.orderBy(*(c for c in rows.columns if c != "value")).select("value").write.text(path)
    return path


@query
def q_eval_fused(spark, sf):
    """Three metrics of both models from one aggregation."""
    scores = fused.evaluate_fused(
        inputs.predictions(spark, sf), ("exact_match", "length_ratio", "length_error")
    )
    return scores.withColumn("value", F.round("value", 6))


@query
def q_align_positional(spark, sf):
    """Predictions and references without keys, paired by line; one prediction of nine is missing."""
    rows = inputs.predictions(spark, sf).filter("model = 'finetuned'")
    short = F.conv(F.substring(F.md5("sample_id"), 1, 8), 16, 10).cast("long") % 9 != 0
    line = lambda name: F.to_json(F.struct(name)).alias("value")
    preds = _lines_of(rows.filter(short).select("sample_id", line("prediction")), "predictions")
    refs = _lines_of(rows.select("sample_id", line("reference")), "references")
    return positions.align_by_position(spark, preds, refs)


@query
def q_occurrence_keys(spark, sf):
    """Lines of all documents as a file without keys: digest and occurrence number of each."""
    lines = table(spark, sf, "documents").select(
        "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line")
    )
    value = F.to_json(F.struct("doc_id", "line_no", "line")).alias("value")
    rows = positions.text_rows(spark, _lines_of(lines.select("doc_id", "line_no", value), "keyless"))
    rows = positions.json_rows(rows, "doc_id long, line_no int, line string")
    return positions.occurrence_keys(rows, "line").select("doc_id", "line_no", "row_key")


@query
def q_bad_rows(spark, sf):
    """Malformed, incomplete and mistyped lines among documents written as JSON lines, with their places."""
    n = F.col("doc_id") % 23
    whole = F.to_json(F.struct("doc_id", "text", "n_chars"))
    value = (
        F.when(n == 1, F.concat(F.lit('{"doc_id": '), F.col("doc_id").cast("string")))
        .when(n == 2, F.concat(whole, F.lit(" {}")))
        .when(n == 3, F.to_json(F.array("text")))
        .when(n == 4, F.to_json(F.struct("doc_id", "n_chars")))
        .when(n == 5, F.to_json(F.struct("doc_id", F.col("n_chars").cast("string").alias("n_chars"), "text")))
        .when(n == 6, F.to_json(F.struct("doc_id", F.col("n_chars").alias("text"), F.lit(True).alias("n_chars"))))
        .otherwise(whole)
    )
    path = _lines_of(table(spark, sf, "documents").select("doc_id", value.alias("value")), "mixed")
    schema = StructType(
        [
            StructField("doc_id", LongType(), False),
            StructField("text", StringType(), False),
            StructField("n_chars", LongType()),
        ]
    )
    good, bad = positions.read_with_bad_rows(spark, path, schema)
    kept = good.select("position", F.lit("").alias("reason"), "doc_id")
    return kept.unionByName(bad.select("position", "reason", F.lit(None).cast("long").alias("doc_id")))


@query
def q_number_equal_keys(spark, sf):
    """Dense numbers where one key has a third of all rows: equal keys in the order of a digest."""
    first = F.conv(F.substring(F.md5(F.col("text").cast("binary")), 1, 15), 16, 10).cast("long")
    rows = table(spark, sf, "documents").select(
        F.when(F.col("doc_id") % 3 == 0, "every third").otherwise(F.col("source")).alias("key"),
        F.coalesce(first, F.lit(-1)).alias("digest"),
    )
    return sampling.row_index_ordered(rows, "key", "number", F.col("digest"))


@query
def q_first_hit_batch(spark, sf):
    """First-hit windows of a day over the whole log, a client's log cut into spans of two days."""
    events = table(spark, sf, "events").select("event_id", "user_id", "ts")
    return admission.first_hit_admission(events, "user_id", seconds=24 * 3600, span=2).select(
        "event_id", "user_id", "rank", "admitted"
    )


@query
def q_csv_append(spark, sf):
    """The loss log appended twice and read back."""
    log = inputs.loss_log(spark, sf)
    path = scratch_path(spark, "log")
    for _ in range(2):
        writers.append_log(log, path)
    return readers.read_loss_log(spark, [path])


@query
def q_inline_rows(spark, sf):
    """How often the words of each example prompt occur in the documents."""
    prompt_words = F.broadcast(  # the words of five constant rows
        inline.example_prompts(spark).select(
            "label", F.explode(F.array_distinct(alnum_tokens("prompt"))).alias("word")
        )
    )
    return (
        table(spark, sf, "documents")
        .select(F.explode(alnum_tokens("text")).alias("word"))
        .join(prompt_words, "word")
        .groupBy("label", "word")
        .agg(F.count("*").alias("n"))
        .groupBy("label")
        .agg(F.count("*").alias("n_words_found"), F.sum("n").alias("n_occurrences"))
    )
