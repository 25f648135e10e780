"""The registered queries as ANSI SQL for DuckDB, over the same whole tables."""

from __future__ import annotations

from tunetable.functions.prompts import SYSTEM_PROMPT
from tunetable.functions.text import WHITESPACE
from tunetable.operators.bootstrap import PER_DIGEST, REPLICATES, poisson_thresholds
from tunetable.operators.report import REVIEW_HEADER, REVIEW_RUBRIC
from tunetable.plans.inputs import REWORDED
from tunetable.plans.stems import STEMMED_TOKENS
from tunetable.sources.inline import EXAMPLE_PROMPTS, REVIEW_PROMPTS, SAMPLE_ANSWERS


def text(s: str) -> str:
    """A SQL string literal; line breaks stay as they are."""
    return "'" + s.replace("'", "''") + "'"


def strip(c: str) -> str:
    return f"trim({c}, {text(WHITESPACE)})"


def hash_of(key: str) -> str:
    return f"md5(concat('42:', {key}))"


NL = "chr(10)"
WORD = r"'[^\s\x0b\x1c-\x1f\x{85}\p{Z}]+'"


def n_words(c: str) -> str:
    return f"len(regexp_extract_all({c}, {WORD}))"


def ordered_split(key: str) -> str:
    """Rows of ``t`` with the exact split: the first ceil(5 %) in hash order are eval."""
    return f"""case when row_number() over (order by {hash_of(key)}, {key})
        <= ceil(cast(0.05 as double) * count(*) over ()) then 'eval' else 'train' end"""


def stable_split(key: str) -> str:
    return f"case when {hash_of(key)} < '0ccccccc' then 'eval' else 'train' end"


# --- input views ---------------------------------------------------------------------------------

PAIRS = """pairs as (
  select concat(conv_id, ':', turn) as sample_id, conv_id, turn, text as instruction,
         coalesce(sys, '') as input, nxt as output
  from (select conv_id, turn, role, text,
               lead(role) over (partition by conv_id order by turn) as nr,
               lead(text) over (partition by conv_id order by turn) as nxt,
               max(case when role = 'system' then text end) over (partition by conv_id) as sys
        from conversations) t
  where role = 'user' and nr = 'assistant')"""

SYSTEM_PART = text(f"<s>[INST] {SYSTEM_PROMPT}\n\n")
INPUT_PART = text("\n\nInput:\n")


def content(instruction: str, given: str) -> str:
    return f"concat({instruction}, case when {given} <> '' then concat({INPUT_PART}, {given}) else '' end)"


def formatted(view: str, key: str) -> str:
    """Formatted rows of a view as CTE ``formatted``."""
    return f"""fields as (
  select {key}, {strip("coalesce(instruction, '')")} as instruction,
         coalesce(input, '') as input, {strip("coalesce(output, '')")} as output from {view}),
formatted as (
  select *, concat({SYSTEM_PART}, {content("instruction", "input")}, '[/INST] ', output, '</s>') as text
  from fields)"""


INSTRUCTION_DOCS = f"""instruction_docs as (
  select doc_id, split_part(text, {NL}, 1) as instruction,
         case when doc_id % 3 = 1 then '' when doc_id % 3 = 2 then lang end as input,
         substr(text, length(split_part(text, {NL}, 1)) + 2) as output
  from documents)"""

PROSE_MARKERS = "(contains(output, ' the ') or contains(output, ' la ') or contains(output, ' und '))"
PROSE_PASSES = f"""(length(instruction) >= 10 and length(output) >= 30 and length(text) < 1024
  and {PROSE_MARKERS})"""
CODE_MARKERS = """(contains(output, 'def ') or contains(output, 'class ')
  or contains(output, 'import ') or contains(output, '='))"""

ALPACA_TEXT = (
    f"concat({text('### Instruction:' + chr(10))}, instruction, "
    f"{text(chr(10) * 2 + '### Response:' + chr(10))}, output)"
)

ALPACA = f"""alpaca as (
  select sample_id, case when (conv_id + turn) % 7 = 0 then concat(instruction, output)
    when (conv_id + turn) % 7 = 1 then concat({ALPACA_TEXT}, {text("### Response:" + chr(10) + "extra")})
    else {ALPACA_TEXT} end as text
  from pairs)"""


def _reworded(c: str) -> str:
    for old, new in REWORDED:
        c = f"replace({c}, '{old}', '{new}')"
    return c


PREDICTIONS = f"""{PAIRS}, predictions as (
  select sample_id, 'base' as model, instruction as prediction, output as reference from pairs
  union all
  select sample_id, 'finetuned', {_reworded("output")}, output from pairs)"""

COMMENT = f"concat('# ', replace(text, {NL}, concat({NL}, '# ')))"
CODE_ANSWERS = f"""code_answers as (
  select doc_id as sample_id, case when doc_id % 2 = 0 then 'base' else 'finetuned' end as model,
    case doc_id % 7
      when 0 then concat({text("Sure:" + chr(10) + "```python" + chr(10))}, {COMMENT},
        {text(chr(10) + "x = ")}, n_chars,
        {text(chr(10) + "```" + chr(10) + "Done." + chr(10) + "```py" + chr(10) + "y = 1" + chr(10) + "```")})
      when 1 then concat({text("```" + chr(10))}, {COMMENT},
        {text(chr(10) + "def f(a):" + chr(10) + "    return a + ")}, n_chars, {text(chr(10) + "```")})
      when 2 then concat({COMMENT}, {text(chr(10) + "x = (")}, n_chars)
      when 3 then ''
      when 4 then concat({text("see ```python" + chr(10))}, {COMMENT},
        {text(chr(10) + "z = ")}, n_chars, '``` end')
      when 5 then concat({COMMENT}, {text(chr(10) + "def f(:" + chr(10) + "    return ")}, n_chars)
      else concat({COMMENT}, {text(chr(10) + "value = ")}, n_chars) end as text,
    doc_id % 7 as kind,
    length(text) - length(replace(text, {NL}, '')) + 2 as code_line
  from documents)"""

# What the Python parser says about each shape, by construction.
SYNTAX = f"""{CODE_ANSWERS}, checked as (
  select sample_id, model, text, kind not in (2, 3, 5) as valid,
    case when kind in (2, 5) then code_line end as line,
    case kind when 2 then '''('' was never closed' when 3 then 'Empty code provided'
      when 5 then 'invalid syntax' end as error
  from code_answers)"""

TYPED_LOG = """log as (
  select event_type as run_id,
    case when event_id % 97 = 0 then 'bad' when event_id % 89 = 0
      then cast(event_id + 3000000000 as varchar) else cast(event_id as varchar) end as step,
    case when event_id % 11 = 0 then '' when event_id % 101 = 0 then 'n/a'
      when event_id % 103 = 0 then '1.5d'
      else cast(value as varchar) end as loss,
    case when event_id % 13 = 0 then ''
      else concat(event_id // 2000, '.', lpad(cast((event_id % 2000) * 5 as varchar), 4, '0')) end
      as epoch
  from events),
typed as (
  select run_id, try_cast(step as bigint) as step, try_cast(nullif(loss, '') as double) as loss,
         try_cast(nullif(epoch, '') as double) as epoch
  from log
  where try_cast(step as bigint) is not null
    and (loss = '' or try_cast(loss as double) is not null)
    and (epoch = '' or try_cast(epoch as double) is not null))"""

REQUESTS = """requests as (
  select event_id, user_id, event_type as route, ts,
    case when event_id % 17 = 0 then '' else concat(event_type, ' ', props) end as prompt,
    case when event_id % 5 <> 0 then cast(event_id % 2500 as int) end as max_tokens,
    case when event_id % 4 <> 0 then value / 20.0 end as temperature
  from events)"""

TOKEN_NLL = """token_nll as (
  select case when event_type in ('click', 'view') then 'base' else 'finetuned' end as model,
         user_id as text_id, value / 20.0 as nll from events)"""

WORDS_OF_TURNS = """words as (
  select conv_id, turn, role, string_split(text, ' ') as w from conversations),
placed as (
  select conv_id, turn, role, w, unnest(range(len(w))) as seq from words),
tokens as (
  select conv_id, turn, role, seq,
         concat(w[seq + 1], case when seq < len(w) - 1 then ' ' else '' end) as token
  from placed)"""

# --- metrics -------------------------------------------------------------------------------------

ALNUM_TOKENS = """toks as (
  select model, sample_id, regexp_extract_all(lower(prediction), '[a-z0-9]+') as p,
         regexp_extract_all(lower(reference), '[a-z0-9]+') as r from predictions)"""


def ngrams(c: str, n: int) -> str:
    if n == 1:
        return c
    return f"list_transform(range(1, len({c}) - {n} + 2), lambda i: array_to_string({c}[i:i + {n - 1}], ' '))"


def gram_match(n: int) -> str:
    """CTE ``match<n>``: clipped matches and gram counts per pair, from ``toks``."""
    return f"""grams{n} as (
  select model, sample_id, g, sum(p) as p, sum(r) as r from (
    select model, sample_id, unnest({ngrams("p", n)}) as g, 1 as p, 0 as r from toks
    union all
    select model, sample_id, unnest({ngrams("r", n)}) as g, 0 as p, 1 as r from toks) u
  group by model, sample_id, g),
match{n} as (
  select toks.model, toks.sample_id, coalesce(sum(least(grams{n}.p, grams{n}.r)), 0) as m,
         coalesce(sum(grams{n}.p), 0) as np, coalesce(sum(grams{n}.r), 0) as nr
  from toks left join grams{n} using (model, sample_id)
  group by toks.model, toks.sample_id)"""


def f_measure(m: str, n_pred: str, n_ref: str) -> str:
    p = f"(cast({m} as double) / greatest({n_pred}, 1))"
    r = f"(cast({m} as double) / greatest({n_ref}, 1))"
    return f"case when {m} > 0 then 2 * {p} * {r} / ({p} + {r}) else 0.0 end"


def rouge_n(n: int) -> str:
    return f"""{gram_match(n)},
rouge{n} as (
  select model, sample_id, {f_measure("m", "np", "nr")} as rouge{n} from match{n})"""


# Row by row over the prediction: ends[k + 1] is the first reference position at which a common
# subsequence of length k can end; its finite entries count the longest one.
NEVER = 1000000000
ROUGE_L = f"""matches as (
  select model, sample_id, len(p) as np, len(r) as nr,
    list_transform(p, lambda w: list_filter(range(1, len(r) + 1), lambda j: r[j] = w)) as hits,
    list_prepend(0, list_transform(range(least(len(p), len(r))), lambda x: {NEVER})) as ends
  from toks),
lcs as (
  select model, sample_id, np, nr,
    len(list_filter(list_reduce(hits, lambda e, h: case when len(h) = 0 then e else
      list_transform(range(1, len(e) + 1), lambda k: case when k = 1 then 0 else
        least(e[k], coalesce(list_filter(h, lambda j: j > e[k - 1])[1], {NEVER})) end) end,
      ends), lambda v: v < {NEVER})) - 1 as lcs
  from matches),
rougeL as (
  select model, sample_id, lcs, {f_measure("lcs", "np", "nr")} as "rougeL" from lcs)"""


def mt13a(c: str) -> str:
    for old, new in (
        ("'<skipped>'", "''"), (text("-\n"), "''"), (NL, "' '"), ("'&quot;'", "'\"'"),
        ("'&amp;'", "'&'"), ("'&lt;'", "'<'"), ("'&gt;'", "'>'"),
    ):
        c = f"replace({c}, {old}, {new})"
    c = f"concat(' ', {c}, ' ')"
    for pattern, new in (
        (r"([{-~\[-` -&(-+:-@/])", r" \1 "), (r"([^0-9])([.,])", r"\1 \2 "),
        (r"([.,])([^0-9])", r" \1 \2"), (r"([0-9])(-)", r"\1 \2 "),
    ):
        c = f"regexp_replace({c}, '{pattern}', '{new}', 'g')"
    return f"regexp_extract_all({c}, {WORD})"


BLEU = f"""{", ".join(gram_match(n) for n in (1, 2, 3, 4))},
sums as (
  select match1.model, sum(match1.nr) as ref_len,
    {", ".join(f"sum(match{n}.m) as m{n}, sum(match{n}.np) as p{n}" for n in (1, 2, 3, 4))}
  from match1 {" ".join(f"join match{n} using (model, sample_id)" for n in (2, 3, 4))}
  group by match1.model),
precisions as (
  select *, {", ".join(
      f"case when m{n} = 0 then 100.0 / (pow(2.0, {' + '.join(f'(m{k} = 0)::int' for k in range(1, n + 1))}) * p{n}) "
      f"else 100.0 * m{n} / p{n} end as q{n}" for n in (1, 2, 3, 4))}
  from sums),
bleu as (
  select model, cast(p1 as bigint) as sys_len, cast(ref_len as bigint) as ref_len,
    case when greatest(m1, m2, m3, m4) > 0 and p4 > 0
      then (case when p1 < ref_len then exp(1 - ref_len / p1) else 1.0 end)
        * exp((ln(q1) + ln(q2) + ln(q3) + ln(q4)) / 4) else 0.0 end as bleu
  from precisions)"""

MT_TOKENS = f"""toks as (
  select model, sample_id, {mt13a("prediction")} as p, {mt13a("reference")} as r from predictions)"""

PERPLEXITY = f"""{TOKEN_NLL}, per_text as (
  select model, text_id, avg(nll) as text_nll from token_nll group by model, text_id),
perplexities as (
  select model, count(*) as n_texts, exp(coalesce(avg(text_nll), 0.0)) as perplexity
  from per_text group by model)"""

REPORT = f"""{PREDICTIONS}, {ALNUM_TOKENS}, {rouge_n(1)}, {rouge_n(2)}, {ROUGE_L},
bleus as (with {MT_TOKENS}, {BLEU} select * from bleu), {PERPLEXITY},
base_report as (
  select model, round(avg(rouge1), 4) as rouge1, round(avg(rouge2), 4) as rouge2,
         round(avg("rougeL"), 4) as "rougeL", count(*) as num_samples
  from rouge1 join rouge2 using (model, sample_id) join rougeL using (model, sample_id)
  group by model),
report as (
  select model, rouge1, rouge2, "rougeL", round(bleu, 4) as bleu,
         round(perplexity, 2) as perplexity,
         (select round(avg({n_words("prediction")}), 1) from predictions p
          where p.model = base_report.model) as avg_response_length, num_samples
  from base_report join bleus using (model) join perplexities using (model))"""

BLOCKS = -(-REPLICATES // PER_DIGEST)
DRAWN = f"""drawn as (
  select model, metric, v, block * {PER_DIGEST} + i as replicate,
    cast(concat('0x', substr(digest, i * 4 + 1, 4)) as int) as u
  from (select model, metric, v, block, md5(concat('42:', sample_id, ':', block)) as digest
        from (select model, sample_id, 'rouge1' as metric, rouge1 as v from rouge1
              union all select model, sample_id, 'rouge2', rouge2 from rouge2) s,
             range({BLOCKS}) b(block)) d, range({PER_DIGEST}) c(i)),
weighted as (
  select model, metric, replicate, v, {" + ".join(f"(u >= {t})::int" for t in poisson_thresholds())} as w
  from drawn where replicate < {REPLICATES}),
means as (
  select model, metric, sum(w * v) / sum(w) as mean from weighted
  group by model, metric, replicate)"""

SPLIT_REPORT = """select split, count(*) as n_rows, sum(length(text)) as text_chars,
  sum(length(output)) as output_chars, count(*) filter (input <> '') as n_with_input,
  max(length(text)) as max_text_chars"""

PREP_KEPT = f"""{PAIRS}, {formatted("pairs", "sample_id")},
kept as (select * from formatted where {PROSE_PASSES})"""

PREP_SAMPLED = f"""{PAIRS}, sampled as (
  select * from pairs order by {hash_of("sample_id")}, sample_id limit 150),
{formatted("sampled", "sample_id")}, kept as (select * from formatted where {PROSE_PASSES})"""

DAY = "strftime(date_trunc('day', ts), '%Y-%m-%d')"
PROMPTS = ", ".join(f"({text(label)}, {text(p)})" for label, p in EXAMPLE_PROMPTS)

SAMPLES = ", ".join(f"({text(p)}, {text(a)})" for p, a in zip(REVIEW_PROMPTS, SAMPLE_ANSWERS))

HEADER = text(REVIEW_HEADER)
RUBRIC = text(REVIEW_RUBRIC)

ORACLE: dict[str, str] = {
    "q_prep_pipeline": f"""with {PREP_KEPT},
split as (select *, {ordered_split("sample_id")} as split from kept)
{SPLIT_REPORT} from split group by split""",
    "q_prep_rows": f"with {PREP_KEPT} select *, {stable_split('sample_id')} as split from kept",
    "q_prep_sampled": f"""with {PREP_SAMPLED}
select sample_id, {ordered_split("sample_id")} as split from kept""",
    "q_prep_stages": f"""with {PREP_SAMPLED},
split as (select {ordered_split("sample_id")} as split from kept)
select 'raw' as stage, count(*) as n_rows from pairs
union all select 'sampled', count(*) from sampled
union all select 'kept', count(*) from split
union all select 'train', count(*) from split where split = 'train'
union all select 'eval', count(*) from split where split = 'eval'""",
    "q_truncate": f"""with w as (
  select doc_id, regexp_extract_all(text, {WORD}) as w from documents)
select doc_id, array_to_string(w[1:512], ' ') as text, len(w) > 512 as truncated from w""",
    "q_align_unmatched": """select conv_id, turn from conversations a where role = 'assistant'
  and not exists (select 1 from conversations u where u.role = 'user' and u.conv_id % 2 = 0
    and u.conv_id = a.conv_id and u.turn + 1 = a.turn)""",
    "q_prep_custom": f"""with {PAIRS}, fields as (
  select sample_id, {strip("instruction")} as instruction, {strip("output")} as output,
         {ALPACA_TEXT} as text from pairs)
select *, {stable_split("sample_id")} as split from fields where {n_words("output")} >= 100""",
    "q_user_content": f"""with {PAIRS}
select sample_id, {content("instruction", "input")} as content from pairs""",
    "q_messages_render": f"""with {PAIRS}
select sample_id, 'system,user,assistant' as roles,
  concat({SYSTEM_PART}, {content("instruction", "input")}, '[/INST] ', output, '</s>') as text,
  concat({SYSTEM_PART}, {content("instruction", "input")}, '[/INST]') as generation_prompt,
  concat('<s>[INST] ', instruction, '[/INST]') as plain_prompt
from pairs""",
    "q_conversation_render": f"""with t as (
  select *, lag(role) over (partition by conv_id order by turn) as prev from conversations),
p as (
  select conv_id, turn, case role
    when 'system' then concat(case when prev = 'system' then '' else '[INST] ' end, text, {text(chr(10) * 2)})
    when 'user' then concat(case when prev = 'system' then '' else '[INST] ' end, text, '[/INST]')
    else concat(' ', text, '</s>') end as piece
  from t)
select conv_id, count(*) as n_turns, concat('<s>', string_agg(piece, '' order by turn)) as text
from p group by conv_id""",
    "q_alpaca_render": f"""with {PAIRS}
select sample_id, concat({text("### Instruction:" + chr(10))}, instruction,
    {text(chr(10) * 2 + "### Response:" + chr(10))}) as prompt, {ALPACA_TEXT} as text
from pairs""",
    "q_alpaca_parse": f"""with {PAIRS}, {ALPACA}, parts as (
  select sample_id, string_split(text, {text("### Response:" + chr(10))}) as s from alpaca)
select sample_id, concat(s[1], {text("### Response:" + chr(10))}) as prompt,
  coalesce(s[2], '') as expected, len(s) > 1 as has_marker,
  replace(replace(concat(s[1], {text("### Response:" + chr(10))}), {text("### Instruction:" + chr(10))}, ''),
    {text(chr(10) * 2 + "### Response:" + chr(10))}, '') as instruction
from parts""",
    "q_strip_defaults": f"""select doc_id,
  case when doc_id % 7 = 0 then ''
    else {strip("concat(chr(9), ' ', text, chr(160), chr(12288), ' ', chr(10))")} end as instruction,
  case when doc_id % 3 = 0 then '' else concat(' ', lang) end as input
from documents""",
    "q_preview": """select doc_id, 'doc_id,text,lang,source,n_chars' as columns,
  substr(text, 1, 200) as head from documents""",
    "q_quality_filter": f"""with {INSTRUCTION_DOCS}, {formatted("instruction_docs", "doc_id")}
select * from formatted where length(instruction) >= 10 and length(output) >= 30
  and length(text) < 4096 and {CODE_MARKERS}""",
    "q_reject_reasons": f"""with {INSTRUCTION_DOCS}, {formatted("instruction_docs", "doc_id")},
r as (select doc_id, concat_ws(',', case when length(instruction) < 10 then 'short_instruction' end,
    case when length(output) < 30 then 'short_output' end,
    case when length(text) >= 4096 then 'too_long' end,
    case when not {CODE_MARKERS} then 'no_marker' end) as reject_reasons from formatted)
select doc_id, reject_reasons, reject_reasons = '' as accepted from r""",
    "q_funnel": f"""with {INSTRUCTION_DOCS}, {formatted("instruction_docs", "doc_id")},
flagged as (select {hash_of("doc_id")} < '8' as sampled, {PROSE_PASSES} as kept,
  {stable_split("doc_id")} as split from formatted)
select count(*) as n_raw, count(*) filter (sampled) as n_sampled,
  count(*) filter (sampled and kept) as n_kept,
  count(*) filter (sampled and kept and split = 'train') as n_train,
  count(*) filter (sampled and kept and split = 'eval') as n_eval
from flagged""",
    "q_sample_exact": f"""select doc_id, lang, n_chars from documents
order by {hash_of("doc_id")}, doc_id limit 500""",
    "q_sample_cutoff": f"""select doc_id, lang, n_chars from documents
order by {hash_of("doc_id")}, doc_id limit 150""",
    "q_split_exact": f"select doc_id, {ordered_split('doc_id')} as split from documents",
    "q_split_stable": f"select doc_id, {stable_split('doc_id')} as split from documents",
    "q_head": "select event_id, user_id, event_type, value from events order by event_id limit 50",
    "q_tail": """select * from (select event_id, user_id, event_type, value from events
order by event_id desc limit 10) t order by event_id""",
    "q_batches": f"""select batch_id, count(*) as n_rows, sum(length(text)) as sum_chars,
  max(length(text)) as max_chars
from (select text, (row_number() over (order by {hash_of("doc_id")}, doc_id) - 1) // 16 as batch_id
      from documents) t
group by batch_id""",
    "q_truncate_stats": f"""with c as (
  select lang, {n_words("text")} as n, lim from documents, (values (512), (1024)) l(lim))
select lang, count(*) as n_texts, count(*) filter (n > lim) as n_truncated,
  sum(n) as total_tokens, sum(least(n, lim)) as kept_tokens, max(n) as max_tokens, lim as "limit"
from c group by lang, lim""",
    "q_word_count": f"select doc_id, {n_words('text')} as n_words from documents",
    "q_align": """select u.conv_id, u.turn + 1 as turn, u.text as prediction, a.text as reference
from conversations u left join conversations a
  on a.conv_id = u.conv_id and a.turn = u.turn + 1 and a.role = 'assistant'
where u.role = 'user'""",
    "q_align_counts": """select count(*) as n_predictions, count(a.text) as n_matched,
  count(*) - count(a.text) as n_unmatched
from conversations u left join conversations a
  on a.conv_id = u.conv_id and a.turn = u.turn + 1 and a.role = 'assistant'
where u.role = 'user'""",
    "q_rouge1": f"with {PREDICTIONS}, {ALNUM_TOKENS}, {rouge_n(1)} select * from rouge1",
    "q_rouge2": f"with {PREDICTIONS}, {ALNUM_TOKENS}, {rouge_n(2)} select * from rouge2",
    "q_rouge_mean": f"""with {PREDICTIONS}, {ALNUM_TOKENS}, {rouge_n(1)}, {rouge_n(2)}
select model, round(avg(rouge1), 4) as rouge1, round(avg(rouge2), 4) as rouge2
from rouge1 join rouge2 using (model, sample_id) group by model""",
    "q_rouge_l": f"with {PREDICTIONS}, {ALNUM_TOKENS}, {ROUGE_L} select * from rougeL",
    "q_rouge_stemmed": f"""with {PREDICTIONS}, {STEMMED_TOKENS}, {rouge_n(1)}, {rouge_n(2)}
select * from rouge1 join rouge2 using (model, sample_id)""",
    "q_rouge_l_stemmed": f"with {PREDICTIONS}, {STEMMED_TOKENS}, {ROUGE_L} select * from rougeL",
    "q_rouge_bootstrap": f"""with {PREDICTIONS}, {ALNUM_TOKENS}, {rouge_n(1)}, {rouge_n(2)}, {DRAWN}
select model, metric, round(quantile_cont(mean, 0.025), 6) as low, round(quantile_cont(mean, 0.5), 6) as mid,
  round(quantile_cont(mean, 0.975), 6) as high
from means group by model, metric""",
    "q_bleu": f"""with {PREDICTIONS}, {MT_TOKENS}, {BLEU}
select model, sys_len, ref_len, round(bleu, 6) as bleu from bleu""",
    "q_mean_length": f"""with {PREDICTIONS}
select model, round(avg({n_words("prediction")}), 6) as avg_response_length
from predictions group by model""",
    "q_perplexity": f"""with {PERPLEXITY}
select model, n_texts, round(perplexity, 6) as perplexity from perplexities""",
    "q_perplexity_first": f"""with {TOKEN_NLL}, per_text as (
  select text_id, avg(nll) as text_nll from token_nll group by text_id order by text_id limit 20)
select count(*) as n_texts, round(exp(avg(text_nll)), 2) as perplexity from per_text""",
    "q_unigram_perplexity": f"""with docs as (
  select doc_id, regexp_extract_all(text, {WORD}) as t, {stable_split("doc_id")} as split
  from documents),
words as (select doc_id, split, len(t) as n, unnest(t) as word from docs),
vocab as (select word, count(*) as c from words where split = 'train' group by word),
size as (select sum(c) as total, count(*) + 1 as v from vocab),
scored as (
  select doc_id, avg(ln(total + v) - ln(coalesce(c, 0) + 1.0)) as nll
  from words left join vocab using (word), size where split = 'eval' group by doc_id)
select cast(total as bigint) as train_tokens, v as vocabulary,
  (select count(*) from scored) as n_texts,
  round(coalesce(exp((select avg(nll) from scored)), 1.0), 4) as perplexity
from size""",
    "q_eval_report": f"with {REPORT} select * from report",
    "q_eval_report_stemmed": f"""with {PREDICTIONS}, {STEMMED_TOKENS}, {rouge_n(1)}, {rouge_n(2)}, {ROUGE_L},
bleus as (with {MT_TOKENS}, {BLEU} select * from bleu),
means as (
  select model, round(avg(rouge1), 4) as rouge1, round(avg(rouge2), 4) as rouge2,
         round(avg("rougeL"), 4) as "rougeL", count(*) as num_samples
  from rouge1 join rouge2 using (model, sample_id) join rougeL using (model, sample_id)
  group by model)
select model, rouge1, rouge2, "rougeL", round(bleu, 4) as bleu, cast(null as double) as perplexity,
  (select round(avg({n_words("prediction")}), 1) from predictions p
   where p.model = means.model) as avg_response_length, num_samples
from means join bleus using (model)""",
    "q_metrics_document": f"""with {REPORT}
select *, max(num_samples) over () as eval_samples, true as has_note from report""",
    "q_metric_long": f"""with {REPORT}
select concat(model, '/', metric) as key, value from (
  select model, unnest(['rouge1', 'rouge2', 'rougeL', 'bleu', 'perplexity', 'avg_response_length',
      'num_samples']) as metric,
    unnest([rouge1, rouge2, "rougeL", bleu, perplexity, avg_response_length, num_samples]) as value
  from report) l""",
    "q_metric_compare": f"""with {REPORT}, l as (
  select model, unnest(['ROUGE-1', 'ROUGE-2', 'ROUGE-L']) as metric,
    unnest([rouge1, rouge2, "rougeL"]) as value from report),
w as (select metric, round(coalesce(max(value) filter (model = 'base'), 0.0), 4) as base,
    round(coalesce(max(value) filter (model = 'finetuned'), 0.0), 4) as finetuned
  from l group by metric)
select metric, base, finetuned, printf('%.1f%%', round(base * 100, 1)) as base_percent,
  printf('%.1f%%', round(finetuned * 100, 1)) as finetuned_percent,
  base >= 0.5 as base_on_target, finetuned >= 0.5 as finetuned_on_target
from w""",
    "q_side_by_side": f"""with {PREDICTIONS}
select sample_id, max(prediction) filter (model = 'base') as base,
  max(prediction) filter (model = 'finetuned') as finetuned
from predictions group by sample_id""",
    "q_loss_typed": f"with {TYPED_LOG} select * from typed",
    "q_loss_points": f"""with {TYPED_LOG}
select run_id, step, printf('%.4f', round(round(loss, 6), 4)) as loss_text,
  printf('%.1f', round(round(coalesce(epoch, 0.0), 4), 1)) as epoch_text,
  regexp_replace(printf('%.2e', (step * 7 + 1) / 7e7), 'e([+-])0+([0-9])', 'e\\1\\2') as rate_text
from typed where loss is not null""",
    "q_loss_min": f"""with {TYPED_LOG}, m as (
  select run_id, min(loss) as min_loss, count(loss) as n_points from typed
  where loss is not null group by run_id)
select m.run_id, min_loss, min(step) as min_step, n_points
from m join typed t on t.run_id = m.run_id and t.loss = min_loss
group by m.run_id, min_loss, n_points""",
    "q_epoch_boundaries": f"""with {TYPED_LOG}, w as (
  select run_id, step, cast(floor(epoch) as bigint) as epoch,
    max(cast(floor(epoch) as bigint)) over (partition by run_id order by step
      rows between unbounded preceding and 1 preceding) as seen
  from typed where loss is not null)
select run_id, epoch, step from w where epoch > coalesce(seen, 0)""",
    "q_loss_thin": f"""with {TYPED_LOG}
select * from typed where loss is not null and step % 10 = 0""",
    "q_loss_tail": f"""with {TYPED_LOG}
select * from typed where loss is not null order by step desc limit 10""",
    "q_request_check": f"""with {REQUESTS}, d as (
  select event_id, prompt, coalesce(max_tokens, 512) as max_tokens,
         coalesce(temperature, 0.7) as temperature from requests),
v as (select event_id, max_tokens, temperature, concat_ws(',',
    case when length(prompt) not between 1 and 4096 then 'prompt' end,
    case when max_tokens not between 64 and 2048 then 'max_tokens' end,
    case when temperature not between 0.1 and 1.5 then 'temperature' end) as violations from d)
select *, violations = '' as accepted from v""",
    "q_rate_limit": f"""select * from (
  select event_id, user_id, {DAY} as day,
    row_number() over (partition by user_id, {DAY} order by ts, event_id) as rank
  from events) t where rank <= 5""",
    "q_rate_limit_routes": """with c as (
  select user_id, event_type as route, date_trunc('minute', ts) as w, count(*) as n
  from events group by all)
select route, sum(n) as n_requests, sum(least(n, 5)) as n_admitted,
  sum(n) - sum(least(n, 5)) as n_blocked
from c group by route""",
    "q_rate_limit_mixed": f"""select * from (
  select event_id, user_id, event_type as route, {DAY} as day,
    row_number() over (partition by user_id, event_type, {DAY} order by ts, event_id) as rank
  from events) t
where rank <= case route when 'click' then 1 when 'view' then 2 else 3 end""",
    "q_rate_counts": f"""select user_id, {DAY} as day, count(*) as n_requests,
  least(count(*), 5) as n_admitted, count(*) - least(count(*), 5) as n_blocked
from events group by user_id, day""",
    "q_admission": f"""select event_id, user_id, {DAY} as day,
  row_number() over (partition by user_id, {DAY} order by ts, event_id) <= 5 as admitted
from events""",
    "q_recent_prompts": f"""with {REQUESTS}, l as (
  select user_id, trim(prompt) as prompt, max(ts) as last_used from requests
  where trim(prompt) <> '' group by user_id, trim(prompt))
select * from (select user_id, prompt,
    row_number() over (partition by user_id order by last_used desc, prompt) as rank from l) t
where rank <= 5""",
    "q_fence_extract": f"""with {CODE_ANSWERS}, c as (
  select sample_id, {strip("text")} as code from code_answers),
p as (select *, string_split(code, '```') as s,
    {strip("string_split(code, '```')[2]")} as middle from c)
select sample_id, case
  when regexp_matches(code, '(?s)```(?:python|py)?\n(.*?)\n```')
    then {strip("regexp_extract(code, '(?s)```(?:python|py)?" + chr(10) + "(.*?)" + chr(10) + "```', 1)")}
  when len(s) >= 3 then case
    when starts_with(middle, {text("python" + chr(10))}) or starts_with(middle, {text("py" + chr(10))})
      then {strip("regexp_replace(middle, '^[^" + chr(10) + "]*" + chr(10) + "', '')")} else middle end
  else code end as code
from p""",
    "q_syntax_valid": f"with {SYNTAX} select sample_id, model, valid, line from checked",
    "q_syntax_panels": f"""with {SYNTAX}
select sample_id, valid,
  case when not valid then concat('Line ', coalesce(cast(line as varchar), 'undefined'), ': ', error) end as message
from checked where model = 'base' and length(text) > 5""",
    "q_syntax_rate": f"""with {SYNTAX}
select model, count(*) as n_outputs, count(*) filter (valid) as n_valid,
  round(count(*) filter (valid) / count(*), 6) as valid_share
from checked group by model""",
    "q_syntax_errors": f"""with {SYNTAX}
select error, count(*) as n from checked where not valid
group by error order by n desc, error limit 10""",
    "q_sse_encode": f"""with {WORDS_OF_TURNS}
select conv_id, turn, seq, concat('data: {{"token": ', to_json(token), '}}') as line from tokens
union all
select conv_id, turn, len(w), 'data: {{"done": true}}' from words""",
    "q_sse_decode": f"""with {WORDS_OF_TURNS}
select conv_id, turn, seq, token from tokens where token <> ''""",
    "q_stream_fold": f"""with {WORDS_OF_TURNS}
select conv_id, turn, true as done, string_agg(token, '' order by seq) as text,
  count(*) filter (token <> '') as token_count
from tokens group by conv_id, turn""",
    "q_stream_rate": f"""with {WORDS_OF_TURNS}, s as (
  select conv_id, turn, count(*) as token_count, (300 + 28 * max(seq)) * 1000 / 1e6 as elapsed
  from tokens where token <> '' group by conv_id, turn)
select conv_id, turn, token_count, true as done,
  case when elapsed > 0.5 then cast(floor(token_count / elapsed + 0.5) as bigint) end as tokens_per_sec
from s""",
    "q_streams_open": """select conv_id, bool_or(role = 'user') as is_generating,
  count(*) as n_streams from conversations group by conv_id""",
    "q_chunk_lines": f"""with l as (select doc_id, string_split(text, {NL}) as s from documents),
i as (select doc_id, s, unnest(range(len(s) - 1)) as seq from l)
select doc_id, seq, s[seq + 1] as line from i""",
    "q_stream_loss": f"""with {TYPED_LOG}
select run_id, step, round(loss, 6) as loss, round(coalesce(epoch, 0.0), 4) as epoch
from typed where loss is not null""",
    "q_stream_tokens": f"""with {WORDS_OF_TURNS}
select concat(conv_id, ':', turn) as stream, string_agg(token, '' order by seq) as text,
  count(*) filter (token <> '') as token_count, true as done
from tokens group by conv_id, turn""",
    "q_human_report": f"""with {PAIRS}, n as (
  select sample_id, instruction, output, row_number() over (order by sample_id) as number from pairs)
select sample_id, number, concat(case when number = 1 then {HEADER} else '' end,
  '## Problem ', number, {text(chr(10) + "**Prompt:**" + chr(10) + "```text" + chr(10))}, instruction,
  {text(chr(10) + "```" + chr(10) * 2 + "**Generated Code:**" + chr(10) + "```python" + chr(10))}, output,
  {text(chr(10) + "```" + chr(10) * 2)}, {RUBRIC}) as block
from n""",
    "q_review_file": f"""with report as (with {PAIRS}, n as (
  select sample_id, instruction, output, row_number() over (order by sample_id) as number from pairs)
select sample_id, number, concat(case when number = 1 then {HEADER} else '' end,
  '## Problem ', number, {text(chr(10) + "**Prompt:**" + chr(10) + "```text" + chr(10))}, instruction,
  {text(chr(10) + "```" + chr(10) * 2 + "**Generated Code:**" + chr(10) + "```python" + chr(10))}, output,
  {text(chr(10) + "```" + chr(10) * 2)}, {RUBRIC}) as block
from n),
l as (select unnest(string_split(substr(block, 1, length(block) - 1), chr(10))) as line from report)
select line, count(*) as n from l group by line""",
    "q_review_places": f"""with {PAIRS}, all_pairs as (
  select sample_id, instruction, output from pairs
  union all select concat('sample:', prompt), prompt, answer from (values {SAMPLES}) v(prompt, answer)),
n as (
  select instruction, output, row_number() over (order by sample_id) as number from all_pairs),
report as (
  select number, concat(case when number = 1 then {HEADER} else '' end,
    '## Problem ', number, {text(chr(10) + "**Prompt:**" + chr(10) + "```text" + chr(10))}, instruction,
    {text(chr(10) + "```" + chr(10) * 2 + "**Generated Code:**" + chr(10) + "```python" + chr(10))}, output,
    {text(chr(10) + "```" + chr(10) * 2)}, {RUBRIC}) as block
  from n),
l as (
  select number, string_split(substr(block, 1, length(block) - 1), chr(10)) as lines from report),
u as (select number, unnest(lines) as line, generate_subscripts(lines, 1) as i from l)
select row_number() over (order by number, i) as line_no, line from u""",
    "q_jsonl_roundtrip": f"""with {INSTRUCTION_DOCS}, {formatted("instruction_docs", "doc_id")}
select instruction, input, output, text, {stable_split("doc_id")} as split from formatted""",
    "q_union_available": f"""with {PREDICTIONS}
select model, count(*) as n_rows, sum(length(prediction)) as prediction_chars,
  'distilled' as missing from predictions group by model""",
    "q_split_publish": f"""select doc_id, lang, n_chars, {stable_split("doc_id")} as split
from documents""",
    "q_csv_append": f"""with {TYPED_LOG}, t as (
  select step, loss, cast(null as double) as learning_rate, epoch from typed)
select * from t union all select * from t""",
    "q_inline_rows": f"""with p as (
  select label, unnest(list_distinct(regexp_extract_all(lower(prompt), '[a-z0-9]+'))) as word
  from (values {PROMPTS}) v(label, prompt)),
d as (select word, count(*) as n from (
    select unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as word from documents) u
  group by word)
select label, count(*) as n_words_found, sum(n) as n_occurrences
from p join d using (word) group by label""",
    "q_stream_first_hit": """with recursive hits as (
  select user_id, event_id, epoch_us(ts) as us from events),
starts as (
  select user_id, min(us) as s from hits group by user_id
  union all
  select h.user_id, min(h.us) from starts join hits h
    on h.user_id = starts.user_id and h.us >= starts.s + 86400000000 group by h.user_id),
placed as (
  select h.user_id, h.event_id, h.us, s from hits h asof join starts
    on h.user_id = starts.user_id and h.us >= starts.s),
ranked as (
  select event_id, user_id,
    row_number() over (partition by user_id, s order by us, event_id) as rank from placed)
select event_id, user_id, rank, rank <= 5 as admitted from ranked""",
}
ORACLE["q_stream_loss_min"] = ORACLE["q_loss_min"]
ORACLE["q_stream_rate_limit"] = ORACLE["q_rate_counts"]
ORACLE["q_stream_chunks"] = ORACLE["q_chunk_lines"]
ORACLE["q_stream_recent"] = ORACLE["q_recent_prompts"]
ORACLE["q_stream_reordered"] = f"select *, 0::bigint as gaps from ({ORACLE['q_stream_tokens']}) t"
ORACLE["q_first_hit_batch"] = ORACLE["q_stream_first_hit"]
ORACLE["q_align_positional"] = f"""with {PREDICTIONS}, f as (
  select sample_id, prediction, reference from predictions where model = 'finetuned'),
p as (select prediction, row_number() over (order by sample_id) - 1 as position from f
  where ('0x' || substr(md5(sample_id), 1, 8))::bigint % 9 <> 0),
r as (select reference, row_number() over (order by sample_id) - 1 as position from f)
select position, prediction, reference from p join r using (position)"""
ORACLE["q_occurrence_keys"] = f"""with s as (
  select doc_id, string_split(text, {NL}) as s from documents where text is not null),
l as (select doc_id, unnest(range(len(s)))::integer as line_no, unnest(s) as line from s)
select doc_id, line_no, concat(md5(line), ':', row_number() over (partition by line order by doc_id, line_no)) as row_key
from l"""
ORACLE["q_bad_rows"] = """with n as (
  select doc_id, doc_id % 23 as n, row_number() over (order by doc_id) - 1 as position from documents),
r as (select *, case n when 1 then 'malformed' when 2 then 'malformed' when 3 then 'not an object'
  when 4 then 'missing: text' when 5 then 'type: n_chars' when 6 then 'type: text, n_chars' else '' end as reason
  from n)
select position, reason, case when reason = '' then doc_id end as doc_id from r"""
ORACLE["q_number_equal_keys"] = """with k as (
  select case when doc_id % 3 = 0 then 'every third' else source end as key,
    coalesce(('0x' || substr(md5(text), 1, 15))::bigint, -1) as digest from documents)
select key, digest, row_number() over (order by key nulls first, digest) - 1 as number from k"""
ORACLE["q_loss_snapshots"] = f"""with {TYPED_LOG}, b as (
  select min(event_id) as low, (max(event_id) - min(event_id)) // 3 + 1 as width from events),
p as (select run_id, round(loss, 6) as loss,
    (case when step >= 3000000000 then step - 3000000000 else step end - low) // width as third
  from typed, b where loss is not null)
select version, count(*) as n_points, count(distinct run_id) as n_runs, min(loss) as min_loss
from (select unnest(range(3)) as version) v join p on third <= version group by version"""
ORACLE["q_eval_fused"] = f"""with {PREDICTIONS}, w as (
  select model, ({strip("coalesce(prediction, '')")} = {strip("coalesce(reference, '')")})::integer as same,
    {n_words("coalesce(prediction, '')")} as p, {n_words("coalesce(reference, '')")} as r from predictions),
s as (select model, sum(same) / count(*) as same, sum(p) / nullif(sum(r), 0) as ratio,
    sqrt(sum((p - r) * (p - r)) / count(*)) as rmse, max(abs(p - r))::double as most from w group by model)
select model, unnest(['exact_match', 'length_ratio', 'length_rmse', 'length_max_error']) as metric,
  round(unnest([same, ratio, rmse, most]), 6) as value from s"""
