"""Prompts, training examples and parsing of answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..functions import columns as C
from ..functions import wording as W
from ..operators import prompts, responses, sampling
from ..operators.ordinal import with_ordinal
from .build import KEY_SQL
from .registry import query
from .views import Views

FEATURES = list(Views.features)


def sql_text(text: str) -> str:
    """A SQL expression for a fixed text, line breaks spelled out."""
    return " || chr(10) || ".join("'" + part.replace("'", "''") + "'" for part in text.split("\n"))


PREDICT_SQL = f"{sql_text(W.PREDICT_PREFIX)} || line || {sql_text(W.PREDICT_QUESTION)}"
ANSWER_FIRST_SQL = f"{sql_text(W.FEATURES_HEAD)} || line || {sql_text(W.ANSWER_FIRST_QUESTION)}"


@query("serialize_row", "v_line", "select row_id, line as text from v_line")
def serialize_row(v: Views):
    return prompts.serialize(v.modeling(), FEATURES).select("row_id", "text")


@query("serialize_indexed", "v_line", "select row_id, '[' || row_id || '] ' || line as text from v_line")
def serialize_indexed(v: Views):
    return prompts.serialize(v.modeling(), FEATURES, idx="row_id").select("row_id", "text")


SHUFFLED_SQL = " || ' | ' || ".join(
    f"'{W.display_name(f)}=' || coalesce({f}::varchar, 'nan')" for f in prompts.shuffled(FEATURES)
)


@query("serialize_shuffled", "v_modeling", f"select row_id, {SHUFFLED_SQL} as text from v_modeling")
def serialize_shuffled(v: Views):
    return prompts.serialize(v.modeling(), prompts.shuffled(FEATURES)).select("row_id", "text")


@query(
    "predict_prompt",
    "v_line",
    f"""select row_id, {PREDICT_SQL} as prompt,
       case when u_age is null or u_age = '50+' then '' else {sql_text(W.NOTES_HEAD)} || 'Age band ' || u_age || ' clicks late.' || chr(10) || chr(10) end
       || {PREDICT_SQL} as noted from v_line""",
)
def predict_prompt(v: Views):
    notes = F.when(F.col("u_age") != "50+", F.concat(F.lit("Age band "), "u_age", F.lit(" clicks late.")))
    asked = prompts.predict_prompt(v.modeling(), FEATURES)
    return prompts.predict_prompt(asked, FEATURES, notes, name="noted").select("row_id", "prompt", "noted")


@query("answer_first_prompt", "v_line", f"select row_id, {ANSWER_FIRST_SQL} as prompt from v_line")
def answer_first_prompt(v: Views):
    return prompts.answer_first_prompt(v.modeling(), FEATURES).select("row_id", "prompt")


@query(
    "teacher_prompt",
    "v_line",
    f"select row_id, {sql_text(W.FEATURES_HEAD)} || line || {sql_text(W.TEACHER_QUESTION)} as prompt from v_line",
)
def teacher_prompt(v: Views):
    return prompts.teacher_prompt(v.modeling(), FEATURES).select("row_id", "prompt")


@query(
    "explain_prompt",
    "v_line v_predictions",
    f"""select row_id, {sql_text(W.FEATURES_HEAD)} || line || chr(10) || chr(10) || 'The model predicts: '
       || case when h_a = 1 then 'click (1)' else 'no click (0)' end || '. Explain in one sentence starting with ''Because''.' as prompt
       from v_line join v_predictions using (row_id)""",
)
def explain_prompt(v: Views):
    rows = v.modeling().join(v.predictions().select("row_id", "h_a"), "row_id")
    return prompts.explain_prompt(rows, FEATURES, "h_a").select("row_id", "prompt")


def reasoned(v: Views):
    """Modelling rows with their rationale."""
    texts = v.rationales().select(F.col("row_id").cast("bigint").alias("row_id"), "rationale")
    return v.modeling().join(texts, "row_id")


def flat_messages(df):
    return df.select(
        "row_id",
        *[F.col("messages")[i][k].alias(f"{k}_{i}") for i in (0, 1) for k in ("role", "content")],
        F.size("messages").alias("turns"),
    )


@query(
    "sft_messages",
    "v_line v_rationales",
    f"""select l.row_id, 2::bigint turns, 'user' role_0, 'assistant' role_1, kind, case when kind = 'plain' then {PREDICT_SQL} else {ANSWER_FIRST_SQL} end content_0,
       case when kind = 'plain' then clicked::varchar else 'Answer: ' || clicked || chr(10) || 'Because: ' || rationale end content_1
       from v_line l join v_rationales r on l.row_id = r.row_id::bigint, (select unnest(['plain', 'reasoned']) kind)""",
)
def sft_messages(v: Views):
    rows = reasoned(v)
    plain = flat_messages(prompts.sft_messages(rows, FEATURES)).withColumn("kind", F.lit("plain"))
    told = flat_messages(prompts.sft_messages(rows, FEATURES, rationale="rationale")).withColumn("kind", F.lit("reasoned"))
    return plain.unionByName(told)


@query(
    "segment_weights",
    "v_rationales",
    """select row_id, i::bigint as position, case i when 0 then 'Answer: ' || label || chr(10) else 'Because: ' || rationale end as segment,
       case i when 0 then 1e0 else 0.05e0 end as weight from v_rationales, (select unnest(range(2)) i)""",
)
def segment_weights(v: Views):
    rows = prompts.segment_weights(v.rationales(), DEFAULTS.rationale_weight, label="label")
    return rows.select("row_id", F.posexplode("segments").alias("position", "s")).select(
        "row_id", "position", "s.segment", "s.weight"
    )


@query(
    "labeled_examples_block",
    "v_line",
    f"""select event_type, {sql_text(W.EXAMPLES_HEAD)} || string_agg('[clicked=' || clicked || '] ' || line, chr(10) order by pos) as prompt, count(*) n
       from (select *, row_number() over (partition by event_type order by {KEY_SQL}, row_id) pos from v_line) where pos <= 300 group by event_type
       union all select 'all of them', {sql_text(W.EXAMPLES_HEAD)} || string_agg('[clicked=' || clicked || '] ' || line, chr(10) order by pos), count(*)
       from (select *, row_number() over (order by {KEY_SQL}, row_id) pos from v_line) where pos <= 300""",
)
def labeled_examples_block(v: Views):
    rows, k = v.modeling(), DEFAULTS.shown_rows
    per_type = prompts.labeled_examples_block(rows, FEATURES, k, "row_id", by=["event_type"])
    whole = prompts.labeled_examples_block(rows, FEATURES, k, "row_id").withColumn("event_type", F.lit("all of them"))
    return per_type.unionByName(whole)


@query(
    "batched_prompts",
    "v_line",
    f"""select batch, n, {sql_text(W.PATTERNS_HEAD)} || 'Hot streamers win.' || chr(10) || chr(10) || 'Predict clicked (0 or 1) for each of the ' || n
       || ' rows below. Output EXACTLY ' || n || ' lines, each `i=0` or `i=1` where i is the bracket number. No other text.' || chr(10) || chr(10) || block as prompt
       from (select batch, count(*) n, string_agg('[' || local || '] ' || line, chr(10) order by local) block
         from (select line, pos // 50 batch, pos % 50 as local from (select line, row_number() over (order by {KEY_SQL}) - 1 pos from v_line)) group by batch)""",
)
def batched_prompts(v: Views):
    placed = with_ordinal(v.modeling(), "row_id", DEFAULTS.seed)
    return prompts.batched_prompts(placed, FEATURES, DEFAULTS.prompt_batch, F.lit("Hot streamers win."))


ERROR_ROWS_SQL = f"""(select l.*, y, h_a, row_number() over (partition by l.event_type order by {KEY_SQL.replace('row_id', 'l.row_id')}, l.row_id) pos
    from v_line l join v_predictions p on l.row_id = p.row_id where y <> h_a)"""


@query(
    "error_block",
    "v_line v_predictions",
    f"""select 'rewrite' kind, event_type, count(*) n, 'CURRENT DESCRIPTION:' || chr(10) || 'Rules for ' || event_type || chr(10) || chr(10) || {sql_text(W.ERRORS_HEAD)}
       || string_agg('[true clicked=' || y || ', predicted=' || h_a || '] ' || line, chr(10) order by pos) prompt
       from {ERROR_ROWS_SQL} where pos <= 60 group by event_type
       union all select 'notes', event_type, count(*), {sql_text(W.GUIDE_ERRORS_HEAD)}
       || string_agg('[true=' || y || ', predicted=' || h_a || '] ' || line, chr(10) order by pos)
       from {ERROR_ROWS_SQL} where pos <= 60 group by event_type""",
)
def error_block(v: Views):
    preds = v.predictions().select("row_id", "y", F.col("h_a").alias("hard"))
    rows = v.modeling().join(preds, "row_id").withColumn("rules", F.concat(F.lit("Rules for "), "event_type"))
    errors = sampling.error_sample(rows, "y", "hard", DEFAULTS.shown_errors, "row_id", by=["event_type"])
    rewrite = prompts.error_block(errors, FEATURES, ["event_type"], description="rules")
    notes = prompts.error_block(errors, FEATURES, ["event_type"])
    return rewrite.withColumn("kind", F.lit("rewrite")).unionByName(notes.withColumn("kind", F.lit("notes")))


# ---------------------------------------------------------------------------- parsing


@query(
    "parse_digit",
    "v_responses",
    """select row_id, coalesce(nullif(regexp_extract(coalesce(text, ''), '[01]', 0), '')::bigint, 0) as hard from v_responses
       union all select -1 - doc_id, coalesce(nullif(regexp_extract(text, '[01]', 0), '')::bigint, 0) from documents""",
)
def parse_digit(v: Views):
    texts = v.responses().select("row_id", "text")
    docs = v.table("documents").select((-1 - F.col("doc_id")).alias("row_id"), "text")
    return texts.unionByName(docs).select("row_id", responses.parse_digit(F.col("text")).alias("hard"))


@query(
    "parse_answer_first",
    "v_responses",
    """select row_id, coalesce(nullif(regexp_extract(coalesce(text, ''), 'Answer:\\s*([01])', 1), '')::bigint,
       nullif(regexp_extract(coalesce(text, ''), '[01]', 0), '')::bigint, 0) as hard from v_responses""",
)
def parse_answer_first(v: Views):
    return v.responses().select("row_id", responses.parse_answer_first(F.col("text")).alias("hard"))


ANSWERED = """case when streamer_id % 10 = 0 then 'row ' || local || ' is unclear'
    when streamer_id % 10 = 1 then local || '=' || clicked || chr(10) || local || ' = ' || (1 - clicked)
    when streamer_id % 10 = 2 then (local + 50) || '=1' else local || '=' || clicked end"""


def batch_rows(v: Views):
    """Events in numbered batches, and one answer text per batch made from their labels."""
    placed = with_ordinal(v.events().select("row_id", "streamer_id", "clicked"), "row_id", DEFAULTS.seed)
    size = DEFAULTS.prompt_batch
    rows = placed.withColumns({"batch": F.floor(F.col("ordinal") / size), "local": (F.col("ordinal") % size).cast("int")})
    rows = rows.withColumn("line", F.expr(ANSWERED.replace("chr(10)", "char(10)")))
    # ``size`` rows per batch
    answers = rows.groupBy("batch").agg(prompts.joined_lines("local", "line").alias("text"))
    return rows, answers


PARSED_SQL = f"""b as (select row_id, clicked, streamer_id, pos // 50 batch, pos % 50 as local
      from (select *, row_number() over (order by {KEY_SQL}) - 1 pos from v_events)),
    a as (select batch, string_agg({ANSWERED}, chr(10) order by local) as text from b group by batch),
    pairs as (select batch, unnest(regexp_extract_all(text, '(\\d+)\\s*=\\s*([01])', 1)) i,
      unnest(regexp_extract_all(text, '(\\d+)\\s*=\\s*([01])', 2)) val, unnest(range(len(regexp_extract_all(text, '(\\d+)\\s*=\\s*([01])', 1)))) pos from a),
    found as (select batch, i::bigint as local, arg_max(val, pos)::bigint as val from pairs group by all),
    parsed as (select row_id, coalesce(val, 0) as hard, (val is not null)::bigint as parsed
      from b left join found f on b.batch = f.batch and b.local = f.local)"""


@query("parse_batch", "v_events", f", {PARSED_SQL} select * from parsed")
def parse_batch(v: Views):
    rows, answers = batch_rows(v)
    return responses.parse_batch(answers, rows)


@query("unparsed_count", "v_events", f", {PARSED_SQL} select count(*) filter (parsed = 0) as n from parsed")
def unparsed_count(v: Views):
    rows, answers = batch_rows(v)
    return responses.unparsed_count(responses.parse_batch(answers, rows))


@query(
    "prob_from_logprob",
    "v_responses",
    """select row_id, round(coalesce(case when trim(token) = '1' then exp(logprob) when trim(token) = '0' then 1 - exp(logprob) end, 0.5e0), 6) as prob
       from v_responses""",
)
def prob_from_logprob(v: Views):
    return v.responses().select("row_id", responses.prob_from_logprob(F.col("token"), F.col("logprob")).alias("prob"))


MENTIONED = ("data", "the", "user", "de", "la", "user_n", "und", "a", "model", "zzz", "yyy")


@query(
    "parse_ranking",
    "",
    f"""select text_id, feature, row_number() over (partition by text_id order by case when pos = 0 then 1000000000 else pos end, listed) "rank"
       from (select doc_id text_id, feature, listed, instr(text, feature) pos from documents,
       (select unnest({list(MENTIONED)}) feature, unnest(range({len(MENTIONED)})) listed))""",
)
def parse_ranking(v: Views):
    texts = v.table("documents").select(F.col("doc_id").alias("text_id"), "text")
    return responses.parse_ranking(texts, MENTIONED)


@query(
    "parse_ranking_whole_word",
    "v_line",
    """select text_id, feature, row_number() over (partition by text_id order by case when pos = 0 then 1000000000 else pos end, listed) "rank"
       from (select row_id text_id, feature, listed, length(regexp_extract(line, '^(.*?)\\b' || feature || '\\b', 1))
         + case when regexp_matches(line, '\\b' || feature || '\\b') then 1 else 0 end pos
         from v_line, (select unnest(['price', 'device_price', 'age', 'gender', 'value', 'user']) feature, unnest(range(6)) listed))""",
)
def parse_ranking_whole_word(v: Views):
    texts = prompts.serialize(v.modeling(), FEATURES).select(F.col("row_id").alias("text_id"), "text")
    return responses.parse_ranking(texts, ["price", "device_price", "age", "gender", "value", "user"], whole_word=True)


@query(
    "normalize_text",
    "",
    """select doc_id, replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(10), ' ') as one_line,
       case when length(flat) > 400 then substr(flat, 1, 400) || ' ...' else flat end as excerpt
       from (select *, regexp_replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g') flat from documents)""",
)
def normalize_text(v: Views):
    return v.table("documents").select(
        "doc_id",
        C.normalize_text(F.col("text")).alias("one_line"),
        C.normalize_text(F.col("text"), limit=400).alias("excerpt"),
    )
