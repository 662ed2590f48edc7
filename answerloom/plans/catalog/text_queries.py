"""Text coercion, templates, id arrays and prompt texts."""

from pyspark.sql import functions as F

from answerloom.functions import ids as idf, rubric, templates, text as tx
from answerloom.operators.training_metrics import token_totals
from answerloom.plans import fixtures as fx
from answerloom.plans.catalog.pair_queries import _curated, _pairs
from answerloom.plans.catalog.registry import (
    CURATED, PAIRS, RECORDS, clean_sql, cut_sql, pair_text_sql, query, strip_sql,
)


@query(f"""WITH {PAIRS}, src AS (
  SELECT answer_id, answer_body, title, string_split(coalesce(tags, ''), ', ') AS parts FROM pairs)
SELECT answer_id, {strip_sql('answer_body')} AS plain, coalesce(substr({strip_sql('title')}, 1, 20), '') AS short,
  {strip_sql('answer_body')} AS from_bytes,
  array_to_string(list_filter(list_transform(parts, lambda p: {strip_sql('p')}), lambda p: p <> ''), ', ') AS from_array,
  concat_ws(', ', 'id: ' || CAST(answer_id AS VARCHAR),
    'title: ' || nullif({strip_sql("coalesce(title, '')")}, '')) AS from_map,
  CAST(answer_id AS VARCHAR) AS from_number FROM src""")
def to_text(spark, d):
    """Coercion of strings, bytes, arrays, maps and numbers."""
    src = _pairs(spark, d).select(
        "answer_id", "answer_body", "title",
        F.encode("answer_body", "UTF-8").alias("raw"),
        F.split(F.coalesce("tags", F.lit("")), ", ").alias("parts"),
        F.create_map(
            F.lit("id"), F.col("answer_id").cast("string"), F.lit("title"), F.col("title")
        ).alias("attrs"),
    )
    return src.select(
        "answer_id", tx.column_text(src, "answer_body").alias("plain"),
        tx.column_text(src, "title", 20).alias("short"),
        tx.column_text(src, "raw").alias("from_bytes"),
        tx.column_text(src, "parts").alias("from_array"),
        tx.column_text(src, "attrs").alias("from_map"),
        tx.column_text(src, "answer_id").alias("from_number"),
    )


@query(f"WITH {CURATED} SELECT question_id, answer_id, split, {pair_text_sql()} AS text FROM curated")
def standard_text(spark, d):
    rows = _curated(spark, d)
    return rows.select("question_id", "answer_id", "split", templates.pair_text(rows).alias("text"))


@query(f"""WITH {CURATED} SELECT question_id, answer_id, split,
{pair_text_sql(400, 'grounded_qa')} AS text FROM curated""")
def grounded_text(spark, d):
    """The grounded style with a small character budget, so that every cap cuts."""
    rows = _curated(spark, d)
    return rows.select(
        "question_id", "answer_id", "split",
        templates.pair_text(rows, 400, "grounded_qa").alias("text"),
    )


@query(f"""SELECT conv_id, turn, {strip_sql("replace(text, chr(10), ' ')")} AS line,
array_to_string(list_transform(string_split(replace(text, chr(10), ' '), chr(13)),
  lambda l: {strip_sql('l')}), '|') AS lines FROM conversations""")
def flatten_lines(spark, d):
    conv = fx.table(spark, d, "conversations")
    return conv.select(
        "conv_id", "turn", tx.flatten_lines(F.col("text")).alias("line"),
        F.array_join(tx.sample_lines(F.col("text")), "|").alias("lines"),
    )


_LENS = """lens AS (SELECT conv_id, turn,
  list_transform(string_split(text, ' '), lambda w: CAST(length(w) AS INTEGER)) AS ids FROM conversations)"""


def _lens(spark, d):
    return fx.table(spark, d, "conversations").select(
        "conv_id", "turn", F.transform(F.split("text", " "), F.length).alias("ids")
    )


def _joined(column):
    return F.array_join(column.cast("array<string>"), " ")


@query(f"""WITH {_LENS} SELECT conv_id, turn,
array_to_string(list_concat(ids[1:48], list_transform(range(greatest(48 - len(ids), 0)), lambda i: 0)), ' ') AS padded,
array_to_string(list_concat(list_transform(range(greatest(16 - len(ids), 0)), lambda i: 0),
  ids[greatest(1, len(ids) - 15):len(ids)]), ' ') AS context FROM lens""")
def pad_and_context(spark, d):
    """Right-padded rows of 48 ids and left-padded contexts of the last 16."""
    ids = F.col("ids")
    return _lens(spark, d).select(
        "conv_id", "turn", _joined(idf.pad_right(ids, 48)).alias("padded"),
        _joined(idf.context_window(ids, 16)).alias("context"),
    )


@query(f"""WITH {_LENS}, rows AS (SELECT conv_id, turn, list_concat(ids, [0, 0, 0]) AS ids FROM lens)
SELECT conv_id, turn, array_to_string(ids[2:], ' ') AS labels,
array_to_string(list_transform(ids[2:], lambda x: CAST(x <> 0 AS INTEGER)), ' ') AS mask,
CAST(len(list_filter(ids[2:], lambda x: x <> 0)) AS INTEGER) AS tokens FROM rows""")
def labels_and_mask(spark, d):
    """Whole arrays with three pads behind them."""
    rows = _lens(spark, d).withColumn("ids", F.concat("ids", F.array_repeat(F.lit(0), 3)))
    labels = idf.next_token_labels(F.col("ids"))
    return rows.select(
        "conv_id", "turn", _joined(labels).alias("labels"),
        _joined(idf.label_mask(labels)).alias("mask"),
        idf.effective_tokens(F.col("ids")).alias("tokens"),
    )


@query(f"""WITH {_LENS}, rows AS (SELECT conv_id % 3 AS part, list_concat(ids, [0, 0, 0]) AS ids FROM lens)
SELECT part, count(*) AS rows, CAST(sum(len(list_filter(ids[2:], lambda x: x <> 0))) AS BIGINT) AS tokens
FROM rows GROUP BY part""")
def effective_tokens(spark, d):
    rows = _lens(spark, d).select(
        (F.col("conv_id") % 3).alias("part"), F.concat("ids", F.array_repeat(F.lit(0), 3)).alias("input_ids")
    )
    return token_totals(rows, "part")


@query(f"""WITH {_LENS} SELECT conv_id, turn, round(CASE WHEN len(ids) < 3 THEN 0.0 ELSE
1 - len(list_distinct([array_to_string(ids[i:i+2], ',') FOR i IN range(1, len(ids) - 1)])) / (len(ids) - 2) END, 6)
AS repetition, coalesce(ids[-1] = 4, false) AS ends_with_4, CAST(len(ids) AS INTEGER) AS n_ids FROM lens""")
def id_array_flags(spark, d):
    """Trigram repetition, last id, and id counts of the word-length arrays."""
    ids = F.col("ids")
    return _lens(spark, d).select(
        "conv_id", "turn", F.round(idf.repetition_ratio(ids), 6).alias("repetition"),
        idf.ends_with(ids, 4).alias("ends_with_4"), F.size(ids).alias("n_ids"),
    )


_RAW = r"replace(replace(html, '<', ' Ġ( '), '>', ' ) Ċ .')"


@query(f"SELECT page_id, {clean_sql(_RAW)} AS cleaned FROM pages")
def clean_generated(spark, d):
    """Clean-up of byte-level markers over whole pages, with markers put in."""
    raw = F.replace(
        F.replace(F.col("html"), F.lit("<"), F.lit(" Ġ( ")), F.lit(">"), F.lit(" ) Ċ .")
    )
    return fx.text_table(spark, d, "pages").select("page_id", rubric.clean_generated(raw).alias("cleaned"))


def _rstrip_sql(x):
    return rf"regexp_replace({x}, '\s+$', '')"


_PROMPTS = """prompts AS (SELECT rec_id, CASE WHEN rec_id % 3 = 0
  THEN concat('<bos> User:', chr(10), question, chr(10), 'Assistant:', chr(10)) ELSE prompt END AS prompt FROM records)"""


def _lines_sql(text):
    return " || chr(10) || ".join("'" + t + "'" for t in text.split("\n"))


@query(f"""WITH {RECORDS}, {_PROMPTS} SELECT rec_id, CASE WHEN contains(prompt, '<sep> Answer:')
THEN {_rstrip_sql("split_part(prompt, '<sep> Answer:', 1)")} || chr(10) || {_lines_sql(templates.PROMPT_REQUIREMENTS)}
ELSE {_rstrip_sql('prompt')} || chr(10) || {_lines_sql(templates.CHAT_REQUIREMENTS)} END AS grounded FROM prompts""")
def ground_prompt(spark, d):
    """Question prompts and, for every third record, chat prompts."""
    chat = F.regexp_replace(
        F.regexp_replace("prompt", r"\A<bos> Question:\n", "<bos> User:\n"),
        r"\n<sep> Answer:\n\z", "\nAssistant:\n",
    )
    prompt = F.when(F.col("rec_id") % 3 == 0, chat).otherwise(F.col("prompt"))
    return fx.eval_records(spark, d).select("rec_id", templates.grounded_prompt(prompt).alias("grounded"))


@query(f"""WITH {RECORDS}, marked AS (SELECT rec_id, output || chr(10) || 'User: x' ||
  CASE WHEN rec_id % 2 = 0 THEN chr(10) || 'Question: y' ELSE '' END AS m FROM records),
q AS (SELECT rec_id, {cut_sql('m', 'Question:')} AS a FROM marked),
u AS (SELECT rec_id, {cut_sql('a', 'User:')} AS b FROM q)
SELECT rec_id, {cut_sql('b', 'Tags:')} AS answer FROM u""")
def cut_at_markers(spark, d):
    marked = F.concat(
        "output", F.lit("\nUser: x"), F.when(F.col("rec_id") % 2 == 0, "\nQuestion: y").otherwise("")
    )
    records = fx.eval_records(spark, d).select("rec_id", marked.alias("answer"))
    return rubric.cut_at_markers(records, "answer")
