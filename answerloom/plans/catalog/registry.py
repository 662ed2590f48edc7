"""Registry of queries and the SQL forms of the fixture adapters."""

QUERIES, ORACLES = {}, {}


def query(sql=None):
    """Register a ``(spark, sf_dir) -> DataFrame`` function under its own name."""
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn
    return add


FIRST_USER = """fu AS (
  SELECT c.conv_id, c.turn, c.text FROM conversations c
  JOIN (SELECT conv_id, min(turn) AS t FROM conversations WHERE role = 'user' GROUP BY conv_id) m
    ON c.conv_id = m.conv_id AND c.turn = m.t)"""

POSTS = FIRST_USER + """, posts AS (
  SELECT conv_id AS Id, 1 AS PostTypeId, CAST(NULL AS BIGINT) AS ParentId,
         CASE WHEN conv_id % 5 = 0 THEN NULL ELSE substr(text, 1, 60) END AS Title, text AS Body,
         CASE WHEN conv_id % 4 = 0 THEN NULL
              ELSE concat('tag', CAST(conv_id % 7 AS VARCHAR), ', lang') END AS Tags,
         CAST(0 AS INTEGER) AS Score
  FROM fu
  UNION ALL
  SELECT 1000000 + conv_id * 100 + turn, 2, conv_id, NULL, text, NULL,
         CASE WHEN turn = 5 THEN NULL
              ELSE CAST((length(text) * 7 + turn * 3) % 11 - 3 AS INTEGER) END
  FROM conversations WHERE role = 'assistant')"""

PAIRS = POSTS + """, pairs AS (
  SELECT q.Id AS question_id, q.Title AS title, q.Body AS question_body, q.Tags AS tags,
         a.Id AS answer_id, a.Body AS answer_body, a.Score AS answer_score
  FROM posts a JOIN posts q ON a.ParentId = q.Id
  WHERE q.PostTypeId = 1 AND q.Body IS NOT NULL
    AND length(trim(coalesce(q.Title, '')) || trim(q.Body)) >= 10
    AND a.PostTypeId = 2 AND a.Body IS NOT NULL AND length(trim(a.Body)) >= 32)"""

WORDS = "len(regexp_extract_all(coalesce(answer_body, ''), '[A-Za-z0-9_]+'))"
THANKS = (
    "regexp_matches(lower(trim(coalesce(answer_body, ''))), "
    "'^(thanks!?|thank you!?|solved!?|works!?|works now!?|nvm|fixed)$')"
)
BUCKET = "((question_id * 2654435761) % 10000)"
SPLIT = f"CASE WHEN {BUCKET} < 500 THEN 'test' WHEN {BUCKET} < 1500 THEN 'val' ELSE 'train' END"


def quality_sql(score, chars, words, thanks=True):
    rule = (
        f"coalesce(answer_score, 0) >= {score} AND length(coalesce(answer_body, '')) >= {chars} "
        f"AND {WORDS} >= {words}"
    )
    return rule + (f" AND NOT {THANKS}" if thanks else "")


CURATED = PAIRS + f""", curated AS (
  SELECT *, {SPLIT} AS split FROM pairs WHERE {quality_sql(1, 80, 12)})"""

BEST = f"""SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY
      coalesce(answer_score, -1000000) DESC, length(coalesce(answer_body, '')) DESC, answer_id) AS rn
    FROM pairs) WHERE rn = 1"""

SPACE = r"[\s]"


def strip_sql(x):
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def pair_text_sql(max_chars=None, style="standard"):
    """Template text of one pair; chr(10) joins the lines, NULL lines vanish."""
    def cut(column, n):
        whole = strip_sql(f"coalesce({column}, chr(32))")
        return whole if n is None else f"substr({whole}, 1, {n})"

    def line(label, column, n):
        return f"'{label}' || nullif({cut(column, n)}, '')"

    title, body, tags = (
        (c, None if max_chars is None else max_chars // n) for c, n in (("title", 4), ("question_body", 2), ("tags", 8))
    )
    if style == "standard":
        parts = [
            "'<bos> Question:'", line("", *title), line("", *body), line("Tags: ", *tags),
            "'<sep> Answer:'",
        ]
    else:
        parts = [
            "'<bos> Task: Answer the technical question accurately and concisely.'", "'Question:'",
            line("Title: ", *title), line("Body: ", *body), line("Tags: ", *tags),
            "'Answer requirements:'", "'1) State likely root cause briefly.'",
            "'2) Provide concrete fix steps.'", "'3) Add a minimal example when relevant.'",
            "'<sep> Final Answer:'",
        ]
    return f"concat_ws(chr(10), {', '.join(parts)}, {cut('answer_body', max_chars)}, '<eos>')"


RECORDS = FIRST_USER + """, records AS (
  SELECT 1000000 + a.conv_id * 100 + a.turn AS rec_id,
         CASE a.conv_id % 4 WHEN 0 THEN 'so_style' WHEN 1 THEN 'debugging'
                            WHEN 2 THEN 'chat_style' ELSE 'code_help' END AS category,
         q.text AS question,
         concat('<bos> Question:', chr(10), q.text, chr(10), '<sep> Answer:', chr(10)) AS prompt,
         concat(a.text, CASE WHEN a.conv_id % 3 = 0 THEN concat(chr(10), '1. first step') ELSE '' END,
           CASE WHEN a.conv_id % 4 = 3 THEN concat(chr(10), 'def f(): return 1') ELSE '' END,
           CASE WHEN a.conv_id % 6 = 1 THEN concat(chr(10), 'Tags: the following git file file') ELSE '' END,
           CASE WHEN a.conv_id % 10 = 2 THEN ' the following git repo' ELSE '' END) AS output,
         (a.turn % 2 = 1 AND a.conv_id % 5 = 0) AS ended_with_eos
  FROM conversations a JOIN fu q ON a.conv_id = q.conv_id WHERE a.role = 'assistant')"""


def clean_sql(x):
    x = f"replace(replace({x}, 'Ġ', ' '), 'Ċ', chr(10))"
    x = rf"regexp_replace({x}, '[ \t]+', ' ', 'g')"
    x = rf"regexp_replace({x}, '\s+([,.;:!?])', '\1', 'g')"
    x = rf"regexp_replace(regexp_replace({x}, '\(\s+', '(', 'g'), '\s+\)', ')', 'g')"
    return strip_sql(x)


def cut_sql(x, marker):
    full = f"(chr(10) || '{marker}')"
    return f"CASE WHEN contains({x}, {full}) THEN {strip_sql(f'split_part({x}, {full}, 1)')} ELSE {x} END"


def _bounded(words):
    """Whole words by explicit classes: this engine's word boundary knows ASCII only."""
    return rf"(^|[^\p{{L}}\p{{N}}_])({words})([^\p{{L}}\p{{N}}_]|$)"


def scored_sql(records="records", name="scored"):
    """CTEs that score a records table, step by step."""
    kw = "list_distinct(regexp_extract_all(lower({}), '[a-zA-Z_][a-zA-Z0-9_]{{2,}}'))"
    grams = "[array_to_string(lens[i:i+2], ',') FOR i IN range(1, len(lens) - 1)]"
    noise = " + ".join(
        f"CAST(regexp_matches(low, '{p}') AS INTEGER)" for p in (
            _bounded(r"i\s*''\s*m using"), _bounded("the following"), _bounded("file file"),
            _bounded("git"), r"[\p{L}\p{N}_]\.net([^\p{L}\p{N}_]|$)", "`{3}",
        )
    )
    return f"""{name}_1 AS (SELECT *, {clean_sql('output')} AS c1,
      list_transform(string_split(output, ' '), lambda x: CAST(length(x) AS INTEGER)) AS lens FROM {records}),
    {name}_2 AS (SELECT *, {cut_sql('c1', 'Question:')} AS c2 FROM {name}_1),
    {name}_3 AS (SELECT *, {cut_sql('c2', 'User:')} AS c3 FROM {name}_2),
    {name}_4 AS (SELECT *, {cut_sql('c3', 'Tags:')} AS answer FROM {name}_3),
    {name}_5 AS (SELECT *, lower(answer) AS low, {kw.format('prompt')} AS pk, {kw.format('answer')} AS ak,
      {grams} AS grams FROM {name}_4),
    {name}_6 AS (SELECT *, len(list_intersect(pk, ak)) / greatest(1, len(pk)) AS overlap,
      CASE WHEN len(lens) < 3 THEN 0.0
           ELSE 1 - len(list_distinct(grams)) / len(grams) END AS rep,
      regexp_matches(low, '(\\n- |\\n\\d+[\\).]|first|then|finally|step)') AS has_steps,
      contains(answer, '```') OR regexp_matches(answer, '{_bounded("def|import|class|return|SELECT|FROM")}') AS has_code,
      len(list_filter(string_split_regex(answer, '\\s+'), lambda w: w <> '')) AS word_count,
      ({noise}) >= 2 AS template_noise_flag FROM {name}_5),
    {name}_7 AS (SELECT *, CASE WHEN overlap >= 0.15 THEN 2 WHEN overlap >= 0.08 THEN 1 ELSE 0 END AS task_match_0_2,
      CASE WHEN overlap >= 0.20 THEN 2 WHEN overlap >= 0.10 THEN 1 ELSE 0 END AS grounding_0_2,
      CASE WHEN rep < 0.12 THEN 2 WHEN rep < 0.22 THEN 1 ELSE 0 END AS coherence_0_2,
      CASE WHEN has_steps AND word_count >= 40 THEN 2 WHEN has_steps OR has_code THEN 1 ELSE 0 END AS actionability_0_2,
      CASE WHEN has_code AND overlap >= 0.10 THEN 2 WHEN has_code THEN 1 ELSE 0 END AS technicality_0_2
      FROM {name}_6),
    {name} AS (SELECT *, task_match_0_2 + grounding_0_2 + coherence_0_2 + actionability_0_2
      + technicality_0_2 AS auto_total_0_10 FROM {name}_7)"""


SCORED = RECORDS + ", " + scored_sql()


def figures_sql(source, *keys):
    head = "".join(f"{k}, " for k in keys)
    tail = f" GROUP BY {', '.join(keys)}" if keys else ""
    return f"""SELECT {head}count(*) AS num_prompts,
      round_even(coalesce(sum(auto_total_0_10), 0) / greatest(count(*), 1), 4) AS avg_auto_total_0_10,
      round_even(coalesce(sum(CAST(ended_with_eos AS INTEGER)), 0) / greatest(count(*), 1), 4) AS eos_end_rate,
      round_even(coalesce(sum(CAST(template_noise_flag AS INTEGER)), 0) / greatest(count(*), 1), 4) AS template_noise_rate
      FROM {source}{tail}"""
