"""Declared schemas of every table the library reads or writes."""

from pyspark.sql import types as T


def _struct(*fields):
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields])


LONG, INT, STRING, DOUBLE, BOOL = (
    T.LongType(), T.IntegerType(), T.StringType(), T.DoubleType(), T.BooleanType(),
)


def posts_schema(tags=T.ArrayType(STRING)):
    """Raw posts. The type of ``Tags`` differs between dumps, so it is a parameter."""
    return _struct(
        ("Id", LONG), ("PostTypeId", INT), ("ParentId", LONG), ("Title", STRING),
        ("Body", STRING), ("Tags", tags), ("Score", INT),
    )


def pairs_schema(tags=STRING):
    return _struct(
        ("question_id", LONG), ("title", STRING), ("question_body", STRING), ("tags", tags),
        ("answer_id", LONG), ("answer_body", STRING), ("answer_score", INT),
    )


PAIR_COLUMNS = pairs_schema().fieldNames()

TOKEN_ROWS = T.StructType([
    T.StructField("question_id", LONG, True),
    T.StructField("answer_id", LONG, True),
    T.StructField("input_ids", T.ArrayType(INT, False), False),
    T.StructField("split", STRING, True),
    T.StructField("n_tokens", INT, True),
    T.StructField("truncated", BOOL, True),
    T.StructField("text_cut", BOOL, True),
])

VOCAB = _struct(("token", STRING), ("id", INT))
MERGES = _struct(("rank", INT), ("left", STRING), ("right", STRING))

METRICS = _struct(
    ("run_id", STRING), ("step", LONG), ("train_loss", DOUBLE), ("train_ppl", DOUBLE), ("lr", DOUBLE),
    ("val_loss", DOUBLE), ("val_ppl", DOUBLE),
)

PROMPTS = _struct(("category", STRING), ("prompt", STRING))

SIGNALS = _struct(
    ("prompt_keyword_overlap_ratio", DOUBLE), ("trigram_repetition_ratio", DOUBLE),
    ("has_steps", BOOL), ("has_code_like_tokens", BOOL), ("word_count", INT),
)

AUTO_SCORES = _struct(
    ("task_match_0_2", INT), ("grounding_0_2", INT), ("coherence_0_2", INT),
    ("actionability_0_2", INT), ("technicality_0_2", INT), ("auto_total_0_10", INT),
    ("signals", SIGNALS),
)

MANUAL_TEMPLATE = _struct(
    ("task_match_0_2", INT), ("technical_correctness_0_2", INT), ("actionability_0_2", INT),
    ("coherence_0_2", INT), ("grounding_0_2", INT), ("notes", STRING),
)

EVAL_RECORD = _struct(
    ("category", STRING), ("prompt", STRING), ("prompt_used_for_generation", STRING),
    ("generated_text_full", STRING), ("generated_answer_only", STRING),
    ("prompt_tokens", INT), ("generated_tokens", INT), ("ended_with_eos", BOOL),
    ("template_noise_flag", BOOL), ("auto_scores", AUTO_SCORES),
    ("manual_score_template", MANUAL_TEMPLATE),
)


def require_columns(df, schema, what):
    """Fail at plan time when a declared column is missing or has another type."""
    have = {f.name: f.dataType for f in df.schema.fields}
    problems = []
    for f in schema.fields:
        if f.name not in have:
            problems.append(f"missing {f.name}")
        elif have[f.name].simpleString() != f.dataType.simpleString():
            problems.append(
                f"{f.name} is {have[f.name].simpleString()}, expected {f.dataType.simpleString()}"
            )
    if problems:
        raise ValueError(f"{what}: " + "; ".join(problems))
    return df
