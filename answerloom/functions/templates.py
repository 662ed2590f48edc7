"""Training-text templates and prompt texts."""

from pyspark.sql import functions as F

from answerloom.functions.text import column_text, py_rstrip

# The literal lines of the training templates.
STANDARD_OPEN = "<bos> Question:"
STANDARD_ANSWER = "<sep> Answer:"
GROUNDED_OPEN = "<bos> Task: Answer the technical question accurately and concisely."
GROUNDED_QUESTION = "Question:"
GROUNDED_REQUIREMENTS = (
    "Answer requirements:\n"
    "1) State likely root cause briefly.\n"
    "2) Provide concrete fix steps.\n"
    "3) Add a minimal example when relevant."
)
GROUNDED_ANSWER = "<sep> Final Answer:"
CLOSE = "<eos>"

# The lines a prompt is grounded with before generation.
PROMPT_REQUIREMENTS = (
    "Answer requirements:\n"
    "1) Root cause in 1-2 lines.\n"
    "2) Concrete fix steps.\n"
    "3) Minimal code/example.\n"
    "4) Keep answer specific to this question only.\n"
    "<sep> Answer:\n"
)
CHAT_REQUIREMENTS = (
    "Response requirements:\n"
    "- Explain root cause first.\n"
    "- Give actionable steps.\n"
    "- Add one concise code/example block when relevant.\n"
    "- Stay specific to the question.\n"
)

STYLES = ("standard", "grounded_qa")


def _line(text, label=""):
    """A template line that disappears (NULL) when its text is empty."""
    return F.when(text != "", F.concat(F.lit(label), text))


TEXTS = ("title", "question_body", "tags", "answer_body")


def broken_text(pairs):
    """Whether a text column of a pair is not valid UTF-8; such rows are skipped and counted by every job."""
    broken = F.lit(False)
    for name in TEXTS:
        if pairs.schema[name].dataType.simpleString() == "string":
            broken = broken | ~F.coalesce(F.is_valid_utf8(F.col(name)), F.lit(True))
    return broken


def _parts(df, max_chars):
    """Title, body, tags and answer as texts, with the share of ``max_chars`` each may use."""
    shares = {"title": 4, "question_body": 2, "tags": 8, "answer_body": 1}
    return {c: (column_text(df, c), None if max_chars is None else max_chars // n) for c, n in shares.items()}


def text_is_cut(df, max_chars=None):
    """Whether ``pair_text`` with this limit leaves out characters of the row."""
    if max_chars is None:
        return F.lit(False)
    cut = F.lit(False)
    for text, limit in _parts(df, max_chars).values():
        cut = cut | (F.char_length(text) > limit)
    return cut


def pair_text(df, max_chars=None, style="standard"):
    """The text of one question/answer pair of ``df`` as a column.

    Texts are whole unless ``max_chars`` is given: then title, question body and
    tags may use a quarter, a half and an eighth of it, the answer all of it
    (``text_is_cut`` tells which rows lose something).
    """
    if style not in STYLES:
        raise ValueError(f"unknown style {style!r}, use one of {STYLES}")
    title, body, tags, answer = (
        text if limit is None else F.substring(text, 1, limit) for text, limit in _parts(df, max_chars).values()
    )
    if style == "grounded_qa":
        lines = [
            F.lit(GROUNDED_OPEN), F.lit(GROUNDED_QUESTION), _line(title, "Title: "),
            _line(body, "Body: "), _line(tags, "Tags: "), F.lit(GROUNDED_REQUIREMENTS),
            F.lit(GROUNDED_ANSWER),
        ]
    else:
        lines = [
            F.lit(STANDARD_OPEN), _line(title), _line(body), _line(tags, "Tags: "),
            F.lit(STANDARD_ANSWER),
        ]
    return F.concat_ws("\n", *lines, answer, F.lit(CLOSE))


def grounded_prompt(prompt):
    """The prompt with answer requirements, in the form that fits its layout."""
    marker = F.lit(STANDARD_ANSWER)
    question = py_rstrip(F.substring_index(prompt, STANDARD_ANSWER, 1))
    return F.when(
        F.contains(prompt, marker), F.concat(question, F.lit("\n" + PROMPT_REQUIREMENTS))
    ).otherwise(F.concat(py_rstrip(prompt), F.lit("\n" + CHAT_REQUIREMENTS)))
