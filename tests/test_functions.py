"""Edge rows for text, split, template and id-array columns."""

import pytest
from pyspark.sql import functions as F, types as T

from answerloom.functions import ids, rubric, splits, templates, text as tx

SPACES = [chr(c) for c in (
    *range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029,
    0x202F, 0x205F, 0x3000,
)]


def test_strip_matches_python_on_all_blanks(spark):
    values = [a + "x" + b + "y" + a for a in SPACES for b in SPACES[:3]]
    values += ["", "   ", "\x1c\x1c", "".join(SPACES), "a" + " " * 5000 + "b", "\u200bx\u200b"]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select(
        "v", tx.py_strip(F.col("v")), tx.py_rstrip(F.col("v")), F.array_join(tx.py_words(F.col("v")), "|")
    ).collect()
    for v, stripped, right, words in rows:
        assert stripped == v.strip()
        assert right == v.rstrip()
        assert words == "|".join(v.split())


def test_sql_trim_strips_space_separators_only(one):
    assert one(tx.sql_trim(F.col("v")), v="\xa0 x\n ") == "x\n"
    assert one(tx.sql_trim(F.col("v")), v="\t x　") == "\t x"


def test_to_text_by_type(spark):
    df = spark.createDataFrame(
        [(
            " a ", b"a\xffb", [" x", "", None, "y "], {"k": "v", "e": " "}, [["p", ""], ["q"]],
            True, 5,
        ), (None,) * 7],
        "s string, b binary, l array<string>, m map<string,string>, n array<array<string>>, "
        "t boolean, i int",
    )
    rows = df.select(*[tx.column_text(df, c).alias(c) for c in df.columns]).collect()
    assert tuple(rows[0]) == ("a", "a�b", "x, y", "k: v", "p, q", "True", "5")
    assert tuple(rows[1]) == ("",) * 7


def test_to_text_cuts_after_strip_by_code_points(one):
    assert one(tx.to_text(F.col("v"), T.StringType(), 3), v="  \U0001f600bcd ") == "\U0001f600bc"
    assert len(one(tx.to_text(F.col("v"), T.StringType(), 12_000), v="z" * 13_000)) == 12_000


def test_sample_lines_break_at_carriage_returns(one):
    assert one(tx.sample_lines(F.col("v")), v=" a\nb\r\n c\rd ") == ["a b", "c", "d"]


def test_buckets_and_policies(spark):
    ids_ = [0, 1, 10_000, 3_500_000_000, 9_223_372_036_854_775_807, None]
    df = spark.createDataFrame([(i,) for i in ids_], "q long")
    q = F.col("q")
    for i, b, three, two in df.select(
        "q", splits.bucket(q), splits.three_way(q), splits.two_way(q, 0.01)
    ).collect():
        if i is None:
            assert (b, three, two) == (None, None, "train")
            continue
        want = (i * 2654435761) % 10_000
        assert b == want
        assert three == ("test" if want < 500 else "val" if want < 1500 else "train")
        assert two == ("val" if want < 100 else "train")


def test_text_ids_that_are_no_numbers_are_train(one):
    assert one(splits.is_val(F.col("v"), 0.5), v="abc") is False
    assert one(splits.is_val(F.col("v"), 0.5), v="10000") is True


def test_fraction_guards_and_truncation():
    assert splits.thresholds(0.07, 0) == (int(0.07 * 10_000), 0)
    for val, test in ((0, 0.1), (-0.1, 0), (0.1, -0.1), (0.6, 0.4)):
        with pytest.raises(ValueError):
            splits.thresholds(val, test)


def test_templates(spark):
    df = spark.createDataFrame(
        [("T", "B", ["x", "y"], "A"), (None, " ", None, None), ("t" * 50, "b" * 50, ["g" * 50], "a" * 50)],
        "title string, question_body string, tags array<string>, answer_body string",
    )
    a, b, c = [r[0] for r in df.select(templates.pair_text(df, 40)).collect()]
    assert a == "<bos> Question:\nT\nB\nTags: x, y\n<sep> Answer:\nA\n<eos>"
    assert b == "<bos> Question:\n<sep> Answer:\n\n<eos>"
    assert c == f"<bos> Question:\n{'t' * 10}\n{'b' * 20}\nTags: {'g' * 5}\n<sep> Answer:\n{'a' * 40}\n<eos>"
    g = df.select(templates.pair_text(df, 40, "grounded_qa")).first()[0]
    assert g.splitlines()[1:5] == ["Question:", "Title: T", "Body: B", "Tags: x, y"]
    assert g.splitlines()[-3:] == ["<sep> Final Answer:", "A", "<eos>"]
    with pytest.raises(ValueError):
        templates.pair_text(df, 40, "other")


def test_grounded_prompt_keeps_text_before_first_marker(one):
    out = one(templates.grounded_prompt(F.col("p")), p="Q \n<sep> Answer:\nx<sep> Answer:\n")
    assert out == "Q\n" + templates.PROMPT_REQUIREMENTS
    assert one(templates.grounded_prompt(F.col("p")), p="User: hi \n") == (
        "User: hi\n" + templates.CHAT_REQUIREMENTS
    )


@pytest.mark.parametrize("n", [0, 1, 3, 4, 9])
def test_id_arrays(spark, n):
    row = [list(range(1, n + 1))]
    df = spark.createDataFrame([row], "v array<int>")
    v = F.col("v")
    right, left, labels, eff = df.select(
        ids.pad_right(v, 4), ids.context_window(v, 4), ids.next_token_labels(v), ids.effective_tokens(v)
    ).first()
    full = list(range(1, n + 1))
    assert right == (full[:4] + [0] * 4)[:4]
    assert left == ([0] * 4 + full)[-4:]
    assert labels == full[1:]
    assert eff == max(n - 1, 0)


@pytest.mark.parametrize("v,want", [([], 0.0), ([1, 2], 0.0), ([1, 2, 3], 0.0), ([7] * 5, 1 - 1 / 3),
                                    ([1, 2, 3, 1, 2, 3], 0.25)])
def test_repetition_ratio(spark, v, want):
    df = spark.createDataFrame([[v]], "v array<int>")
    assert df.select(ids.repetition_ratio(F.col("v"))).first()[0] == pytest.approx(want)


def test_ends_with(spark):
    df = spark.createDataFrame([[[1, 3]], [[3, 1]], [[]]], "v array<int>")
    assert [r[0] for r in df.select(ids.ends_with(F.col("v"), 3)).collect()] == [True, False, False]


def test_clean_generated(one):
    raw = " aĠb\t c Ċ\n, d ( x\n ) !\x1c? e"
    assert one(rubric.clean_generated(F.col("v")), v=raw) == "a b c, d (x)!? e"


def test_markers_are_cut_in_their_order(spark):
    texts = [" x \nUser: u\nQuestion: q", "keep \n", "\nUser: u \nQuestion: q", "a\nTags: t"]
    df = spark.createDataFrame([(t,) for t in texts], "answer string")
    got = [r[0] for r in rubric.cut_at_markers(df, "answer").collect()]
    assert got == ["x", "keep \n", "User: u", "a"]


def test_score_rules(spark):
    """Hand-graded records."""
    rows = [
        ("fix the pandas column error", "First, check the pandas column. " + "word " * 40, [1, 2, 3, 4]),
        ("fix the pandas column error", "import os", [5] * 9),
        ("nothing shared here", "plain words", [1, 2, 3, 1, 2, 3, 4, 5]),
        ("", "", []),
    ]
    df = spark.createDataFrame(rows, "prompt string, answer string, out_ids array<int>")
    out = rubric.grade_columns(rubric.signal_columns(df))
    graded = [tuple(r) for r in out.select(
        "task_match_0_2", "grounding_0_2", "coherence_0_2", "actionability_0_2", "technicality_0_2",
        "auto_total_0_10", "word_count",
    ).collect()]
    assert graded == [
        (2, 2, 2, 2, 0, 8, 45), (0, 0, 0, 1, 1, 2, 2), (0, 0, 1, 0, 0, 1, 2), (0, 0, 2, 0, 0, 2, 0),
    ]


def test_template_noise_needs_two_patterns(spark):
    texts = ["the following git repo", "a git repo", "digital .net", "asp.net and `` ```", "I ' m using git"]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    flags = [r[0] for r in df.select(rubric.is_template_noise(F.col("v"))).collect()]
    assert flags == [True, False, False, True, True]


def test_code_words_need_word_boundaries(spark):
    df = spark.createDataFrame([("éimport",), ("import x",), ("select from",), ("SELECT 1",)], "v string")
    assert [r[0] for r in df.select(rubric.has_code(F.col("v"))).collect()] == [False, True, False, True]
