import pytest
from pyspark.sql import functions as F

from answerloom import schemas
from answerloom.operators import curate as cur, pairs as pr

LONG = "a sufficiently long answer body with plenty of words in it"


def _posts(spark, rows):
    schema = "Id long, PostTypeId int, ParentId long, Title string, Body string, Tags string, Score int"
    return spark.createDataFrame(rows, schema)


def test_join_keeps_fanout_and_drops_orphans(spark):
    posts = _posts(spark, [
        (1, 1, None, "title", "question body", "t", 0), (1, 1, None, "again", "question body", None, 0),
        (2, 1, None, None, "short", None, 0), (3, 1, None, "x", None, None, 0),
        (10, 2, 1, None, LONG, None, 1), (11, 2, 99, None, LONG, None, 1), (12, 2, None, None, LONG, None, 1),
        (13, 2, 1, None, "\xa0" * 40, None, 1), (14, 2, 2, None, LONG, None, 1), (15, 2, 3, None, LONG, None, 1),
    ])
    got = sorted((r.question_id, r.title, r.answer_id) for r in pr.pair_posts(posts).collect())
    assert got == [(1, "again", 10), (1, "title", 10)]
    schemas.require_columns(pr.pair_posts(posts), schemas.pairs_schema(), "pairs")


def test_hot_question_is_spread_and_complete(spark):
    """A third of all answers belong to one question; no join task gets them all."""
    rows = spark.range(30_000).select(
        (F.col("id") + 1_000_000).alias("Id"), F.lit(2).alias("PostTypeId"),
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 1000 + 100).cast("long").alias("ParentId"),
        F.lit(None).cast("string").alias("Title"), F.lit(LONG).alias("Body"),
        F.lit(None).cast("string").alias("Tags"), F.lit(1).alias("Score"),
    )
    asked = rows.select("ParentId").distinct().select(
        F.col("ParentId").alias("Id"), F.lit(1).alias("PostTypeId"), F.lit(None).cast("long").alias("ParentId"),
        F.lit("title").alias("Title"), F.lit("question body").alias("Body"),
        F.lit(None).cast("string").alias("Tags"), F.lit(0).alias("Score"),
    )
    posts = asked.unionByName(rows)
    assert {tuple(r) for r in pr.hot_parents(posts, 500).collect()} == {(7, 20)}
    pairs = pr.pair_posts(posts, share=500)
    assert pairs.count() == 30_000
    assert pairs.select("answer_id").distinct().count() == 30_000
    best = cur.best_answer(pairs)
    assert best.where("question_id = 7").first()["answer_id"] == 1_000_000


def _pairs(spark, rows):
    return spark.createDataFrame(
        rows, "question_id long, answer_id long, answer_body string, answer_score int"
    )


@pytest.mark.parametrize("body,dropped", [
    ("thanks", True), ("Thanks!", True), ("thanks\n", False), (" solved ", True), ("works now!", True),
    ("\xa0NVM\xa0", True), ("thanks a lot", False), ("fixed", True), (None, False),
])
def test_short_thanks(spark, body, dropped):
    df = _pairs(spark, [(1, 1, body, 1)])
    assert df.select(cur.is_short_thanks()).first()[0] is dropped


def test_word_rule_counts_ascii_runs(spark):
    df = _pairs(spark, [(1, 1, "a_1-b  ...c é d", 1), (1, 2, "...", 1), (1, 3, None, 1)])
    assert [r[0] for r in df.select(cur.min_words(4)).collect()] == [True, False, False]


def test_null_scores_count_as_zero_but_rank_last(spark):
    df = _pairs(spark, [(1, 1, "long body", None), (1, 2, "x", -5), (2, 3, "same", 1), (2, 4, "same", 1),
                        (3, 5, "ab", 2), (3, 6, "abc", 2)])
    assert sorted(r.answer_id for r in cur.best_answer(df).collect()) == [2, 3, 6]
    assert [r[0] for r in df.select(cur.min_score(0)).collect()][0] is True


def test_best_answer_runs_before_quality(spark):
    df = _pairs(spark, [(1, 1, "bad", 9), (1, 2, LONG, 5)])
    assert cur.curate(df, best_only=True).count() == 0
    assert cur.curate(df).count() == 1


def test_best_answer_limits_groups_before_the_shuffle(spark, tmp_path):
    _pairs(spark, [(1, 1, "a", 1)]).write.parquet(str(tmp_path / "p"))
    plan = cur.best_answer(spark.read.parquet(str(tmp_path / "p")))._jdf.queryExecution().toString()
    assert "row_number(), 1, Partial" in plan


def test_split_drops_null_ids(spark):
    df = _pairs(spark, [(None, 1, LONG, 1), (0, 2, LONG, 1)])
    assert [r.split for r in cur.split_pairs(df).collect()] == ["test"]
