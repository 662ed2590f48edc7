import shutil

import pytest
from pyspark.sql import functions as F

from answerloom.operators import pairs as pr, tokenizer as tk
from answerloom.plans import fixtures as fx
from answerloom.streaming import incremental as inc
from conftest import SF


@pytest.fixture(scope="module")
def pairs(spark):
    return pr.pair_posts(fx.posts(spark, SF)).cache()


@pytest.fixture(scope="module")
def model(pairs):
    return tk.learn_bpe(tk.pretoken_counts(tk.two_way_sample(pairs, 1000)), 200)


def _rows(df):
    return sorted((r.question_id, r.answer_id, r.split, tuple(r.input_ids)) for r in df.collect())


def test_stream_equals_batch_and_takes_only_new_files(spark, pairs, model, tmp_path):
    src, late, out, state = (str(tmp_path / n) for n in ("in", "late", "out", "state"))
    pairs.where("question_id % 2 = 0").repartition(2).write.parquet(src)

    def run():
        return inc.observed_totals(spark, lambda: inc.tokenize_stream(
            inc.pair_stream(spark, src, 1, pairs.schema), model, out, state, 64, val_fraction=0.2
        ))

    first = run()
    assert first["train"] + first["val"] == pairs.where("question_id % 2 = 0").count()
    pairs.where("question_id % 2 = 1").coalesce(1).write.parquet(late)
    for f in (tmp_path / "late").glob("part-*.parquet"):
        shutil.copy(f, src)
    second = run()
    assert second["train"] + second["val"] == pairs.where("question_id % 2 = 1").count()
    batch = inc.tokenized(pairs, model, 64, val_fraction=0.2)
    assert _rows(spark.read.parquet(out)) == _rows(batch)


def test_broken_rows_are_skipped_and_counted(spark, pairs, model):
    broken = pairs.withColumn(
        "answer_body", F.when(F.col("question_id") == pairs.first().question_id, F.unhex(F.lit("61FF")).cast("string"))
        .otherwise(F.col("answer_body"))
    )
    bad = broken.where(~F.is_valid_utf8("answer_body")).count()
    counts = inc.status_counts(inc.route(broken)).first()
    assert bad > 0 and counts.skipped == bad
    assert counts.train + counts.val + counts.skipped == pairs.count()
    assert inc.tokenized(broken, model, 32).count() == pairs.count() - bad


def test_totals_are_whole_beyond_the_kept_reports(spark, pairs, model, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    pairs.repartition(6).write.parquet(src)
    kept = spark.conf.get("spark.sql.streaming.numRecentProgressUpdates")
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "2")
    try:
        totals = inc.observed_totals(spark, lambda: inc.tokenize_stream(
            inc.pair_stream(spark, src, 1, pairs.schema), model, out, state, 64))
    finally:
        spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", kept)
    assert sum(totals.values()) == pairs.count()
