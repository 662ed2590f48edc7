"""Cases that earlier versions got wrong."""

import math
from dataclasses import replace

import pytest
from pyspark.sql import Row, functions as F, types as T

from answerloom.functions import text as tx
from answerloom.operators import batches as bt, evaluation as ev, retrieval as rt
from answerloom.operators.sampling import first_rows, keyed_sample
from answerloom.plans import fixtures as fx
from answerloom.plans.corpus_job import PRESETS, run_job
from answerloom.functions.templates import pair_text, text_is_cut
from conftest import SF


def test_report_ratios_round_half_to_even(spark):
    rows = [(int(i == 0), i == 0, False) for i in range(32)]
    scored = spark.createDataFrame(rows, "auto_total_0_10 int, ended_with_eos boolean, template_noise_flag boolean")
    r = ev.report_figures(scored).first()
    assert r.avg_auto_total_0_10 == r.eos_end_rate == round(1 / 32, 4) == 0.0312


def test_structs_become_labelled_text(spark):
    schema = T.StructType([
        T.StructField("a", T.StringType()), T.StructField("b", T.LongType()),
        T.StructField("c", T.StructType([T.StructField("d", T.DoubleType())])), T.StructField("e", T.ArrayType(T.StringType()))])
    df = spark.createDataFrame([(("x", None, (1.5,), ["p", ""]),), ((None, None, None, None),), (None,)], T.StructType([T.StructField("s", schema)]))
    got = [r.t for r in df.select(tx.column_text(df, "s").alias("t")).collect()]
    assert got == ["a: x, c: d: 1.5, e: p", "", ""]


def test_doubles_print_as_in_python(spark):
    values = [0.0, -0.0, 1.0, 1e10, 123456789.125, 1e15, 1e16, 1.5e300, 1e-4, 1.25e-4, 9.9e-5, -2.5e-7, 0.1, 1 / 3, 100.0, math.inf, -math.inf, math.nan, 123456789012345.6]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r.t for r in df.select(tx.column_text(df, "v").alias("t")).collect()] == [str(v) for v in values]


def test_sample_is_exact_with_repeated_and_missing_keys(spark):
    rows = [(i // 7 if i % 5 else None, i % 3) for i in range(200)]
    df = spark.createDataFrame(rows, "k long, v long")
    for n in (1, 10, 57, 199, 200, 500):
        got = sorted(map(str, keyed_sample(df.repartition(5), n, "k").collect()))
        assert len(got) == min(n, 200) and got == sorted(map(str, keyed_sample(df, n, "k").collect()))


def test_row_cap_reads_folders_with_blanks(spark, tmp_path):
    path = str(tmp_path / "a folder %20 ü")
    spark.range(20).coalesce(1).write.parquet(path)
    assert sorted(r.id for r in first_rows(spark, [path], 7).collect()) == list(range(7))


def test_epochs_do_not_multiply_the_payload(spark):
    rows = spark.createDataFrame([("f", i, "payload") for i in range(64)], "file string, row_index long, body string")
    out = bt.plan_batches(rows, 8, epochs=3, min_row_batch=16, multiplier=1)
    lines = out._jdf.queryExecution().optimizedPlan().toString().split("\n")
    epochs = [i for i, line in enumerate(lines) if "Generate explode" in line and "[epoch#" in line]
    assert epochs and all("body" not in lines[i] + lines[i + 1] for i in epochs), lines
    assert out.count() == 192
    few = bt.plan_batches(rows, 8, epochs=2, min_row_batch=16, multiplier=1, first=3)
    assert {(r.epoch, r.batch_id) for r in few.collect()} == {(e, b) for e in range(2) for b in range(3)}


def test_search_with_no_queries_null_vectors_and_string_keys(spark):
    corpus = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", None)], "vec_id string, vector array<double>")
    queries = spark.createDataFrame([("q", [1.0, 0.1]), ("n", None)], "query_id string, vector array<double>")
    planes = rt.cell_planes(2, 1)
    celled = rt.with_cell(corpus, planes)
    for search in (lambda q: rt.top_k(q, corpus, k=2), lambda q: rt.top_k_in_cells(q, celled, planes, k=2)):
        got = search(queries)
        assert [(r.query_id, r.vec_id, r["rank"]) for r in got.orderBy("rank").collect()] == [("q", "a", 1), ("q", "b", 2)]
        assert search(queries.limit(0)).count() == 0 and search(queries.where("vector IS NULL")).columns == got.columns
    assert rt.top_k(queries, corpus.limit(0)).count() == 0


def test_changed_knobs_and_inputs_rebuild_stages(spark, tmp_path):
    out, posts = str(tmp_path / "job"), fx.posts(spark, SF)
    config = replace(PRESETS["fast"], vocab_size=200, max_seq_len=32, rows_per_file=5)
    at = run_job(spark, posts, out, config)
    ids = lambda: sorted(str(r.input_ids) for r in spark.read.parquet(at["tokens"]).collect())
    before = ids()
    run_job(spark, posts, out, config)
    assert ids() == before
    other = replace(config, prompt_style="grounded_qa", max_text_chars=60)
    with pytest.raises(ValueError):
        run_job(spark, posts, out, other, skip=("tokenizer",))
    run_job(spark, posts, out, other)
    assert ids() != before
    record = spark.read.json(at["manifest"]).first()
    assert record.prompt_style == "grounded_qa" and sum(record.text_cut.asDict().values()) > 0
    rows = spark.read.parquet(at["tokens"])
    assert sum(record.truncated.asDict().values()) == rows.where("truncated").count() > 0
    run_job(spark, posts.where("Id % 2 = 0 OR PostTypeId = 2"), out, other)
    assert spark.read.parquet(at["pairs"]).where("question_id % 2 = 1").count() == 0


def test_batch_job_skips_and_counts_broken_rows(spark, tmp_path):
    posts = fx.posts(spark, SF)
    bad = F.concat(F.encode("Body", "UTF-8"), F.unhex(F.lit("FF"))).cast("string")
    posts = posts.withColumn("Body", F.when((F.col("PostTypeId") == 2) & (F.col("ParentId") % 3 == 0), bad).otherwise(F.col("Body")))
    config = replace(PRESETS["fast"], vocab_size=200, max_seq_len=32, rows_per_file=50)
    at = run_job(spark, posts, str(tmp_path / "job"), config)
    record = spark.read.json(at["manifest"]).first()
    want = spark.read.parquet(at["split"]).where("question_id % 3 = 0").count()
    assert sum(record.skipped.asDict().values()) == want > 0
    assert spark.read.parquet(at["tokens"]).where("question_id % 3 = 0").count() == 0


def test_evaluation_counts_real_token_ids(spark, tmp_path):
    from answerloom.operators import tokenizer as tk
    from answerloom.plans.evaluation_job import evaluate
    from answerloom.sources import reports

    lines = spark.createDataFrame([("the answer is the answer and the end",)] * 5, "line string")
    model = tk.learn_bpe(tk.pretoken_counts(lines), 60)
    rows = [("a", "the answer", "the end<eos>"), ("b", "and", "the end"), ("b", "is", "")]
    out = str(tmp_path / "report")
    evaluate(spark.createDataFrame(rows, "category string, prompt string, output string"), model, out, {"grounded_format": True})
    meta, records = reports.read_report(spark, out)
    got = {r.prompt: (r.generated_tokens, r.ended_with_eos) for r in records.collect()}
    assert got["the answer"][0] == got["and"][0] + 1 and got["is"] == (0, False)
    assert [got[p][1] for p in ("the answer", "and")] == [True, False]
    assert meta.first().eos_end_rate == round(1 / 3, 4)


def test_unknown_ids_and_null_texts(spark):
    from answerloom.operators import encode as en, tokenizer as tk

    model = tk.learn_bpe(tk.pretoken_counts(spark.createDataFrame([("ab ab",)], "line string")), 20)
    encode = en.encoder(spark, model)
    got = spark.createDataFrame([("ab",), (None,)], "t string").select(encode(F.col("t")).alias("ids")).collect()
    assert got[0].ids and got[1].ids is None
    with pytest.raises(Exception, match="outside the vocabulary"):
        spark.range(1).select(en.decode(F.array(F.lit(9_999)), model)).collect()


def test_texts_are_whole_unless_a_limit_is_given(spark):
    df = spark.createDataFrame([Row(title="t" * 9, question_body="b", tags="", answer_body="a" * 20_000)])
    assert len(df.select(pair_text(df)).first()[0]) > 20_000
    assert [df.select(text_is_cut(df, n)).first()[0] for n in (None, 20_000, 19_999, 36, 35)] == [False, False, True, True, True]
