import json

import pytest
from pyspark.sql import functions as F, types as T

from answerloom import schemas
from answerloom.operators import evaluation as ev
from answerloom.operators.sampling import first_rows, keyed_sample
from answerloom.session import shared_dir, work_dir
from answerloom.sources import checks, reports, sinks, tables


@pytest.mark.parametrize("n", [1, 499, 500, 1000, 2000])
def test_keyed_sample_is_exact_and_repeatable(spark, n):
    df = spark.range(1000).withColumnRenamed("id", "answer_id")
    first = {r.answer_id for r in keyed_sample(df, n, "answer_id").collect()}
    again = {r.answer_id for r in keyed_sample(df.repartition(7), n, "answer_id").collect()}
    assert first == again and len(first) == min(n, 1000)


def test_larger_sample_contains_the_smaller(spark):
    df = spark.range(1000).withColumnRenamed("id", "answer_id")
    small, large = ({r.answer_id for r in keyed_sample(df, n, "answer_id").collect()} for n in (50, 300))
    assert small < large


@pytest.mark.parametrize("n", [1, 10, 15, 20, 25, 99])
def test_first_rows_follow_path_and_row_order(spark, tmp_path, n):
    paths = []
    for i in range(3):
        p = str(tmp_path / f"s{i}")
        spark.range(i * 10, i * 10 + 10).coalesce(1).write.parquet(p)
        paths.append(p)
    assert sorted(r.id for r in first_rows(spark, paths, n).collect()) == list(range(min(n, 30)))
    with pytest.raises(ValueError):
        first_rows(spark, paths, 0)


def test_shard_set_limits():
    assert tables.shard_set(["b", "a", "c"], 2) == ["a", "b"]
    assert tables.shard_set(["b", "a"]) == ["a", "b"]
    for n in (0, 60):
        with pytest.raises(ValueError):
            tables.shard_set(["a"], n)


def test_subset_is_written_once(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    spark.range(100).coalesce(1).write.parquet(src)
    assert tables.save_subset(spark, [src], 10, out).count() == 10
    assert tables.save_subset(spark, [src], 50, out).count() == 10


def test_stage_reuse(spark, tmp_path):
    path, calls = str(tmp_path / "stage"), []

    def build():
        calls.append(1)
        return spark.range(3)

    with pytest.raises(FileNotFoundError):
        tables.saved_stage(spark, path, build, required=True)
    assert tables.saved_stage(spark, path, build).count() == 3
    assert tables.saved_stage(spark, path, build).count() == 3
    assert len(calls) == 1
    tables.saved_stage(spark, path, build, reuse=False)
    assert len(calls) == 2


def _tokens(spark, n=250):
    return spark.range(n).select(
        F.col("id").alias("question_id"), F.col("id").alias("answer_id"),
        F.array(*[F.lit(7)] * 4).alias("input_ids"),
        F.when(F.col("id") % 10 == 0, "val").otherwise("train").alias("split"),
    )


def test_token_files_are_capped_and_replaced(spark, tmp_path):
    import pyarrow.parquet as pq

    out = tmp_path / "tok"
    for _ in range(2):
        sinks.write_tokens(_tokens(spark).coalesce(1), str(out), rows_per_file=100)
    files = sorted(out.glob("split=train/*.parquet"))
    assert [pq.ParquetFile(f).metadata.num_rows for f in files] == [100, 100, 25]
    assert pq.ParquetFile(files[0]).metadata.row_group(0).column(0).compression == "ZSTD"
    train = tables.read_tokens(spark, str(out), "train")
    assert train.count() == 225
    assert "PartitionFilters: [isnotnull(split" in train._jdf.queryExecution().toString()
    with pytest.raises(FileNotFoundError):
        tables.read_tokens(spark, str(tmp_path / "nothing"))


def test_validation_finds_every_disagreement(spark, tmp_path):
    tokens = _tokens(spark)
    good = sinks.manifest(tokens, {"max_seq_len": 4}, ("train", "val"))
    checks.require_valid(tokens, good, 8, 4)
    wrong = [
        (tokens, good, 8, 5), (tokens, good, 7, 4), (tokens.where("question_id > 3"), good, 8, 4),
        (tokens.where("split = 'val'"), good, 8, 4),
        (tokens.withColumn("input_ids", F.slice("input_ids", 1, 3)), good, 8, 4),
    ]
    for args in wrong:
        with pytest.raises(ValueError):
            checks.require_valid(*args)


def test_single_document_report(spark, tmp_path):
    record = {
        "category": "a", "prompt": "p", "ended_with_eos": True, "template_noise_flag": False,
        "auto_scores": {"auto_total_0_10": 4, "signals": {"word_count": 3}},
        "manual_score_template": {"notes": ""},
    }
    path = tmp_path / "report.json"
    path.write_text(json.dumps({"metadata": {"num_prompts": 2}, "results": [record, record]}, indent=2))
    meta, records = reports.read_single_report(spark, str(path))
    assert meta.first()["num_prompts"] == 2
    figures = ev.report_figures(records.select("*", "auto_scores.auto_total_0_10")).first()
    assert (figures["avg_auto_total_0_10"], figures["eos_end_rate"]) == (4.0, 1.0)


def test_report_figures_of_nothing_are_zero(spark):
    empty = spark.createDataFrame([], "auto_total_0_10 int, ended_with_eos boolean, template_noise_flag boolean")
    assert tuple(ev.report_figures(empty).first()) == (0, 0.0, 0.0, 0.0)


def test_records_keep_the_declared_schema(spark, tmp_path):
    df = spark.createDataFrame(
        [("so_style", "q <sep> Answer:\n", "use it", [1, 2], [5, 6, 3])],
        "category string, prompt string, output string, prompt_ids array<int>, out_ids array<int>",
    )
    records = ev.eval_records(ev.score_answers(df), eos_id=3)
    assert [f.name for f in records.schema] == schemas.EVAL_RECORD.fieldNames()
    out = str(tmp_path / "r")
    reports.write_report(records, ev.report_figures(ev.score_answers(df).withColumn("ended_with_eos", F.lit(True))), out)
    meta, back = reports.read_report(spark, out)
    row = back.first()
    assert row.ended_with_eos and row.generated_tokens == 3 and row.manual_score_template.notes == ""
    assert meta.first()["created_at_unix"] > 0


def test_prompts(spark):
    counts = {r.category: r["count"] for r in reports.prompt_table(spark).groupBy("category").count().collect()}
    assert counts == {"so_style": 3, "debugging": 3, "chat_style": 3, "code_help": 3}


def test_declared_schema_is_enforced(spark):
    with pytest.raises(ValueError, match="missing tags"):
        schemas.require_columns(spark.range(1), schemas.pairs_schema(), "pairs")


def test_posts_need_shards(spark, tmp_path):
    spark.range(1).write.parquet(str(tmp_path / "empty" / "a"))
    (tmp_path / "none").mkdir()
    with pytest.raises(FileNotFoundError):
        tables.read_posts(spark, str(tmp_path / "none"), tags=T.StringType())


def test_work_folders_lie_in_the_shared_folder(spark):
    assert work_dir(spark, "x").startswith(shared_dir(spark))
    assert work_dir(spark, "x") != work_dir(spark, "x")
