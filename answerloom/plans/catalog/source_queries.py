"""Sources and sinks, checked by writing and reading back."""

from pyspark.sql import functions as F, types as T

from answerloom.functions.ids import pad_right
from answerloom.functions.splits import three_way
from answerloom.operators import evaluation as ev, pairs as pr, training_metrics as tm
from answerloom.plans import fixtures as fx
from answerloom.plans.catalog.evaluation_queries import _LOSSES
from answerloom.plans.catalog.pair_queries import PAIR_COLUMNS, _pairs
from answerloom.plans.catalog.registry import PAIRS, POSTS, SCORED, SPLIT, query
from answerloom.session import list_files, work_dir
from answerloom.sources import checks, reports, sinks, tables


def _post_shards(spark, d):
    folder = work_dir(spark, "shards")
    posts = fx.posts(spark, d)
    posts.withColumn("shard", F.pmod("Id", F.lit(5))).write.partitionBy("shard").parquet(folder)
    return folder


@query(f"""WITH {POSTS} SELECT Id, PostTypeId, ParentId, Title, Body, Tags, Score FROM posts WHERE Id % 5 < 3""")
def shard_scan(spark, d):
    """Posts kept in five shards, the first three read with the declared schema."""
    return tables.read_posts(spark, _post_shards(spark, d), 3, T.StringType())


@query(f"WITH {POSTS} SELECT Id, PostTypeId, ParentId, Title, Body, Tags, Score FROM posts")
def merge_parts(spark, d):
    """Union of all shard parts, compacted into two files."""
    parts = list_files(spark, _post_shards(spark, d))
    return tables.merge_parts(spark, parts, work_dir(spark, "merged"), 2)


@query("SELECT l_orderkey, l_quantity FROM lineitem")
def projected_scan(spark, d):
    return tables.read_columns(spark, ["l_orderkey", "l_quantity"], f"{d}/lineitem.parquet")


@query("SELECT doc_id, lang, text FROM documents ORDER BY doc_id LIMIT 600")
def row_capped_subset(spark, d):
    """The first 600 rows in file order, written once; the cap is the feature."""
    out = work_dir(spark, "subset")
    tables.save_subset(spark, [f"{d}/documents.parquet"], 600, out)
    again = tables.save_subset(spark, [f"{d}/documents.parquet"], 600, out)
    return again.select("doc_id", "lang", "text")


@query(f"WITH {PAIRS} SELECT {PAIR_COLUMNS} FROM pairs")
def parquet_sink(spark, d):
    out = work_dir(spark, "pairs")
    _pairs(spark, d).write.option("compression", "zstd").parquet(out)
    return spark.read.parquet(out)


@query(f"""WITH {POSTS} SELECT Id, Title, Body, Tags FROM posts
WHERE PostTypeId = 1 AND Body IS NOT NULL AND length(trim(coalesce(Title, '')) || trim(Body)) >= 10""")
def saved_stage(spark, d):
    """A stage that is built once and then reused."""
    out = work_dir(spark, "stage")
    build = lambda: pr.extract_questions(fx.posts(spark, d))
    tables.saved_stage(spark, out, build)
    return tables.saved_stage(spark, out, build, required=True)


def _token_rows(spark, d):
    """Word lengths of every conversation turn as 64-id rows with a split."""
    conv = fx.table(spark, d, "conversations")
    return conv.select(
        F.col("conv_id").alias("question_id"), F.col("turn").alias("answer_id"),
        pad_right(F.transform(F.split("text", " "), F.length), 64).alias("input_ids"),
        three_way(F.col("conv_id")).alias("split"),
    )


def _written_tokens(spark, d):
    out = work_dir(spark, "tokens")
    sinks.write_tokens(_token_rows(spark, d), out, rows_per_file=100, rebalance=True)
    return out


_TOKENS = f"""tokens AS (SELECT question_id, turn AS answer_id, {SPLIT} AS split,
  list_concat(ids[1:64], list_transform(range(greatest(64 - len(ids), 0)), lambda i: 0)) AS input_ids
  FROM (SELECT conv_id AS question_id, turn,
    list_transform(string_split(text, ' '), lambda w: CAST(length(w) AS INTEGER)) AS ids FROM conversations))"""


@query(f"""WITH {_TOKENS} SELECT question_id, answer_id, split, array_to_string(input_ids, ' ') AS ids FROM tokens""")
def token_chunks(spark, d):
    """Chunks of at most 100 rows per file, one folder per split, all read back."""
    rows = tables.read_tokens(spark, _written_tokens(spark, d))
    ids = F.array_join(F.col("input_ids").cast("array<string>"), " ")
    return rows.select("question_id", "answer_id", "split", ids.alias("ids"))


@query(f"""WITH {_TOKENS} SELECT question_id, answer_id, CAST(list_sum(input_ids) AS BIGINT) AS id_sum
FROM tokens WHERE split = 'train'""")
def token_scan(spark, d):
    """Only the train folder is read (partition pruning)."""
    rows = tables.read_tokens(spark, _written_tokens(spark, d), "train")
    total = F.aggregate("input_ids", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return rows.select("question_id", "answer_id", total.alias("id_sum"))


@query(f"""WITH {_TOKENS} SELECT split, count(*) AS rows, CAST(min(len(input_ids)) AS INTEGER) AS min_len,
CAST(max(len(input_ids)) AS INTEGER) AS max_len,
CAST(sum(len(list_filter(input_ids, lambda i: i < 0 OR i >= 12))) AS BIGINT) AS bad_ids
FROM tokens GROUP BY split""")
def token_validation(spark, d):
    return checks.token_check(tables.read_tokens(spark, _written_tokens(spark, d)), 12)


@query(f"""WITH {_TOKENS} SELECT count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val,
count(*) FILTER (split = 'test') AS test, CAST(64 AS BIGINT) AS max_seq_len, 'standard' AS prompt_style,
CAST(0.1 AS DOUBLE) AS val_fraction FROM tokens""")
def manifest(spark, d):
    """Counts and settings, written as JSON and read back."""
    out = work_dir(spark, "manifest")
    settings = {
        "max_seq_len": 64, "prompt_style": "standard", "fractions": {"val": 0.1, "test": 0.05}
    }
    tokens = tables.read_tokens(spark, _written_tokens(spark, d))
    sinks.write_manifest(sinks.manifest(tokens, settings), out)
    return spark.read.json(out).select(
        "stats.train", "stats.val", "stats.test", "max_seq_len", "prompt_style",
        F.col("fractions.val").alias("val_fraction"),
    )


@query(f"""WITH {SCORED} SELECT category, count(*) AS records, CAST(sum(auto_total_0_10) AS BIGINT) AS total,
CAST(sum(word_count) AS BIGINT) AS words, round(sum(round_even(overlap, 4)), 4) AS overlap_sum,
count(*) FILTER (template_noise_flag) AS noisy, CAST(sum(len(lens)) AS BIGINT) AS generated_tokens
FROM scored GROUP BY category""")
def report_roundtrip(spark, d):
    """Nested report written as metadata plus records, then read and aggregated."""
    out = work_dir(spark, "report")
    scored = ev.score_answers(fx.eval_records(spark, d))
    reports.write_report(ev.eval_records(scored), ev.report_figures(scored), out, {"grounded_format": True})
    _, records = reports.read_report(spark, out)
    return records.groupBy("category").agg(
        F.count("*").alias("records"), F.sum("auto_scores.auto_total_0_10").alias("total"),
        F.sum("auto_scores.signals.word_count").alias("words"),
        F.round(F.sum("auto_scores.signals.prompt_keyword_overlap_ratio"), 4).alias("overlap_sum"),
        F.count_if("template_noise_flag").alias("noisy"),
        F.sum("generated_tokens").alias("generated_tokens"),
    )


@query(f"""WITH {_LOSSES}, m AS (SELECT run_id, ceil(step / 50) AS b, max(step) AS step, avg(loss) AS loss
  FROM losses GROUP BY ALL HAVING max(step) % 50 = 0),
v AS (SELECT run_id, avg(loss) AS loss FROM losses GROUP BY run_id)
SELECT run_id, CAST(step AS BIGINT) AS step, round(loss, 6) AS train_loss, CAST(NULL AS DOUBLE) AS val_loss FROM m
UNION ALL SELECT run_id, CAST(0 AS BIGINT), NULL, round(loss, 6) FROM v""")
def metrics_log(spark, d):
    """Training and validation records appended to one log per run."""
    out = work_dir(spark, "metrics")
    losses = fx.losses(spark, d)
    reports.append_metrics(tm.logged_losses(losses, 50), out)
    val = losses.groupBy("run_id").agg(F.avg("loss").alias("val_loss")).withColumn("step", F.lit(0))
    reports.append_metrics(val, out)
    return reports.read_metrics(spark, out).select(
        "run_id", "step", F.round("train_loss", 6).alias("train_loss"),
        F.round("val_loss", 6).alias("val_loss"),
    )
