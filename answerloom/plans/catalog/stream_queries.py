"""Incremental jobs over files written from the given tables, and the whole job."""

import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from answerloom.operators import pairs as pr
from answerloom.operators.tokenizer import learn_bpe, pretoken_counts, two_way_sample
from answerloom.plans import fixtures as fx
from answerloom.plans.catalog.pair_queries import PAIR_COLUMNS, _pairs
from answerloom.plans.catalog.registry import CURATED, PAIRS, query
from answerloom.plans.corpus_job import PRESETS, run_job
from answerloom.plans.catalog.tokenizer_queries import token_rows_sql
from answerloom.session import work_dir
from answerloom.streaming import incremental as inc


def _pair_files(spark, d, files=4):
    folder = work_dir(spark, "incoming")
    pairs = _pairs(spark, d)
    pairs.repartition(files, "question_id").write.parquet(folder)
    return folder, pairs.schema


def _broken(pairs):
    """Every answer of a question divisible by 7 gets a byte that is not UTF-8."""
    bad = F.concat(F.encode("answer_body", "UTF-8"), F.unhex(F.lit("FF"))).cast("string")
    return pairs.withColumn(
        "answer_body", F.when(F.col("question_id") % 7 == 0, bad).otherwise(F.col("answer_body"))
    )


def _model(spark, d):
    return learn_bpe(pretoken_counts(two_way_sample(_pairs(spark, d))), 320)


_VAL = "coalesce((question_id * 2654435761) % 10000 < 1000, false)"


def _token_columns(rows):
    ids = F.array_join(F.col("input_ids").cast("array<string>"), " ")
    return rows.select("question_id", "answer_id", "split", ids.alias("input_ids"), "n_tokens", "truncated")


_ALL = f"{PAIRS}, placed AS (SELECT *, CASE WHEN {_VAL} THEN 'val' ELSE 'train' END AS split FROM pairs)"


@query("SELECT * FROM (" + token_rows_sql(
    _ALL, "placed", "NOT coalesce((question_id * 2654435761) % 10000 < 100, false)", 256) + ") WHERE question_id % 7 <> 0")
def stream_tokenize(spark, d):
    """Micro-batch tokenization into one folder per split, all ids; broken rows are skipped."""
    folder, schema = _pair_files(spark, d)
    out = work_dir(spark, "stream_tokens")
    stream = _broken(inc.pair_stream(spark, folder, 1, schema))
    inc.tokenize_stream(
        stream, _model(spark, d), out, work_dir(spark, "stream_state"), 256, val_fraction=0.1
    ).awaitTermination()
    return _token_columns(spark.read.parquet(out))


@query(f"""WITH {PAIRS}, s AS (SELECT CASE WHEN question_id % 7 = 0 THEN 'skipped' WHEN {_VAL} THEN 'val'
  ELSE 'train' END AS status FROM pairs)
SELECT count(*) FILTER (status = 'train') AS train, count(*) FILTER (status = 'val') AS val,
count(*) FILTER (status = 'skipped') AS skipped FROM s""")
def tokenize_stats(spark, d):
    """Train, val and skipped rows of a batch run."""
    return inc.status_counts(inc.route(_broken(_pairs(spark, d)), 0.1))


@query(f"""WITH {PAIRS} SELECT CASE WHEN question_id % 7 = 0 THEN 'skipped' WHEN {_VAL} THEN 'val'
ELSE 'train' END AS status, count(*) AS rows FROM pairs GROUP BY 1""")
def stream_counters(spark, d):
    """Running counters of a stream after all micro-batches."""
    folder, schema = _pair_files(spark, d)
    name = f"counters_{uuid.uuid4().hex}"
    inc.split_count_stream(
        _broken(inc.pair_stream(spark, folder, 1, schema)), name, work_dir(spark, "counter_state"), 0.1
    ).awaitTermination()
    return spark.table(name)


@query(f"WITH {PAIRS} SELECT {PAIR_COLUMNS} FROM pairs")
def stream_pairs(spark, d):
    """Answers of new files joined to the fixed question index."""
    posts = fx.posts(spark, d)
    folder, index = work_dir(spark, "incoming_posts"), work_dir(spark, "questions")
    posts.repartition(4, "Id").write.parquet(folder)
    pr.extract_questions(posts).write.parquet(index)
    out = work_dir(spark, "stream_pairs")
    inc.pair_answer_stream(
        spark, spark.read.parquet(index), folder, out, work_dir(spark, "pair_state"), posts.schema, 1
    ).awaitTermination()
    return spark.read.parquet(out)


@query(token_rows_sql(CURATED, "curated", "split = 'train'", 128))
def corpus_job(spark, d):
    """The whole job with the first run's thresholds: posts to validated token chunks, all ids."""
    config = replace(PRESETS["run_a"], vocab_size=320, max_seq_len=128, rows_per_file=500)
    done = run_job(spark, fx.posts(spark, d), work_dir(spark, "job"), config)
    return _token_columns(spark.read.parquet(done["tokens"]))
