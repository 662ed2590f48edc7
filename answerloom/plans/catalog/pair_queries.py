"""Posts to curated, split pairs."""

import uuid

from pyspark.sql import functions as F

from answerloom.functions.splits import bucket, is_val, three_way, two_way
from answerloom.operators import curate as cur, pairs as pr
from answerloom.plans import fixtures as fx
from answerloom.plans.catalog.registry import (
    BEST, BUCKET, CURATED, PAIRS, POSTS, SPLIT, THANKS, WORDS, quality_sql, query,
)
from answerloom.session import list_files, work_dir

PAIR_COLUMNS = (
    "question_id, title, question_body, tags, answer_id, answer_body, answer_score"
)


def _pairs(spark, d):
    return pr.pair_posts(fx.posts(spark, d))


def _curated(spark, d):
    kept = cur.curate(_pairs(spark, d), 1, 80, 12, drop_short_thanks=True)
    return cur.split_pairs(kept)


@query(f"""WITH {POSTS} SELECT Id, Title, Body, Tags FROM posts
WHERE PostTypeId = 1 AND Body IS NOT NULL AND length(trim(coalesce(Title, '')) || trim(Body)) >= 10""")
def question_extract(spark, d):
    return pr.extract_questions(fx.posts(spark, d))


@query(f"""WITH {POSTS} SELECT Id, ParentId, Body, Score FROM posts
WHERE PostTypeId = 2 AND Body IS NOT NULL AND length(trim(Body)) >= 32""")
def answer_filter(spark, d):
    return pr.extract_answers(fx.posts(spark, d))


@query(f"WITH {PAIRS} SELECT {PAIR_COLUMNS} FROM pairs")
def qa_pairs(spark, d):
    return _pairs(spark, d)


@query(f"WITH {PAIRS} SELECT {PAIR_COLUMNS} FROM pairs")
def qa_pairs_hot_questions(spark, d):
    """Every question with more than two answers counts as hot and is spread."""
    return pr.pair_posts(fx.posts(spark, d), share=2)


@query(f"WITH {PAIRS} SELECT {PAIR_COLUMNS} FROM pairs")
def qa_pairs_by_shard(spark, d):
    """Bucketed question index, answers joined shard by shard, parts merged."""
    posts = fx.posts(spark, d)
    shards = work_dir(spark, "post_shards")
    posts.withColumn("shard", F.pmod("Id", F.lit(4))).write.partitionBy("shard").parquet(shards)
    name = f"questions_{uuid.uuid4().hex}"
    pr.save_question_index(pr.extract_questions(posts), name, 8, work_dir(spark, "question_index"))
    out = pr.join_pairs_by_shard(
        spark, name, list_files(spark, shards), work_dir(spark, "pair_parts")
    )
    spark.sql(f"DROP TABLE {name}")
    return out


@query("""SELECT o_orderkey AS order_key, o_custkey AS customer_key, l_linenumber AS line,
l_quantity AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def wide_fanout_join(spark, d):
    """The pair join's shape on the largest tables: many rows per parent."""
    lines = fx.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    orders = fx.table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).select(
        F.col("o_orderkey").alias("order_key"), F.col("o_custkey").alias("customer_key"),
        F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("quantity"),
    )


@query(f"""WITH {PAIRS} SELECT answer_id, coalesce(answer_score, 0) >= 1 AS score_ok,
length(coalesce(answer_body, '')) >= 80 AS chars_ok, {WORDS} >= 12 AS words_ok,
{THANKS} AS short_thanks FROM pairs""")
def quality_rules(spark, d):
    """Each rule on its own: score, characters, words, short thanks."""
    return _pairs(spark, d).select(
        "answer_id", cur.min_score(1).alias("score_ok"), cur.min_chars(80).alias("chars_ok"),
        cur.min_words(12).alias("words_ok"), cur.is_short_thanks().alias("short_thanks"),
    )


@query(f"WITH {PAIRS} SELECT {PAIR_COLUMNS} FROM pairs WHERE {quality_sql(1, 80, 12)}")
def quality_filter(spark, d):
    return cur.curate(_pairs(spark, d), 1, 80, 12, drop_short_thanks=True)


@query(f"WITH {PAIRS} SELECT {PAIR_COLUMNS} FROM ({BEST})")
def best_answer(spark, d):
    return cur.best_answer(_pairs(spark, d))


@query(f"WITH {PAIRS} SELECT {PAIR_COLUMNS} FROM ({BEST}) WHERE {quality_sql(1, 80, 12)}")
def best_then_quality(spark, d):
    """Best answer first: a question whose top answer fails the rules disappears."""
    return cur.curate(_pairs(spark, d), 1, 80, 12, drop_short_thanks=True, best_only=True)


@query("""SELECT question_id, answer_id FROM (
  SELECT l_orderkey AS question_id, CAST(l_linenumber AS BIGINT) AS answer_id,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY CAST(l_quantity AS INTEGER) DESC,
      length(CAST(CAST(floor(l_extendedprice) AS BIGINT) AS VARCHAR)) DESC, l_linenumber) AS rn FROM lineitem) WHERE rn = 1""")
def best_line_per_order(spark, d):
    """The best-answer rule on the largest table."""
    lines = fx.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("question_id"), F.col("l_linenumber").cast("long").alias("answer_id"),
        F.floor("l_extendedprice").cast("string").alias("answer_body"), F.col("l_quantity").cast("int").alias("answer_score"),
    )
    return cur.best_answer(lines).select("question_id", "answer_id")


@query(f"""WITH {CURATED} SELECT {PAIR_COLUMNS}, split FROM curated""")
def curated_split(spark, d):
    return _curated(spark, d)


@query(f"WITH {CURATED} SELECT split, count(*) AS rows FROM curated GROUP BY split")
def split_counts(spark, d):
    return cur.split_counts(_curated(spark, d))


@query(f"""WITH {CURATED} SELECT question_id, CAST(count(DISTINCT split) AS BIGINT) AS splits,
count(*) AS rows FROM curated GROUP BY question_id""")
def split_disjoint(spark, d):
    """Every question lies in exactly one split."""
    return _curated(spark, d).groupBy("question_id").agg(
        F.countDistinct("split").alias("splits"), F.count("*").alias("rows")
    )


@query(f"""SELECT question_id, {BUCKET} AS bucket, {SPLIT} AS split3,
CASE WHEN {BUCKET} < 100 THEN 'val' ELSE 'train' END AS split2, {BUCKET} < 100 AS is_val
FROM (SELECT doc_id AS question_id FROM documents UNION ALL SELECT event_id FROM events
      UNION ALL SELECT o_orderkey FROM orders)""")
def split_assignment(spark, d):
    """Buckets and both split policies over every id of three tables."""
    ids = (
        fx.table(spark, d, "documents").select(F.col("doc_id").alias("question_id"))
        .unionAll(fx.table(spark, d, "events").select("event_id"))
        .unionAll(fx.table(spark, d, "orders").select("o_orderkey"))
    )
    q = F.col("question_id")
    return ids.select(
        "question_id", bucket(q).alias("bucket"), three_way(q).alias("split3"),
        two_way(q).alias("split2"), is_val(q, 0.01).alias("is_val"),
    )


@query(f"WITH {POSTS} SELECT PostTypeId, count(*) AS posts FROM posts GROUP BY PostTypeId")
def post_type_counts(spark, d):
    return pr.post_type_counts(fx.posts(spark, d))


@query(f"""WITH {POSTS}, firsts AS (
  SELECT *, row_number() OVER (PARTITION BY PostTypeId ORDER BY Id) AS rn FROM posts)
SELECT PostTypeId, Id, ParentId, substr(coalesce(Title, ''), 1, 200) AS title,
       substr(coalesce(Body, ''), 1, 200) AS body FROM firsts WHERE rn = 1""")
def post_preview(spark, d):
    return pr.preview_posts(fx.posts(spark, d))
