"""Questions, answers, and their join into question/answer pairs."""

from pyspark.sql import functions as F

from answerloom.functions.text import preview, sql_trim

QUESTION, ANSWER = 1, 2


def extract_questions(posts, min_chars=10):
    """Questions with a body and enough trimmed text in title plus body."""
    text = F.concat(sql_trim(F.coalesce("Title", F.lit(""))), sql_trim(F.col("Body")))
    return posts.where(
        (F.col("PostTypeId") == QUESTION) & F.col("Body").isNotNull() & (F.length(text) >= min_chars)
    ).select("Id", "Title", "Body", "Tags")


def extract_answers(posts, min_chars=32):
    return posts.where(
        (F.col("PostTypeId") == ANSWER)
        & F.col("Body").isNotNull()
        & (F.length(sql_trim(F.col("Body"))) >= min_chars)
    ).select("Id", "ParentId", "Body", "Score")


def join_pairs(questions, answers):
    """Plain inner join; the shape a streaming side needs. AQE splits skewed partitions."""
    q, a = questions.alias("q"), answers.alias("a")
    return a.join(q, F.col("a.ParentId") == F.col("q.Id")).select(
        F.col("q.Id").alias("question_id"), F.col("q.Title").alias("title"),
        F.col("q.Body").alias("question_body"), F.col("q.Tags").alias("tags"),
        F.col("a.Id").alias("answer_id"), F.col("a.Body").alias("answer_body"),
        F.col("a.Score").alias("answer_score"),
    )


def hot_parents(posts, share):
    """Parents with more than ``share`` answers and how many shares they need.

    At most ``rows / share`` parents can qualify, which bounds the result.
    """
    return (
        posts.where((F.col("PostTypeId") == ANSWER) & F.col("ParentId").isNotNull())
        .groupBy(F.col("ParentId").alias("hot_id"))
        .count()
        .where(F.col("count") > share)
        .select("hot_id", F.ceil(F.col("count") / share).cast("int").alias("shares"))
    )


def pair_posts(posts, min_question_chars=10, min_answer_chars=32, share=1_000_000):
    """Question/answer pairs of one posts table, safe for very popular questions.

    A first pass over the two id columns finds parents with more than ``share``
    answers. Their answers are spread over several join keys and their one
    question row is repeated as often, so that no task gets a whole hot question.
    """
    hot = F.broadcast(hot_parents(posts, share))
    one = F.lit(1)
    answers = (
        extract_answers(posts, min_answer_chars)
        .join(hot, F.col("ParentId") == F.col("hot_id"), "left")
        .withColumn("share", F.pmod(F.xxhash64("Id"), F.coalesce("shares", one)).cast("int"))
    )
    questions = (
        extract_questions(posts, min_question_chars)
        .join(hot, F.col("Id") == F.col("hot_id"), "left")
        .withColumn("share", F.explode(F.sequence(F.lit(0), F.coalesce("shares", one) - 1)))
    )
    q = questions.select(
        F.col("Id").alias("question_id"), F.col("Title").alias("title"),
        F.col("Body").alias("question_body"), F.col("Tags").alias("tags"),
        F.col("share").alias("q_share"),
    )
    a = answers.select(
        F.col("ParentId"), F.col("share"), F.col("Id").alias("answer_id"),
        F.col("Body").alias("answer_body"), F.col("Score").alias("answer_score"),
    )
    return a.join(q, (a["ParentId"] == q["question_id"]) & (a["share"] == q["q_share"])).select(
        "question_id", "title", "question_body", "tags", "answer_id", "answer_body", "answer_score"
    )


def save_question_index(questions, table, buckets, path=None):
    """Keep the question side bucketed by id, so that later joins do not shuffle it."""
    writer = questions.write.mode("overwrite").bucketBy(buckets, "Id").sortBy("Id")
    (writer.option("path", path) if path else writer).saveAsTable(table)


def join_pairs_by_shard(spark, question_table, shards, out, min_answer_chars=32):
    """Pair every answer shard with the saved question index, one write per shard.

    The result equals one join over all shards; the loop only bounds how much
    is in flight, and a part that is already complete is not written again.
    """
    from answerloom.session import path_exists

    index = spark.table(question_table)
    parts = []
    for i, shard in enumerate(shards):
        part = f"{out}/part_{i:05d}"
        if not path_exists(spark, f"{part}/_SUCCESS"):
            answers = extract_answers(spark.read.parquet(shard), min_answer_chars)
            join_pairs(index, answers).write.mode("overwrite").parquet(part)
        parts.append(part)
    return spark.read.parquet(*parts)


def post_type_counts(posts):
    return posts.groupBy("PostTypeId").agg(F.count("*").alias("posts"))


def preview_posts(posts, chars=200):
    """The first question and the first answer by id, with shortened text."""
    def first(kind):
        return (
            posts.where(F.col("PostTypeId") == kind).orderBy("Id").limit(1)
            .select(
                "PostTypeId", "Id", "ParentId",
                preview(F.col("Title"), chars).alias("title"),
                preview(F.col("Body"), chars).alias("body"),
            )
        )

    return first(QUESTION).unionByName(first(ANSWER))
