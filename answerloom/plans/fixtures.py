"""The given tables in the shape of the library's inputs."""

from pyspark.sql import functions as F

from answerloom.sources.tables import read_spread


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_table(spark, sf_dir, name):
    """A table whose rows carry heavy text work."""
    return read_spread(spark, f"{sf_dir}/{name}.parquet")


def _first_user_turn(conv):
    """The question row of every conversation, from one partial-aggregated pass."""
    return (
        conv.where("role = 'user'").groupBy("conv_id")
        .agg(F.min(F.struct("turn", "text")).alias("q"))
        .select("conv_id", F.col("q.turn").alias("turn"), F.col("q.text").alias("text"))
    )


def posts(spark, sf_dir):
    """First user turn = question, every assistant turn = an answer with a made-up score.

    As in the source data only conversations with a user turn ask a question.
    """
    conv = table(spark, sf_dir, "conversations")
    null = F.lit(None)
    q = _first_user_turn(conv).select(
        F.col("conv_id").alias("Id"), F.lit(1).alias("PostTypeId"),
        null.cast("bigint").alias("ParentId"),
        F.when(F.col("conv_id") % 5 != 0, F.substring("text", 1, 60)).alias("Title"),
        F.col("text").alias("Body"),
        F.when(
            F.col("conv_id") % 4 != 0,
            F.concat(F.lit("tag"), (F.col("conv_id") % 7).cast("string"), F.lit(", lang")),
        ).alias("Tags"),
        F.lit(0).alias("Score"),
    )
    a = conv.where("role = 'assistant'").select(
        _answer_id().alias("Id"), F.lit(2).alias("PostTypeId"), F.col("conv_id").alias("ParentId"),
        null.cast("string").alias("Title"), F.col("text").alias("Body"),
        null.cast("string").alias("Tags"),
        F.when(
            F.col("turn") != 5, (F.length("text") * 7 + F.col("turn") * 3) % 11 - 3
        ).cast("int").alias("Score"),
    )
    return q.unionByName(a)


def _answer_id():
    return F.lit(1_000_000) + F.col("conv_id") * 100 + F.col("turn")


def eval_records(spark, sf_dir):
    """Answers as generated texts; appended markers make every scoring branch occur."""
    conv = text_table(spark, sf_dir, "conversations")
    q = _first_user_turn(conv).select("conv_id", F.col("text").alias("question"))
    a = conv.where("role = 'assistant'").join(q, "conv_id")
    c = F.col("conv_id")

    def when(cond, text):
        return F.when(cond, F.lit(text)).otherwise("")

    output = F.concat(
        F.col("text"),
        when(c % 3 == 0, "\n1. first step"),
        when(c % 4 == 3, "\ndef f(): return 1"),
        when(c % 6 == 1, "\nTags: the following git file file"),
        when(c % 10 == 2, " the following git repo"),
    )
    category = (
        F.when(c % 4 == 0, "so_style").when(c % 4 == 1, "debugging")
        .when(c % 4 == 2, "chat_style").otherwise("code_help")
    )
    lengths = F.transform(F.split(output, " "), F.length)
    return a.select(
        _answer_id().alias("rec_id"), category.alias("category"),
        F.concat(F.lit("<bos> Question:\n"), "question", F.lit("\n<sep> Answer:\n")).alias("prompt"),
        output.alias("output"),
        ((F.col("turn") % 2 == 1) & (c % 5 == 0)).alias("ended_with_eos"),
        lengths.alias("out_ids"),
        F.transform(F.split("question", " "), F.length).alias("prompt_ids"),
    )


def losses(spark, sf_dir):
    """Training losses: one run per event type, steps numbered by event id."""
    from answerloom.operators.batches import index_rows

    events = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("run_id"), "event_id", (F.col("value") / 100).alias("loss")
    )
    return index_rows(events, "run_id", "event_id").select(
        "run_id", (F.col("row_index") + 1).alias("step"), "loss"
    )


def token_losses(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("batch_id"), F.col("l_linenumber").alias("label"),
        F.col("l_discount").alias("loss"),
    )


def file_rows(spark, sf_dir):
    """Documents as rows of files: the source is the file."""
    from answerloom.operators.batches import index_rows

    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("file"), "doc_id")
    return index_rows(docs, "file", "doc_id")


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))


def query_vectors(spark, sf_dir):
    return vectors(spark, sf_dir).withColumnRenamed("vec_id", "query_id")
