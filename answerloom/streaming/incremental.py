"""Incremental jobs with Structured Streaming: new files in, token chunks out."""

from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from answerloom import schemas
from answerloom.functions.splits import two_way
from answerloom.functions.templates import broken_text
from answerloom.operators.encode import tokenize_pairs
from answerloom.operators.pairs import extract_answers, join_pairs

def pair_stream(spark, folder, files_per_trigger=16, schema=None):
    """New pair files of a folder as a stream of bounded micro-batches."""
    return (
        spark.readStream.schema(schema or schemas.pairs_schema())
        .option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    )


def route(pairs, val_fraction=0.01):
    """Add ``status``: the split of the row, or 'skipped' when a text is not valid UTF-8."""
    split = two_way(F.col("question_id"), val_fraction)
    return pairs.withColumn("status", F.when(broken_text(pairs), "skipped").otherwise(split))


def status_counts(routed):
    """Train, val and skipped rows in one aggregation."""
    return routed.agg(*[_count(s) for s in ("train", "val", "skipped")])


def _count(status):
    return F.coalesce(F.sum((F.col("status") == status).cast("long")), F.lit(0)).alias(status)


def tokenized(pairs, model, max_seq_len=1024, max_chars=None, val_fraction=0.01):
    """Two-way split and token rows; the same function serves batch and stream."""
    counted = route(pairs, val_fraction).observe(
        "rows", *[_count(s) for s in ("train", "val", "skipped")]
    )
    kept = counted.where("status <> 'skipped'").withColumnRenamed("status", "split")
    return tokenize_pairs(kept, model, max_seq_len, max_chars).select(
        "question_id", "answer_id", "input_ids", "split", "n_tokens", "truncated", "text_cut"
    )


def _start(df, out, checkpoint, partition=None, rows_per_file=65_536):
    writer = (
        df.writeStream.format("parquet").outputMode("append")
        .option("path", out).option("checkpointLocation", checkpoint)
        .option("compression", "zstd").option("maxRecordsPerFile", rows_per_file)
        .trigger(availableNow=True)
    )
    return (writer.partitionBy(partition) if partition else writer).start()


def tokenize_stream(pairs, model, out, checkpoint, max_seq_len=1024, max_chars=None,
                    val_fraction=0.01):
    """Tokenize what is new since the last run into one folder per split."""
    rows = tokenized(pairs, model, max_seq_len, max_chars, val_fraction)
    return _start(rows, out, checkpoint, "split")


def split_count_stream(pairs, name, checkpoint, val_fraction=0.01):
    """Running row counts per status, kept in a memory table of three rows."""
    counts = route(pairs, val_fraction).groupBy("status").agg(F.count("*").alias("rows"))
    return (
        counts.writeStream.format("memory").queryName(name).outputMode("complete")
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def pair_answer_stream(spark, questions, folder, out, checkpoint, schema, files_per_trigger=16,
                       min_answer_chars=32):
    """Join new post files' answers to the fixed question index."""
    posts = (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
        .parquet(folder)
    )
    return _start(join_pairs(questions, extract_answers(posts, min_answer_chars)), out, checkpoint)


class _AllCounts(StreamingQueryListener):
    """Counters of all micro-batches of all queries, as they are reported.

    Progress reports that a query keeps are limited in number; a listener gets
    every one. Each batch counts once, also if its report comes again.
    """

    def __init__(self):
        self.batches = {}

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        progress = event.progress
        seen = progress.observedMetrics.get("rows")
        if seen is not None:
            self.batches[str(progress.id), progress.batchId] = seen.asDict()

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass

    def totals(self, query_id):
        own = [counts for (q, _), counts in self.batches.items() if q == str(query_id)]
        return {n: sum(counts[n] for counts in own) for n in ("train", "val", "skipped")}


def observed_totals(spark, start):
    """Run the stream that ``start()`` starts to its end; the counters of all its micro-batches.

    The listener is there before the stream is, so no report is missed.
    """
    seen = _AllCounts()
    spark.streams.addListener(seen)
    try:
        query = start()
        query.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(60_000)
    finally:
        spark.streams.removeListener(seen)
    return seen.totals(query.id)
