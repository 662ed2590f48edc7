"""Evaluation reports, metrics logs and the fixed prompt set."""

from pyspark.sql import functions as F

from answerloom import schemas

# The twelve evaluation prompts, three per category.
PROMPTS = [
    ("so_style", "<bos> Question:\nHow do I fix 'TypeError: list object has no attribute strip' in Python when a column can be list or string?\nTags: python pandas\n<sep> Answer:\n"),
    ("so_style", "<bos> Question:\nJAX pmap only sees one GPU although two GPUs are available. What should I check first?\nTags: jax gpu\n<sep> Answer:\n"),
    ("so_style", "<bos> Question:\nDuckDB join on large parquet runs out of memory. What memory-safe strategy should I use?\nTags: duckdb parquet\n<sep> Answer:\n"),
    ("debugging", "<bos> Question:\nI get RESOURCE_EXHAUSTED: /tmp tempfile Disk quota exceeded during JAX training compile. How can I fix it on cluster?\nTags: jax hpc\n<sep> Answer:\n"),
    ("debugging", "<bos> Question:\nFile Save Error in Jupyter notebook says disk I/O error, but df -h shows free space. Why?\nTags: jupyter linux\n<sep> Answer:\n"),
    ("debugging", "<bos> Question:\nTokenization is slower with 62 workers than with 1 worker using tokenizers encode_batch. Why does this happen?\nTags: python multiprocessing\n<sep> Answer:\n"),
    ("chat_style", "<bos> User:\nMy preprocessing pipeline keeps crashing from memory usage. Give me a practical step-by-step fix plan.\nAssistant:\n"),
    ("chat_style", "<bos> User:\nI trained on 20 shards and quality is weak. Should I change model size, data, or decoding first?\nAssistant:\n"),
    ("chat_style", "<bos> User:\nHow do I structure checkpoints for multiple runs so resume is easy and reproducible?\nAssistant:\n"),
    ("code_help", "<bos> Question:\nWrite a Python function that safely converts input that may be str, list, bytes, dict, or None into clean text.\nTags: python\n<sep> Answer:\n"),
    ("code_help", "<bos> Question:\nHow to implement no-repeat-ngram decoding for autoregressive generation in Python pseudocode?\nTags: nlp decoding\n<sep> Answer:\n"),
    ("code_help", "<bos> Question:\nGive a minimal checklist to verify JAX is actually using 2 GPUs with pmap.\nTags: jax cuda\n<sep> Answer:\n"),
]


def prompt_table(spark):
    return spark.createDataFrame(PROMPTS, schemas.PROMPTS)


def write_report(records, figures, folder, settings=None):
    """``metadata`` as one JSON row with a time stamp, ``results`` as JSON lines.

    The records stay a distributed dataset, so a report may have any size.
    """
    extra = [F.lit(v).alias(k) for k, v in (settings or {}).items()]
    stamped = figures.select(*extra, "*", F.unix_timestamp(F.current_timestamp()).alias("created_at_unix"))
    stamped.coalesce(1).write.mode("overwrite").json(f"{folder}/metadata")
    records.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{folder}/results")


def read_report(spark, folder):
    """(metadata, records) of a report written above."""
    return (
        spark.read.json(f"{folder}/metadata"),
        spark.read.schema(schemas.EVAL_RECORD).json(f"{folder}/results"),
    )


def read_single_report(spark, path):
    """(metadata, records) of a report kept as one nested JSON document."""
    doc = spark.read.option("multiLine", True).json(path)
    return doc.select("metadata.*"), doc.select(F.explode("results").alias("r")).select("r.*")


def append_metrics(records, path):
    """Append training or validation records, one log folder per run."""
    columns = [
        (F.col(f.name) if f.name in records.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schemas.METRICS.fields
    ]
    records.select(*columns).write.mode("append").partitionBy("run_id").json(path)


def read_metrics(spark, path):
    return spark.read.schema(schemas.METRICS).json(path)
