"""Parquet sources: shard sets, projected scans, row caps, saved stages."""

from urllib.parse import unquote

from pyspark.sql import functions as F

from answerloom import schemas
from answerloom.operators.sampling import first_rows
from answerloom.session import list_files, path_exists

MAX_SHARDS = 59  # fixed value: shards of the full posts dump; a default, not a limit of the library


def shard_set(paths, n=None, limit=MAX_SHARDS):
    """The first ``n`` shard paths in sorted order; None keeps all."""
    if n is not None and not 1 <= n <= limit:
        raise ValueError(f"the number of shards must be between 1 and {limit}")
    return sorted(paths)[:n]


def read_posts(spark, folder, n=None, tags=None, limit=MAX_SHARDS):
    """Posts of the first ``n`` shards of a folder, with the declared schema."""
    paths = shard_set(list_files(spark, folder), n, limit)
    if not paths:
        raise FileNotFoundError(f"no shards in {folder}")
    schema = schemas.posts_schema(tags) if tags is not None else schemas.posts_schema()
    return spark.read.schema(schema).parquet(*paths)


def read_columns(spark, columns, *paths):
    return spark.read.parquet(*paths).select(*columns)


def read_spread(spark, *paths):
    """A scan with at least one partition per core.

    A small file is one partition however much work its rows are, so it is
    redistributed; a scan that already has enough partitions is left alone.
    """
    df = spark.read.parquet(*paths)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def save_subset(spark, paths, n, out):
    """Write the first ``n`` rows once; an existing subset is kept as it is."""
    first_rows(spark, paths, n).write.mode("ignore").parquet(out)
    return spark.read.parquet(out)


def merge_parts(spark, parts, out=None, files=None):
    """All parts as one table, optionally written as ``files`` even files by all tasks."""
    merged = spark.read.parquet(*parts)
    if out is None:
        return merged
    (merged.repartition(files) if files else merged).write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)


def file_states(df):
    """``[path, length, modification time]`` of the files a DataFrame reads, sorted; one row per file."""
    paths = [unquote(p) for p in df.inputFiles()]
    if not paths:
        return []
    # Columns of the file listing: no content is read.
    files = df.sparkSession.read.format("binaryFile").load(paths).select(
        "path", "length", F.unix_micros("modificationTime").alias("modified"))
    return sorted([r["path"], r["length"], r["modified"]] for r in files.collect())


def stage_state(spark, path, fingerprint=None, marker="_SUCCESS"):
    """``done``, ``missing`` or ``changed``: whether a finished stage has this fingerprint."""
    if not path_exists(spark, f"{path}/{marker}"):
        return "missing"
    if fingerprint is None:
        return "done"
    note = f"{path}.fingerprint"
    same = path_exists(spark, f"{note}/_SUCCESS") and spark.read.text(note).first() == (fingerprint,)
    return "done" if same else "changed"


def note_stage(spark, path, fingerprint):
    """Record what a finished stage was made from, beside its folder."""
    if fingerprint is not None:
        spark.createDataFrame([(fingerprint,)], "value string").coalesce(1).write.mode("overwrite").text(
            f"{path}.fingerprint")


def must_build(spark, path, reuse, required, fingerprint=None, marker="_SUCCESS"):
    """Whether a stage has to be made; a required one that is missing or made otherwise is an error."""
    state = stage_state(spark, path, fingerprint, marker)
    if required and state == "missing":
        raise FileNotFoundError(f"stage output is missing: {path}")
    if required and state == "changed":
        raise ValueError(f"stage output was made with other settings or inputs: {path}")
    return not (state == "done" and (reuse or required))


def saved_stage(spark, path, build, reuse=True, required=False, fingerprint=None):
    """Read a finished stage, or build and save it.

    A stage counts as finished when its success marker exists and, if a
    ``fingerprint`` of its settings and inputs is given, when it was saved with
    the same one. ``required`` forbids building: a skipped stage must be there already.
    """
    if must_build(spark, path, reuse, required, fingerprint):
        build().write.mode("overwrite").option("compression", "zstd").parquet(path)
        note_stage(spark, path, fingerprint)
    return spark.read.parquet(path)


def read_tokens(spark, path, split=None):
    """Token rows with their file and row position, read from one split only if asked."""
    if not path_exists(spark, f"{path}/_SUCCESS"):
        raise FileNotFoundError(f"no token chunks in {path}")
    rows = spark.read.schema(schemas.TOKEN_ROWS).parquet(path)
    if split is not None:
        rows = rows.where(F.col("split") == split)
    return rows.select(
        "*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row_index")
    )
