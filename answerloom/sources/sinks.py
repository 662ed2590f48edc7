"""Token chunks by split and the manifest that describes them."""

from pyspark.sql import functions as F

from answerloom import schemas

ROWS_PER_FILE = 65_536


def write_tokens(rows, path, rows_per_file=ROWS_PER_FILE, rebalance=False):
    """Replace ``path`` with zstd chunks below one folder per split.

    Files hold at most ``rows_per_file`` rows. Rows are written where they are:
    bringing a split together first would put most of the corpus in one task.
    ``rebalance`` evens out many small inputs; AQE then splits large splits.
    """
    if rebalance:
        rows = rows.hint("rebalance", "split")
    (
        rows.select(*[f.name for f in schemas.TOKEN_ROWS if f.name in rows.columns])
        .write.mode("overwrite").option("compression", "zstd")
        .option("maxRecordsPerFile", rows_per_file).partitionBy("split").parquet(path)
    )


def manifest(tokens, settings, splits=("train", "val", "test")):
    """One row: row and cut-row counts per split plus the job's settings as nested structs.

    ``truncated`` counts rows with more ids than fit, ``text_cut`` rows with
    characters beyond the text limit.
    """
    def counts(flag):
        return [
            F.coalesce(F.sum(((F.col("split") == s) & flag).cast("long")), F.lit(0)).alias(s) for s in splits
        ]

    cut = [c for c in ("truncated", "text_cut") if c in tokens.columns]

    def column(value):
        if isinstance(value, dict):
            return F.struct(*[column(v).alias(k) for k, v in value.items()])
        return F.lit(value)

    return tokens.agg(
        F.struct(*counts(F.lit(True))).alias("stats"),
        *[F.struct(*counts(F.coalesce(F.col(c), F.lit(False)))).alias(c) for c in cut],
    ).select(
        "stats", *cut, *[column(v).alias(k) for k, v in settings.items()]
    )


def write_manifest(df, path):
    df.coalesce(1).write.mode("overwrite").json(path)
