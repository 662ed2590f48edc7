"""Exact row samples and row caps that never pass through one task."""

from pyspark.sql import functions as F

from answerloom.session import cut_lineage

PREFIX = 4  # hex digits, 65,536 rank ranges


def rank_column(seed, *keys):
    """A pseudo-random rank that any engine can reproduce (md5 of seed and keys)."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def keyed_sample(df, n, key, seed=42):
    """Exactly ``min(n, rows)`` rows: those with the smallest rank of ``key``.

    Rows that share a key (or have none) are told apart by a hash of all their
    columns; of rows that are equal altogether as many are taken as are still
    wanted. The ranks are saved once as a narrow table, from which row counts
    per rank range (at most 65,536 numbers) and the one range where the count
    passes ``n`` are read; the rows themselves are only filtered, not sorted.
    """
    if n <= 0:
        raise ValueError("sample size must be positive")
    ranked = df.withColumns({
        "_rank": rank_column(seed, key), "_row": F.md5(F.to_json(F.struct(*[F.col(c) for c in df.columns])))})
    ranks = cut_lineage(ranked.select("_rank", "_row"), "ranks")
    prefix = F.substring("_rank", 1, PREFIX)
    counts = ranks.groupBy(prefix.alias("p")).count().toArrow().to_pydict()
    taken = 0
    for p, rows in sorted(zip(counts["p"], counts["count"])):
        if taken + rows > n:
            break
        taken += rows
    else:
        return df
    if taken == n:
        return ranked.where(prefix < p).drop("_rank", "_row")
    order = F.struct("_rank", "_row")
    first = ranks.where(prefix == p).orderBy("_rank", "_row").limit(n - taken)
    cut = first.groupBy("_rank", "_row").count().orderBy(F.desc("_rank"), F.desc("_row")).first()
    at = F.struct(F.lit(cut["_rank"]).alias("_rank"), F.lit(cut["_row"]).alias("_row"))
    last = ranked.where(order == at).limit(cut["count"])
    return ranked.where(order < at).unionByName(last).drop("_rank", "_row")


def first_rows(spark, paths, n):
    """The first ``n`` rows of Parquet files in path and row order.

    Only the row count per file reaches the driver; whole files are kept up to
    the cap and the last one is cut by its row index.
    """
    if n <= 0:
        raise ValueError("the row cap must be positive")
    df = spark.read.parquet(*paths)
    counts = (
        df.groupBy(F.col("_metadata.file_path").alias("f")).count().orderBy("f").collect()
    )
    file, left = F.col("_metadata.file_path"), n
    wanted = F.lit(False)
    whole = []
    for row in counts:
        if row["count"] > left:
            wanted = (file == row["f"]) & (F.col("_metadata.row_index") < left)
            break
        whole.append(row["f"])
        left -= row["count"]
    # One scan; paths are compared as the scan itself spells them.
    return df.where(file.isin(whole) | wanted if whole else wanted)
