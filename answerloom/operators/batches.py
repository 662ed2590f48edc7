"""Epoch shuffling and fixed-size batches as columns on token rows."""

from pyspark.sql import Window, functions as F

from answerloom.operators.sampling import rank_column

BLOCK = 4_096  # row batches listed by one task at a time


def index_rows(df, group, order, range_size=1_000_000):
    """Number the rows of each group by an integer column, from 0.

    Rows are numbered inside ranges of ``range_size`` order values and shifted
    by the rows in earlier ranges, so a group of any size never meets in one
    task; only its range counts do.
    """
    ranged = df.withColumn("_range", F.floor(F.col(order) / range_size))
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy(group, "_range").count()
        .select(group, "_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    )
    inside = Window.partitionBy(group, "_range").orderBy(order)
    return (
        ranged.join(offsets, [group, "_range"])
        .withColumn("row_index", F.col("_offset") + F.row_number().over(inside) - 1)
        .drop("_range", "_offset")
    )


def chunk_numbers(df, rows_per_chunk):
    """Chunk number of an indexed row inside its group."""
    return df.withColumn("chunk_no", F.floor(F.col("row_index") / rows_per_chunk))


def _pieces(rows, batch_size, drop_last):
    per = rows / F.lit(batch_size)
    return (F.floor(per) if drop_last else F.ceil(per)).cast("long")


def row_batches(files, batch_size, row_batch, epochs, shuffle_files, drop_last, seed):
    """One row per (epoch, file, row batch) with its size and first batch number.

    ``files`` holds ``file, n``. Only one number per file enters the running sum;
    the row batches of a huge file are listed in blocks spread over tasks.
    """
    n = F.col("n")
    full = F.floor(n / row_batch).cast("long")
    tail = n - full * row_batch
    per_full = _pieces(F.lit(row_batch), batch_size, drop_last)
    in_epochs = files.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    order = rank_column(seed, "epoch", "file") if shuffle_files else F.col("file")
    earlier = (
        Window.partitionBy("epoch").orderBy("_order", "file")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    last = F.floor((n - 1) / row_batch)
    blocks = (
        in_epochs.withColumn("_order", order)
        .withColumn("_batches", full * per_full + _pieces(tail, batch_size, drop_last))
        .withColumn("_first", F.coalesce(F.sum("_batches").over(earlier), F.lit(0)))
        .select("epoch", "file", "n", "_first", F.explode(_numbers(0, last / BLOCK)).alias("_block"))
        .repartition("epoch", "file", "_block")
    )
    start = F.col("_block") * BLOCK
    end = F.least(start + BLOCK - 1, last)
    return blocks.select(
        "epoch", "file", "n", "_first", F.explode(F.sequence(start, end)).alias("row_batch")
    ).select(
        "epoch", "file", "row_batch",
        F.least(F.lit(row_batch), n - F.col("row_batch") * row_batch).alias("_size"),
        (F.col("_first") + F.col("row_batch") * per_full).alias("_batch"),
    )


def _numbers(first, last):
    return F.sequence(F.lit(first).cast("long"), F.floor(last))


def plan_batches(
    rows, batch_size, multiplier=4, epochs=1, shuffle_files=True, shuffle_rows=True,
    drop_last=True, devices=None, seed=42, min_row_batch=256, first=None,
):
    """Give every row its ``epoch``, ``batch_id``, ``pos`` and optional ``device_id``.

    ``rows`` carries ``file`` and ``row_index``. Files are shuffled, then rows
    inside row batches of ``max(batch_size * multiplier, min_row_batch)``; rows
    never leave their row batch. Each row batch is cut into batches, and
    ``drop_last`` drops its short piece. ``first`` keeps the first batches of
    every epoch only, and prunes the row batches behind them at once.

    Places are worked out on (file, row_index) alone, by (epoch, file, row
    batch), a key that holds at most one row batch. The rows themselves are
    shuffled once, whatever the number of epochs, when they meet their places.
    """
    if devices is not None:
        if batch_size % devices:
            raise ValueError(f"batch size {batch_size} is not divisible by {devices} devices")
        if not drop_last:
            raise ValueError("device sharding needs full batches (drop_last=True)")
    row_batch = max(batch_size * multiplier, min_row_batch)
    files = rows.groupBy("file").agg(F.count("*").alias("n"))
    slots = row_batches(files, batch_size, row_batch, epochs, shuffle_files, drop_last, seed)
    if first is not None:
        slots = slots.where(F.col("_batch") < first)
    keyed = rows.select("file", "row_index").withColumns({
        "epoch": F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))),
        "row_batch": F.floor(F.col("row_index") / row_batch),
    })
    order = rank_column(seed, "epoch", "file", "row_index") if shuffle_rows else F.col("row_index")
    inside = Window.partitionBy("epoch", "file", "row_batch").orderBy("_order", "row_index")
    at = (
        keyed.join(slots, ["epoch", "file", "row_batch"])
        .withColumn("_order", order)
        .withColumn("_at", F.row_number().over(inside) - 1)
        .withColumn("_piece", F.floor(F.col("_at") / batch_size))
    )
    if drop_last:
        at = at.where((F.col("_piece") + 1) * batch_size <= F.col("_size"))
    out = at.withColumns({
        "batch_id": F.col("_batch") + F.col("_piece"),
        "pos": (F.col("_at") % batch_size).cast("int"),
    })
    if devices is not None:
        out = out.withColumn("device_id", F.floor(F.col("pos") / (batch_size // devices)).cast("int"))
    if first is not None:
        out = first_batches(out, first)
    places = out.drop("_size", "_batch", "_order", "_at", "_piece")
    return rows.join(places, ["file", "row_index"])


def first_batches(batches, n):
    return batches.where(F.col("batch_id") < n)


def read_order(batches, partitions):
    """Lay batches out in training order: ranges of batches, sorted inside."""
    return batches.repartitionByRange(partitions, "epoch", "batch_id").sortWithinPartitions(
        "epoch", "batch_id", "pos"
    )
