"""Row numbering, epoch shuffles and batches."""

from pyspark.sql import functions as F

from answerloom.operators import batches as bt
from answerloom.plans import fixtures as fx
from answerloom.plans.catalog.registry import query

_ROWS = """r AS (SELECT source AS file, doc_id,
  row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS row_index FROM documents)"""


@query(f"WITH {_ROWS} SELECT file, doc_id, row_index, CAST(row_index // 16 AS BIGINT) AS chunk_no FROM r")
def chunk_numbers(spark, d):
    return bt.chunk_numbers(fx.file_rows(spark, d), 16).select("file", "doc_id", "row_index", "chunk_no")


@query("""SELECT event_type, event_id,
row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS row_index FROM events""")
def numbered_in_ranges(spark, d):
    """Row numbers of large groups, counted range by range."""
    events = fx.table(spark, d, "events").select("event_type", "event_id")
    return bt.index_rows(events, "event_type", "event_id", range_size=500).select(
        "event_type", "event_id", "row_index"
    )


def _batches_sql(epochs, size, row_batch, row_order, file_order, keep):
    return f"""WITH {_ROWS}, e AS (SELECT CAST(unnest(range({epochs})) AS INTEGER) AS epoch),
  ranked AS (SELECT epoch, r.*, row_index // {row_batch} AS row_batch, {row_order} AS rr, {file_order} AS fr FROM r, e),
  placed AS (SELECT *, row_number() OVER (PARTITION BY epoch, file, row_batch ORDER BY rr, row_index) - 1 AS slot,
    count(*) OVER (PARTITION BY epoch, file, row_batch) AS size FROM ranked),
  kept AS (SELECT *, slot // {size} AS piece FROM placed WHERE {keep}),
  numbered AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY epoch ORDER BY fr, file, row_batch, piece) - 1 AS BIGINT)
    AS batch_id, CAST(slot % {size} AS INTEGER) AS pos FROM kept)"""


_MD5 = "md5(concat_ws('|', '42', CAST(epoch AS VARCHAR), file{}))"


@query(_batches_sql(2, 8, 32, _MD5.format(", CAST(row_index AS VARCHAR)"), _MD5.format(""), "(slot // 8 + 1) * 8 <= size")
       + " SELECT epoch, file, doc_id, batch_id, pos, CAST(pos // 4 AS INTEGER) AS device_id FROM numbered")
def epoch_batches(spark, d):
    """Two shuffled epochs, full batches of 8 on two devices."""
    out = bt.plan_batches(
        fx.file_rows(spark, d), 8, 4, epochs=2, devices=2, seed=42, min_row_batch=32
    )
    return out.select("epoch", "file", "doc_id", "batch_id", "pos", "device_id")


@query(_batches_sql(1, 16, 256, "row_index", "file", "true")
       + " SELECT file, doc_id, batch_id, pos FROM numbered WHERE batch_id < 20")
def eval_batches(spark, d):
    """The first 20 batches of the unshuffled evaluation order, short pieces kept."""
    out = bt.plan_batches(
        fx.file_rows(spark, d), 16, 4, shuffle_files=False, shuffle_rows=False, drop_last=False, first=20
    )
    return out.select("file", "doc_id", "batch_id", "pos")
