"""Packing token documents into fixed-length sequences: dominance reduction, then best fit."""

from functools import partial

import numpy as np
from pyspark.sql import Window, functions as F

from answerloom.llm.chunk_ids import ChunkIds, letter_borders
from answerloom.session import cut_lineage, ship_package

END_ID = 0

_KNOWN = np.zeros(256, bool)  # bytes that are a whole character and no white space
_KNOWN[0x21:0x7F] = True


def _chunk_starts(data, offsets, added=()):
    """Chunks begin with a row, with one white-space byte between characters that are none, and between letter and sign.

    The byte-level word pattern never joins across such a place, so a chunk on
    its own has the ids it has in its text. Around other bytes than ASCII and
    two-byte Latin letters nothing is cut; text with the name of an ``added`` token is only cut at white space.
    """
    from answerloom.llm.textscan import SPACE

    start = SPACE[data]
    before, after = _KNOWN[data], _KNOWN[data] | (data == 0xC3)
    before[1:] |= data[:-1] == 0xC3
    start[1:] &= before[:-1]
    start[:-1] &= after[1:]
    first = offsets[:-1][np.diff(offsets) > 0]
    if len(data):
        start[-1] = start[0] = False
    # A row's last byte has no neighbour to look at.
    start[offsets[1:][np.diff(offsets) > 0] - 1] = False
    start[first] = True
    text = data.tobytes()
    if not any(name in text for name in added):
        start[1:] |= letter_borders(data)
    return np.flatnonzero(start)


#: One word to the byte-level pattern: a blank or none, then ASCII letters or U+00C0 to U+00FF less two signs.
WORD = rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+"


def _row_ids(known, data, offsets):
    """Ids of all rows in one array, each row closed by END_ID, and the rows' offsets in it."""
    import pyarrow as pa

    starts = _chunk_starts(data, offsets, known.added)
    bounds = np.append(starts, len(data))
    chunks = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data)])
    found, lengths = known.lay_out(chunks.dictionary_encode())
    per_row = np.diff(np.concatenate([[0], np.cumsum(lengths)])[np.searchsorted(starts, offsets)])
    ids = np.full(int(per_row.sum()) + len(per_row), END_ID, np.uint32)
    ids[np.arange(len(found)) + np.repeat(np.arange(len(per_row)), per_row)] = found
    return ids, np.concatenate([[0], np.cumsum(per_row + 1)])


def _cut(key, model, capacity, with_ids, batches):
    """Pieces of every row with their number among this task's pieces of equal length."""
    from zlib import crc32

    import pyarrow as pa
    from pyspark import TaskContext

    from answerloom.llm.textscan import kept, pieces, text_bytes

    known, task = kept(("ids", key), lambda: ChunkIds(model.value, WORD, limit=300_000)), TaskContext.get().partitionId()
    seen = np.zeros(capacity + 1, np.int64)
    for batch in batches:
        for part in pieces(batch, size=4_000_000):
            ids, at = _row_ids(known, *text_bytes(part.column(1)))
            total = np.diff(at)
            count = -(-total // capacity)
            row = np.repeat(np.arange(len(total)), count)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            first = (total - (count - 1) * capacity)[row]
            length = np.where(piece == 0, first, capacity)
            start = np.where(piece == 0, 0, first + (piece - 1) * capacity)
            begin = at[:-1][row] + start
            order = np.argsort(length, kind="stable")
            run = length[order]
            rank = np.empty(len(row), np.int64)
            rank[order] = np.arange(len(row)) - np.searchsorted(run, run)
            rank += seen[length]
            seen += np.bincount(length, minlength=capacity + 1)
            bounds = list(zip(begin.tolist(), (begin + length).tolist()))
            columns = [
                part.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start),
                pa.array(length), pa.array([crc32(ids[a:b]) for a, b in bounds], pa.int64()),
                pa.array(np.full(len(row), task, np.int32)), pa.array(rank),
            ]
            names = ["id", "piece", "start", "length", "ids_crc32", "task", "rank"]
            if with_ids:
                # Pieces of a row follow each other, so the flat ids are in piece order.
                columns.append(pa.ListArray.from_arrays(
                    pa.array(np.append(begin, len(ids)).astype(np.int32)), pa.array(ids.astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)


def reduce_by_dominance(counts, capacity):
    """Martello-Toth reduction on a histogram: sets of sizes that some optimal packing contains.

    ``counts[s]`` pieces have size s. For a size j (largest first) all other
    fillings of its bin are dominated
    - by j alone, if nothing fits beside it;
    - by {j, a}, a the largest that fits, if a fills the bin exactly or no two others fit together;
    - by {j, a} or {j, b, c}, if no three others fit: the single piece when it
      is at least as large as the best two together, the two when b is that
      single piece itself, so that no filling has a larger one.
    Returns ``(fixed, left)``: (sizes, how often) pairs and the remaining histogram.
    """
    left = counts.copy()
    fixed = []
    changed = True
    while changed:
        changed = False
        for j in range(capacity, 0, -1):
            while left[j]:
                found = _dominant(left, j, capacity)
                if found is None:
                    break
                need = np.bincount(found, minlength=capacity + 1)
                some = need > 0
                # Repeating is safe while the sizes that decided are all there.
                times = int((left[some] // need[some]).min())
                left -= times * need
                fixed.append((found, times))
                changed = True
    return fixed, left


def _dominant(left, j, capacity):
    rest = left.copy()
    rest[j] -= 1
    room = capacity - j
    sizes = np.flatnonzero(rest[:room + 1])
    sizes = sizes[sizes > 0]
    if not len(sizes):
        return [j]
    single = int(sizes[-1])
    small, total, fits = [], 0, 0
    for s in sizes.tolist():
        small += [s] * min(int(rest[s]), 3 - len(small))
        if len(small) == 3:
            break
    for s in small:
        total += s
        fits += total <= room
    if single == room or fits == 1:
        return [j, single]
    if fits > 2:
        return None
    # For every b the largest c <= b that fits beside it (another piece, if equal).
    at = np.searchsorted(sizes, np.minimum(sizes, room - sizes), "right") - 1
    own = np.arange(len(sizes))
    at -= (at == own) & (rest[sizes] < 2)
    pairs = [(int(sizes[i] + sizes[c]), int(sizes[i])) for i, c in zip(own, at) if c >= 0]
    best = max(pairs, default=(0, 0))
    if single >= best[0]:
        return [j, single]
    if best[1] == single:
        return [j, single, best[0] - single]
    return None


def best_fit(left, capacity):
    """Best fit on a histogram, largest sizes first: (sizes, how many such bins) pairs."""
    open_bins = {}  # room -> {sizes: how many}
    for size in range(capacity, 0, -1):
        n = int(left[size])
        while n:
            room = min((r for r in open_bins if r >= size), default=None)
            if room is None:
                each = min(capacity // size, n)
                sizes, times, room = (), n // each, capacity
            else:
                sizes, times = open_bins[room].popitem()
                if not open_bins[room]:
                    del open_bins[room]
                each = min(room // size, n)
                used = min(times, n // each)
                if used < times:
                    open_bins.setdefault(room, {})[sizes] = times - used
                times = used
            bins = open_bins.setdefault(room - each * size, {})
            sizes += (size,) * each
            bins[sizes] = bins.get(sizes, 0) + times
            n -= each * times
    return [(list(sizes), times) for bins in open_bins.values() for sizes, times in bins.items()]


def plan(counts, capacity):
    """Rows ``(length, low, high, sequence, bins, offset)``: where the ``rank``-th piece of a length goes.

    With r = rank - low the piece is in sequence + r % bins, at offset + length * (r // bins).
    """
    fixed, left = reduce_by_dominance(counts, capacity)
    used, sequence, rows = np.zeros(capacity + 1, np.int64), 0, []
    for sizes, times in fixed + best_fit(left, capacity):
        offset = 0
        for size in sorted(set(sizes), reverse=True):
            n = sizes.count(size) * times
            rows.append((size, int(used[size]), int(used[size]) + n, sequence, times, offset))
            used[size] += n
            offset += size * sizes.count(size)
        sequence += times
    return rows


def pack_documents(docs, tokenizer_path, id_col="doc_id", text_col="text", capacity=2048, with_ids=False):
    """Every document's token pieces, placed into sequences of at most ``capacity`` tokens.

    Columns: ``id_col, piece, start, length, ids_crc32, sequence_id, offset`` and,
    if asked for, ``ids``. A document is the ids of the byte-level tokenizer
    file at ``tokenizer_path`` without added special tokens, then id 0. Only
    documents above ``capacity`` are cut; their first piece is the short one.
    NULL and empty texts are the single id 0. Rows with NULL or repeated ids
    are packed like any other. Other columns are ignored.

    The pieces are numbered per length inside their task and written; only the
    histogram of lengths (at most ``capacity`` numbers, whatever the corpus)
    goes to the driver. The reduction and best fit work on that histogram, and
    their plan (bounded by ``capacity`` as well) is broadcast. Nothing else is
    gathered, and no length is a shuffle key of its own.
    """
    spark = docs.sparkSession
    ship_package(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        model = spark.sparkContext.broadcast(f.read())
    fields = "id long, piece int, start long, length long, ids_crc32 long, task int, rank long"
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    cut = cut_lineage(rows.mapInArrow(
        partial(_cut, tokenizer_path, model, capacity, with_ids),
        fields + (", ids array<int>" if with_ids else "")), "pieces")
    sizes = cut.groupBy("task", "length").agg(F.count("*").alias("n"))
    histogram = np.zeros(capacity + 1, np.int64)
    for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect():
        histogram[r["length"]] = r["n"]
    where = spark.createDataFrame(
        plan(histogram, capacity), "length long, low long, high long, base long, bins long, at long")
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sizes.select("task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("ahead"))
    nth = F.col("rank") + F.col("ahead")
    placed = (
        cut.join(ahead, ["task", "length"])
        .withColumn("nth", nth).join(F.broadcast(where), "length").where("nth >= low AND nth < high")
    )
    r = F.col("nth") - F.col("low")
    return placed.select(
        F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32",
        (F.col("base") + r % F.col("bins")).alias("sequence_id"),
        (F.col("at") + F.col("length") * F.floor(r / F.col("bins"))).alias("offset"),
        *["ids"] * with_ids,
    )
