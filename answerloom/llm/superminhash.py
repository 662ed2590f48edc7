"""Near-duplicate documents by SuperMinHash signatures, banding and verified links."""

from functools import partial

import numpy as np
from pyspark.sql import functions as F

from answerloom.llm import graph
from answerloom.llm.textscan import gather
from answerloom.session import cut_lineage, ship_package

SLOTS, ROWS = 200, 5
#: Bytes of text a worker turns into signatures together.
PIECE = 500_000


def shingle_sets(data, offsets, k):
    """Per row the sorted distinct k-word shingle hashes.

    Rows with 1 to k - 1 words have one shingle, the whole sequence; rows
    without words have none.
    """
    from answerloom.llm.textscan import R, mix, word_hashes

    words, at = word_hashes(data, offsets, lower=True)
    counts = np.diff(at)
    n = max(0, len(words) - k + 1)
    rolled = np.zeros(n, np.uint64)
    for i in range(k):
        rolled = mix(rolled * R + words[i:i + n])
    sets = []
    for begin, count in zip(at[:-1].tolist(), counts.tolist()):
        if count >= k:
            sets.append(np.unique(rolled[begin:begin + count - k + 1]))
        elif count:
            x = np.array([count], np.uint64)
            for i in range(begin, begin + count):
                x = mix(x * R + words[i:i + 1])
            sets.append(x)
        else:
            sets.append(words[:0])
    return sets


def signatures(sets, m=SLOTS):
    """SuperMinHash: slot s of a set is the least ``rank + draw`` over its elements, where
    every element deals the slots out in a random order of its own (rank = its place).

    All elements of all sets advance one rank together; a set stops once each
    of its slots is below the next rank, as later ranks cannot lower any slot.
    Empty sets get NaN rows.
    """
    from answerloom.llm.textscan import R, mix

    sizes = np.array([len(s) for s in sets])
    low = np.full((len(sets), m), np.inf)
    low[sizes == 0] = np.nan
    if not sizes.sum():
        return low
    x, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order, steps = None, np.arange(1, m + 1, dtype=np.uint64) * R
    for rank in range(m):
        draw = mix(x + steps[rank])
        r = (draw >> np.uint64(32)).astype(np.float64) * 2.0**-32
        k = rank + (((draw & np.uint64(0xFFFFFFFF)) * np.uint64(m - rank)) >> np.uint64(32)).astype(np.int64)
        if order is None:
            slot = k
        else:
            rows = np.arange(len(x))
            slot = order[rows, k].astype(np.int64)
            order[rows, k] = order[:, rank]
            order[:, rank] = slot
        np.minimum.at(low.reshape(-1), owner * m + slot, r + rank)
        going = (low.max(axis=1) >= rank + 1)[owner]
        if not going.any():
            break
        if order is None:
            x, owner, k = x[going], owner[going], k[going]
            order = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (len(x), 1))
            order[np.arange(len(x)), k] = 0
            order[:, 0] = k
        elif not going.all():
            x, owner, order = x[going], owner[going], order[going]
    return low


def band_keys(low, rows=ROWS):
    """One 64-bit key per band of ``rows`` slots."""
    from answerloom.llm.textscan import R, mix

    n, m = low.shape
    bits = low.view(np.uint64).reshape(n, m // rows, rows)
    keys = np.broadcast_to(np.arange(1, m // rows + 1, dtype=np.uint64) * R, bits.shape[:2]).copy()
    for i in range(rows):
        keys = mix(keys * R + bits[:, :, i])
    return keys


def _sketch(k, m, rows, batches):
    import pyarrow as pa

    from answerloom.llm.textscan import kept, mix, pieces, text_bytes

    kept("sketch", object)  # lets go of what other operators keep
    for batch in batches:
        for part in pieces(batch, size=PIECE):
            sets = shingle_sets(*text_bytes(part.column(1)), k)
            n = np.array([len(s) for s in sets], np.int64)
            sums = np.array([[s.sum(dtype=np.uint64), mix(s).sum(dtype=np.uint64)] for s in sets], np.uint64)
            keys = band_keys(signatures(sets, m), rows).view(np.int64)
            full = np.repeat(n > 0, keys.shape[1])
            ends = np.concatenate([[0], np.cumsum(np.where(n > 0, keys.shape[1], 0))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                part.column(0), pa.array(n), pa.array(sums[:, 0].view(np.int64)),
                pa.array(sums[:, 1].view(np.int64)),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.reshape(-1)[full])),
            ], ["id", "n", "set_a", "set_b", "bands"])


def _sets(k, batches):
    import pyarrow as pa

    from answerloom.llm.textscan import pieces, text_bytes

    for batch in batches:
        for part in pieces(batch):
            sets = shingle_sets(*text_bytes(part.column(1)), k)
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64))),
            ], ["id", "shingles"])


def _verified(links, sets, percent):
    """The links (a, b) whose full sets meet the threshold."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    both = links.join(right, "b").join(left, "a")
    return (
        both.where(f"100 * least(size(x), size(y)) >= {percent} * greatest(size(x), size(y))")
        .select("a", "b", F.size("x").alias("n"), F.size("y").alias("m"),
                F.size(F.array_intersect("x", "y")).alias("both"))
        .where(f"100 * both >= {percent} * (n + m - both)").select("a", "b")
    )


def _compare_blocks(percent, table):
    """Links of one block of queries with one block of members, by counting common shingles."""
    import pyarrow as pa

    ids, owner = table["id"].to_numpy(), table["c"].to_numpy()
    asks = table["asks"].to_numpy(zero_copy_only=False)
    column = table["shingles"].combine_chunks()
    sizes = column.value_lengths().to_numpy()
    flat, ends = column.flatten().to_numpy(), np.cumsum(sizes)
    rows = np.flatnonzero(~asks)
    mine = np.repeat(~asks, sizes)
    values, place = flat[mine], np.repeat(np.arange(len(rows)), sizes[rows])
    order = np.argsort(values, kind="stable")
    values, place = values[order], place[order]
    found = []
    for q in np.flatnonzero(asks).tolist():
        own = flat[ends[q] - sizes[q]:ends[q]]
        low, high = np.searchsorted(values, own), np.searchsorted(values, own, "right")
        both = np.bincount(place[gather(low, high - low)], minlength=len(rows))
        near = 100 * both >= percent * (sizes[q] + sizes[rows] - both)
        found += [(ids[q], ids[m]) for m in rows[near & (owner[rows] != owner[q])]]
    return pa.Table.from_pydict({
        "a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})


def _across(split, sets, percent, block=400_000):
    """Links between different components among the members of a hub's mixed buckets.

    Per hub all members outside its largest component are queries against all
    its members. Both sides are dealt into blocks of about ``block`` shingles; a
    task compares two blocks and returns links only, so no pairs are written out.
    """
    sized = split.join(sets.select("id", F.size("shingles").alias("n")), "id")
    parts = sized.groupBy("hub", "c").agg(F.count("*").alias("rows"), F.sum("n").alias("size"))
    hubs = parts.groupBy("hub").agg(
        F.max_by("c", F.struct("rows", "c")).alias("main"), F.max_by("size", F.struct("rows", "c")).alias("main_size"),
        F.sum("size").alias("size"))
    plan = hubs.select(
        "hub", "main", F.ceil(F.col("size") / block).alias("blocks"),
        F.greatest(F.ceil((F.col("size") - F.col("main_size")) / block), F.lit(1)).alias("asking"))
    rows = split.join(plan, "hub")
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    queries = rows.where("c <> main").withColumn("y", own("asking")).withColumn("x", each("blocks")).withColumn("asks", F.lit(True))
    members = rows.withColumn("x", own("blocks")).withColumn("y", each("asking")).withColumn("asks", F.lit(False))
    both = queries.unionByName(members).select("hub", "x", "y", "id", "c", "asks").join(sets, "id")
    return both.groupBy("hub", "x", "y").applyInArrow(partial(_compare_blocks, percent), "a long, b long")


def near_duplicates(docs, id_col="doc_id", text_col="text", k=5, percent=80, slots=SLOTS, rows=ROWS):
    """Groups of near copies: ``(id_col, n_shingles, component_id, kept)``.

    Documents are linked when their distinct k-word shingle sets (words: runs
    of non-space after lower-casing A-Z) have a Jaccard similarity of at least
    ``percent`` / 100; ``component_id`` is the smallest id reachable by links,
    ``kept`` marks the row that stays for its group.

    1. Sketch: set size, a 128-bit set fingerprint and ``slots / rows`` band
       keys of the SuperMinHash signature. At similarity 0.8 and the defaults
       (40 bands of 5) a pair meets in no band with probability 1.3e-7.
    2. Equal sets collapse to their smallest id (a min-aggregate).
    3. Every bucket links its members to its smallest id. These links are
       verified on full sets: per member first the hub it meets most often,
       then whatever still joins two components.
    4. Buckets that still hold several components: all their members outside the
       largest one are queries against the bucket, in blocks, also on full
       sets, so that no link between two bucket members is lost.

    Ids must be long and unique for a group to keep exactly one row; rows that
    repeat an id count as one document. Rows with a NULL id are left out. NULL
    and empty texts have no shingles and stay alone. Other columns are ignored.
    """
    spark = docs.sparkSession
    ship_package(spark)
    text = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id IS NOT NULL")
    sketch = cut_lineage(text.mapInArrow(
        partial(_sketch, k, slots, rows),
        "id long, n long, set_a long, set_b long, bands array<long>"), "sketch")
    full = sketch.where("n > 0")
    reps = full.groupBy("set_a", "set_b", "n").agg(F.min("id").alias("rep"))
    bands = (
        full.join(reps.select(F.col("rep").alias("id")).distinct(), "id", "left_semi")
        .select("id", F.explode("bands").alias("band"))
    )
    hubs = bands.groupBy("band").agg(F.min("id").alias("hub"), F.max("id").alias("last")).where("hub < last")
    members = cut_lineage(bands.join(hubs.select("band", "hub"), "band"), "bucket-members")
    # One row per member and hub, with the number of bands they share.
    stars = cut_lineage(
        members.where("id <> hub").groupBy(F.col("hub").alias("a"), F.col("id").alias("b"))
        .agg(F.count("*").alias("shared")), "star-links")
    wanted = members.select("id").distinct()
    sets = cut_lineage(
        text.join(wanted, "id", "left_semi").mapInArrow(partial(_sets, k), "id long, shingles array<long>"),
        "shingle-sets")
    best = stars.groupBy("b").agg(F.max(F.col("shared") * F.lit(1 << 20)).alias("top"))
    first = (
        stars.join(best, "b").where(F.col("shared") * (1 << 20) == F.col("top"))
        .groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    )
    links = cut_lineage(_verified(first, sets, percent), "links-1")
    label = cut_lineage(graph.components(links), "components")

    def apart(pairs):
        """Pairs whose ends are not in one component yet."""
        near, far = (label.select(F.col("id").alias(c), F.col("component_id").alias(f"c{c}")) for c in "ab")
        return (
            pairs.join(near, "a", "left").join(far, "b", "left")
            .where("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b")
        )

    more = cut_lineage(_verified(apart(stars.select("a", "b")), sets, percent), "links-2")
    links = links.unionByName(more)
    if not more.isEmpty():
        label = cut_lineage(graph.components(links), "components")
    placed = members.join(label, "id", "left").select(
        "hub", "band", "id", F.coalesce("component_id", "id").alias("c"))
    mixed = placed.groupBy("band").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 < c1")
    split = cut_lineage(placed.join(mixed.select("band"), "band").select("hub", "id", "c").distinct(), "mixed-hubs")
    rest = cut_lineage(_across(split, sets, percent), "links-3")
    if not rest.isEmpty():
        label = cut_lineage(graph.components(links.unionByName(rest)), "components")
    named = reps.join(label.withColumnRenamed("id", "rep"), "rep", "left").select(
        "set_a", "set_b", "n", F.coalesce("component_id", "rep").alias("component_id"))
    out = sketch.join(named, ["set_a", "set_b", "n"], "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.col(id_col) == F.col("component_id"))


def drop_near_duplicates(docs, id_col="doc_id", **options):
    """``docs`` without the rows whose group keeps another row; all columns as they are.

    Of a group the row with the smallest id stays. Rows are told apart even if they repeat an
    id: a row goes only if its own shingles are linked to those of a row that stays. Rows with a NULL id
    stay, as do rows without words. An empty table stays empty.

    Where ids repeat, the rows are written once with a number of their own, in the order of their ids.
    """
    row_col = "row"
    while row_col in docs.columns:
        row_col = "_" + row_col
    key = F.col(id_col).cast("long")
    if docs.where(key.isNotNull()).groupBy(key).count().where("count > 1").isEmpty():
        rows = docs.withColumn(row_col, key)
    else:
        order = [key, F.xxhash64(F.col(options.get("text_col", "text")))]
        rows = docs.repartitionByRange(*order).sortWithinPartitions(*order)
        rows = cut_lineage(rows.withColumn(row_col, F.when(key.isNotNull(), F.monotonically_increasing_id())), "rows")
    groups = near_duplicates(rows, row_col, **options)
    gone = cut_lineage(groups.where("NOT kept").select(F.col(row_col).alias("gone_row")), "near-duplicates")
    return rows.join(gone, rows[row_col] == gone["gone_row"], "left_anti").select(*docs.columns)
