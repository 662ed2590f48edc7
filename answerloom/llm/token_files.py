"""Token-id files: documents' ids in grammar-compressed records that can be read at any place.

A record holds the ids of some documents, in order, as blocks of at most ``BLOCK_IDS`` ids. Each block
has its own Re-Pair grammar: rules that stand for two symbols each, how many ids every rule
expands to, and the remaining symbols. Symbols never cross the end of a document.

Layout (little-endian): ``RPID``, u32 crc32 of all that follows, u64 bytes that follow, u32 part, u32 number
of the record in its part, u32 documents, u32 blocks, u64 ids; per document i64 id, u8 1 if the id is
NULL, u64 ids; per block u32 first rule symbol, u32 rules, u32 symbols, u32 ids, u8 bytes per
symbol; u32 left and right and expansion length of each rule; the symbols; every ``SAMPLED``-th
symbol's first id as u32. A zero byte ends the record.
"""

import struct
import zlib
from functools import partial

import numpy as np
from pyspark.sql import Window, functions as F

from answerloom.llm.chunk_ids import ChunkIds, letter_borders
from answerloom.llm.textscan import SPACE, gather, kept, pieces, text_bytes
from answerloom.session import cut_lineage, ship_package

MAGIC = b"RPID"
_HEAD = struct.Struct("<4sIQIIIIQ")
_BLOCK = struct.Struct("<IIIIB")
_DOC = np.dtype([("id", "<i8"), ("null", "u1"), ("n", "<u8")])
BLOCK_IDS = 1_000_000
SAMPLED = 1_024
LEAST = 4  # a pair must occur so often to become a rule


# ---- grammar -------------------------------------------------------------------------------

def _chosen(pairs, shift, counts, room):
    """Frequent pairs, most frequent first, none of which can overlap another: (left, right) symbols.

    No symbol is the left part of one and the right part of another, and a
    doubled symbol is in no other pair. Only pairs at least a sixteenth as frequent as the first
    are taken, so the most frequent ones are still replaced before they can be broken up.
    """
    top = np.flatnonzero(counts >= counts.max() // 16)
    top = top[np.argsort(-counts[top], kind="stable")]
    lefts, rights, out = set(), set(), []
    for left, right in zip((pairs[top] >> shift).tolist(), (pairs[top] & (1 << shift) - 1).tolist()):
        if left in rights or right in lefts or (left == right and (left in lefts or right in rights)):
            continue
        out.append((left, right))
        lefts.add(left)
        rights.add(right)
        if len(out) == room:
            break
    return out


def _apart(places):
    """Of each run of neighbouring places the first, third, ...: places that do not overlap."""
    begins = np.concatenate(([True], np.diff(places) != 1)) if len(places) else np.zeros(0, bool)
    at = np.arange(len(places))
    return places[(at - np.maximum.accumulate(np.where(begins, at, 0))) % 2 == 0]


def repair(ids, ends, max_rules=1 << 24):
    """Re-Pair in rounds: ``(first rule symbol, left, right, symbols)``.

    ``ends`` marks the last id of each document. A round counts the pairs of
    neighbouring symbols, takes frequent ones that cannot overlap and puts a new symbol in their
    places; it ends when no pair occurs ``LEAST`` times or the rules run out.
    """
    symbols, ends = ids.astype(np.uint64), ends.copy()
    first = int(ids.max()) + 1 if len(ids) else 0
    narrow = first < 65_536
    if narrow:
        max_rules = min(max_rules, 65_536 - first)  # all symbols fit in two bytes
        symbols = symbols.astype(np.uint32)
    shift = symbols.dtype.type(16 if narrow else 32)
    spread = symbols.dtype.type(0x9E3779B1 if narrow else 0x9E3779B97F4A7C15)
    # Places whose pair may still be frequent: a rare pair of old symbols never becomes so.
    alive = ~ends
    left, right = [], []
    while len(symbols) > 1 and len(left) < max_rules:
        at = np.flatnonzero(alive[:-1])
        a, b = symbols.take(at), symbols.take(at + 1)
        double = np.flatnonzero(a == b)
        if len(double):
            single = np.ones(len(at), bool)
            single[double] = False
            single[np.searchsorted(at, _apart(at[double]))] = True
            at, a, b = at[single], a[single], b[single]
        keys = a << shift | b
        ordered = np.sort(keys)
        begin = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(keys) else at
        counts = np.diff(np.append(begin, len(ordered)))
        frequent = counts >= LEAST
        if not frequent.any():
            break
        pairs, counts = ordered[begin[frequent]], counts[frequent]
        slot = lambda key: (key * spread) >> symbols.dtype.type(12 if narrow else 44)
        known = np.zeros(1 << 20, bool)
        known[slot(pairs)] = True
        alive[at[~known.take(slot(keys))]] = False

        new = np.array(_chosen(pairs.astype(np.int64), int(shift), counts, max_rules - len(left)), np.int64)
        is_left, is_right = np.zeros((2, first + len(left)), bool)
        is_left[new[:, 0]] = True
        is_right[new[:, 1]] = True
        maybe = np.flatnonzero(is_left.take(a) & is_right.take(b))
        chosen = (new[:, 0] << int(shift) | new[:, 1]).astype(symbols.dtype)
        rank = np.argsort(chosen)
        chosen = chosen[rank]
        found = np.minimum(np.searchsorted(chosen, keys.take(maybe)), len(new) - 1)
        hit = chosen[found] == keys.take(maybe)
        place = at.take(maybe[hit])
        symbols[place] = first + len(left) + rank[found[hit]]
        ends[place] = ends[place + 1]
        alive[place] = ~ends[place]
        before = place[place > 0] - 1
        alive[before] = ~ends[before]
        keep = np.ones(len(symbols), bool)
        keep[place + 1] = False
        symbols, ends, alive = symbols[keep], ends[keep], alive[keep]
        left += new[:, 0].tolist()
        right += new[:, 1].tolist()
    return first, np.array(left, np.int64), np.array(right, np.int64), symbols.astype(np.int64)


def _lengths(first, left, right):
    """How many ids each rule stands for; a rule only uses symbols made before it."""
    out = []
    for a, b in zip(left.tolist(), right.tolist()):
        out.append((1 if a < first else out[a - first]) + (1 if b < first else out[b - first]))
    return np.array(out, np.int64)


def expand(symbols, first, left, right):
    """The ids of some symbols, one level of rules at a time."""
    out = np.asarray(symbols, np.int64)
    while (deep := out >= first).any():
        width = 1 + deep
        begin = np.cumsum(width) - width
        wide = np.empty(int(width.sum()), np.int64)
        wide[begin[~deep]] = out[~deep]
        wide[begin[deep]] = left[out[deep] - first]
        wide[begin[deep] + 1] = right[out[deep] - first]
        out = wide
    return out


def expand_by_lengths(symbols, first, left, right, lengths):
    """As ``expand``, with the ids of every rule laid out once, if those are no longer than the text's."""
    spans = np.concatenate((np.ones(first, np.int64), lengths))[symbols]
    if lengths.sum() > spans.sum():
        return expand(symbols, first, left, right)
    rules = expand(first + np.arange(len(left)), first, left, right)
    begins = np.concatenate((np.arange(first), first + np.cumsum(lengths) - lengths))
    return np.concatenate((np.arange(first), rules))[gather(begins[symbols], spans)]


# ---- records -------------------------------------------------------------------------------

def block_bytes(ids, ends):
    first, left, right, symbols = repair(ids, ends)
    lengths = _lengths(first, left, right)
    width = 2 if first + len(left) <= 65_536 else 4
    spans = np.ones(len(symbols), np.int64)
    rules = symbols >= first
    spans[rules] = lengths[symbols[rules] - first]
    sampled = (np.cumsum(spans) - spans)[::SAMPLED]
    parts = [left, right, lengths]
    return (
        _BLOCK.pack(first, len(left), len(symbols), len(ids), width)
        + b"".join(p.astype("<u4").tobytes() for p in parts)
        + symbols.astype(f"<u{width}").tobytes() + sampled.astype("<u4").tobytes())


def record_bytes(part, number, doc_ids, sizes, blocks):
    """A record of documents ``doc_ids`` (None: NULL) with ``sizes`` ids each; ``blocks`` are made already."""
    docs = np.zeros(len(doc_ids), _DOC)
    docs["id"], docs["null"], docs["n"] = [i or 0 for i in doc_ids], [i is None for i in doc_ids], sizes
    body = docs.tobytes() + b"".join(blocks)
    head = _HEAD.pack(MAGIC, 0, len(body), part, number, len(docs), len(blocks), int(docs["n"].sum()))
    return MAGIC + struct.pack("<I", zlib.crc32(body, zlib.crc32(head[8:]))) + head[8:] + body + b"\0"


class Record:
    """A record at ``at`` of a file's bytes; blocks are expanded only when asked for."""

    def __init__(self, data, at=0, check=True):
        magic, crc, size, self.part, self.number, docs, self.n_blocks, self.n_ids = _HEAD.unpack_from(data, at)
        body = at + _HEAD.size
        self.end = body + size + 1
        if magic != MAGIC or self.end > len(data) or data[self.end - 1]:
            raise ValueError(f"no whole record at byte {at}")
        if check and zlib.crc32(memoryview(data)[at + 8:self.end - 1]) != crc:
            raise ValueError(f"damaged record at byte {at}")
        self.docs = np.frombuffer(data, _DOC, docs, body)
        self.data, self.first_block = data, body + docs * _DOC.itemsize

    def blocks(self):
        """``(first id, ids, reader)`` per block; ``reader(low, high)`` expands the symbols between two ids."""
        at, begin = self.first_block, 0
        for _ in range(self.n_blocks):
            first, rules, symbols, n, width = _BLOCK.unpack_from(self.data, at)
            at += _BLOCK.size
            left, right, lengths = np.frombuffer(self.data, "<u4", 3 * rules, at).reshape(3, rules).astype(np.int64)
            at += 12 * rules
            text = np.frombuffer(self.data, f"<u{width}", symbols, at)
            at += width * symbols
            sampled = np.frombuffer(self.data, "<u4", -(-symbols // SAMPLED), at)
            at += 4 * len(sampled)
            yield begin, n, partial(_part, first, left, right, lengths, text, sampled)
            begin += n

    def ids(self, low=0, high=None):
        """Ids ``low`` to ``high`` of the record; only blocks and symbols that hold them are expanded."""
        high = self.n_ids if high is None else high
        parts = [
            read(max(low - begin, 0), min(high - begin, n))
            for begin, n, read in self.blocks() if begin < high and low < begin + n
        ]
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def _part(first, left, right, lengths, text, sampled, low, high):
    begin = max(int(np.searchsorted(sampled, low, "right")) - 1, 0)
    stop = int(np.searchsorted(sampled, high, "left"))
    some = text[begin * SAMPLED:stop * SAMPLED].astype(np.int64)
    ids = expand_by_lengths(some, first, left, right, lengths).astype(np.uint32)
    skip = low - int(sampled[begin])
    return ids[skip:skip + high - low]


def records(data, check=True):
    at = 0
    while at < len(data):
        record = Record(data, at, check)
        yield record
        at = record.end


# ---- encoding ------------------------------------------------------------------------------

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
#: Small letters alone (a to z, U+00DF to U+00FF less the division sign): one word, which no normaliser changes.
SMALL = rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+"


def _row_ids(known, data, offsets):
    """Ids of rows of text, and how many each row has.

    Chunks end at white space, which only separates, and between an ASCII letter and a
    sign, where the word pattern never joins. ASCII capitals are lowered, as the
    tokenizer does. Text with the name of an added token is only cut at white space.
    """
    import pyarrow as pa

    lower = _LOWER[data]
    text = lower.tobytes()
    plain = not any(name.lower() in text for name in known.added)
    data = lower if plain else data
    inside = ~SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets[:-1]] = True
    border = first[1:-1].copy()
    if plain:
        border |= letter_borders(data)
    start, stop = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1] | border
    stop[:-1] &= ~inside[1:] | border
    starts, ends = np.flatnonzero(start), np.flatnonzero(stop) + 1
    bounds = np.concatenate(([0], np.cumsum(ends - starts)))
    coded = pa.Array.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data[inside])]).dictionary_encode()
    ids, sized = known.lay_out(coded)
    total = np.concatenate(([0], np.cumsum(sized)))
    return ids, np.diff(total[np.searchsorted(starts, offsets)])


def _sections(batch, size=4_000_000):
    """``(ids column, data, offsets, open)`` of a batch; a long text comes in several sections, cut at white space."""
    for part in pieces(batch, size=size):
        data, offsets = text_bytes(part.column(1))
        at = 0
        while len(data) - at > 2 * size:
            end = at + size
            while end < len(data) and not SPACE[data[end]]:
                ahead = np.flatnonzero(SPACE[data[end:end + 65_536]])
                end = min(end + (int(ahead[0]) if len(ahead) else 65_536), len(data))
            if end < len(data):
                yield part.column(0).to_pylist(), data[at:end], np.array([0, end - at]), True
            else:
                break
            at = end
        yield part.column(0).to_pylist(), data[at:], np.maximum(offsets - at, 0), False


class _Writer:
    """Collects documents into records; a block is compressed as soon as it is full."""

    def __init__(self, part, size):
        self.part, self.size, self.number = part, size, 0
        self._clear()

    def _clear(self):
        self.docs, self.sizes, self.blocks, self.held, self.waiting, self.stored = [], [], [], [], 0, 0

    def _block(self):
        """Compress what is waiting, in even blocks."""
        if not self.waiting:
            return
        ids = np.concatenate([i for i, _ in self.held])
        ends = np.concatenate([e for _, e in self.held])
        cuts = np.linspace(0, len(ids), -(-len(ids) // self.size) + 1).astype(int)
        self.blocks += [block_bytes(ids[a:b], ends[a:b]) for a, b in zip(cuts, cuts[1:])]
        self.stored += len(ids)
        self.held, self.waiting = [], 0

    def add(self, ids, ends):
        self.held.append((ids, ends))
        self.waiting += len(ids)

    def close(self):
        """The record of all documents so far, or None."""
        if not self.docs:
            return None
        self._block()
        out = record_bytes(self.part, self.number, self.docs, self.sizes, self.blocks)
        self.number += 1
        self._clear()
        return out


def _write(key, model, end_id, size, batches):
    """Records of sorted rows ``(id, text)``, without their last byte, which is the sink's line end."""
    import pyarrow as pa
    from pyspark import TaskContext

    known = kept(("chunks", key), lambda: ChunkIds(model.value, SMALL))
    writer = _Writer(TaskContext.get().partitionId(), size)
    row = lambda record: pa.RecordBatch.from_arrays([pa.array([record[:-1]], pa.binary())], ["record"])
    open_ids = 0
    for batch in batches:
        for doc_ids, data, offsets, unfinished in _sections(batch):
            ids, counts = _row_ids(known, data, offsets)
            if unfinished:
                writer.add(ids, np.zeros(len(ids), bool))
                open_ids += len(ids)
                if writer.waiting >= size:
                    writer._block()
                continue
            # Every document is closed by the end id.
            stops = np.cumsum(counts + 1)
            closed = np.full(len(ids) + len(counts), end_id, np.uint32)
            closed[np.arange(len(ids)) + np.repeat(np.arange(len(counts)), counts)] = ids
            ends = np.zeros(len(closed), bool)
            ends[stops - 1] = True
            sizes = (counts + 1).tolist()
            sizes[0] += open_ids
            open_ids, low, begin = 0, 0, 0
            while low < len(sizes):
                # A record is closed with the document that fills it.
                room = max(size - writer.stored - writer.waiting, 1)
                high = min(int(np.searchsorted(stops, begin + room)) + 1, len(sizes))
                stop = int(stops[high - 1])
                writer.add(closed[begin:stop], ends[begin:stop])
                writer.docs += doc_ids[low:high]
                writer.sizes += sizes[low:high]
                if writer.stored + writer.waiting >= size:
                    yield row(writer.close())
                low, begin = high, stop
    record = writer.close()
    if record:
        yield row(record)


def write_token_files(docs, path, tokenizer_path, end_id, id_col="doc_id", text_col="text",
                      size=BLOCK_IDS, per_file=16):
    """Encode every row and write its ids, closed by ``end_id``, below ``path`` in ascending id order.

    Ids are those of the tokenizer file at ``tokenizer_path`` without added special tokens; its words must
    end at white space. NULL ids come first, rows of one id in the order of a hash of their
    text; NULL and empty texts are the end id alone. Other columns are ignored.

    Rows are dealt by ranges of (id, hash), so an id on many rows with different texts is split, and a task
    reads its range as a stream: it holds one block of ids and the words it remembers. A record
    has about ``size`` ids, a file ``per_file`` records. Files go through Spark's text sink and its commit, so a
    lost task leaves nothing behind.
    """
    spark = docs.sparkSession
    ship_package(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        model = spark.sparkContext.broadcast(f.read())
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    ).withColumn("hash", F.xxhash64("text"))
    order = [F.col("id").asc_nulls_first(), F.col("hash")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text")
    made = ordered.mapInArrow(partial(_write, tokenizer_path, model, end_id, size), "record binary")
    made.select(F.col("record").cast("string")).write.option("lineSep", "\0").option(
        "maxRecordsPerFile", per_file).text(path)


# ---- reading -------------------------------------------------------------------------------

def _files(spark, path):
    return spark.read.format("binaryFile").load(path)


def _headers(batches):
    import pyarrow as pa

    for batch in batches:
        rows = [
            (file, r.part, r.number, r.n_ids) for file, data in zip(*(c.to_pylist() for c in batch.columns))
            for r in records(data, check=False)]
        columns = list(zip(*rows)) or [[]] * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, [pa.string()] + [pa.int64()] * 3)], ["file", "part", "number", "n_ids"])


def record_starts(spark, path):
    """``(file, part, number, n_ids, first)`` of every record: how many ids stand before it in all files."""
    ship_package(spark)
    heads = _files(spark, path).select("path", "content").mapInArrow(
        _headers, "file string, part long, number long, n_ids long")
    heads = cut_lineage(heads, "record-heads")
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = heads.groupBy("part").agg(F.sum("n_ids").alias("n"))  # a row per task that wrote
    parts = sums.select("part", F.coalesce(F.sum("n").over(before(Window.orderBy("part"))), F.lit(0)).alias("base"))
    own = F.coalesce(F.sum("n_ids").over(before(Window.partitionBy("part").orderBy("number"))), F.lit(0))
    return heads.withColumn("own", own).join(parts, "part").select(
        "file", "part", "number", "n_ids", (F.col("base") + F.col("own")).alias("first"))


def _digests(record):
    """The CRC-32 of each document's ids, block by block."""
    out, crc, stops = [], 0, np.cumsum(record.docs["n"]).astype(np.int64).tolist()
    for begin, n, read in record.blocks():
        ids, at = read(0, n), 0
        while at < n:
            take = min(stops[len(out)] - begin - at, n - at)
            crc = zlib.crc32(ids[at:at + take], crc)
            at += take
            if begin + at == stops[len(out)]:
                out.append(crc)
                crc = 0
    return out


def _read(with_ids, batches):
    import pyarrow as pa

    for batch in batches:
        for data in batch.column(0).to_pylist():
            for r in records(data):
                n = len(r.docs)
                sizes = r.docs["n"].astype(np.int64)
                same = lambda v: pa.array(np.full(n, v, np.int64))
                columns = {
                    "part": same(r.part), "number": same(r.number), "place": pa.array(np.arange(n)),
                    "id": pa.array(r.docs["id"].astype(np.int64), mask=r.docs["null"].astype(bool)),
                    "start": pa.array(np.cumsum(sizes) - sizes), "n_tokens": pa.array(sizes),
                    "ids_crc32": pa.array(_digests(r), pa.int64())}
                if with_ids:
                    bounds = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                    columns["ids"] = pa.ListArray.from_arrays(pa.array(bounds), pa.array(r.ids().astype(np.int32)))
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def read_token_files(spark, path, id_col="doc_id", with_ids=False):
    """Documents of the files below ``path``: ``id_col, start, n_tokens, ids_crc32`` and, if asked for, ``ids``.

    ``start`` counts the ids of all documents before. Every record is checked against its
    CRC; a damaged one is an error. Records are read where Spark puts their files; only the heads of
    records are gathered, and joined by (part, number).
    """
    ship_package(spark)
    fields = "part long, number long, place long, id long, start long, n_tokens long, ids_crc32 long"
    docs = _files(spark, path).select("content").mapInArrow(
        partial(_read, with_ids), fields + (", ids array<int>" if with_ids else ""))
    firsts = record_starts(spark, path).select("part", "number", "first")
    return docs.join(firsts, ["part", "number"]).select(
        F.col("id").alias(id_col), (F.col("first") + F.col("start")).alias("start"), "n_tokens", "ids_crc32",
        *["ids"] * with_ids)


def _ranges(batches):
    import pyarrow as pa

    for batch in batches:
        for data, wanted in zip(*(c.to_pylist() for c in batch.columns)):
            want = {(w["part"], w["number"]): (w["first"], w["low"], w["high"]) for w in wanted}
            for r in records(data, check=False):
                first, low, high = want.get((r.part, r.number), (0, 0, 0))
                if low < high:
                    ids = r.ids(low - first, high - first).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([low]), pa.array([ids.tolist()], pa.list_(pa.int32()))], ["start", "ids"])


def read_range(spark, path, start, n):
    """Ids ``start`` to ``start + n`` of all files: ``(start, ids)``, a row per record that holds some.

    Only files with such records are read, and of those only the symbols that expand to wanted ids.
    """
    low, high = F.greatest("first", F.lit(start)), F.least(F.col("first") + F.col("n_ids"), F.lit(start + n))
    wanted = (
        record_starts(spark, path).withColumns({"low": low, "high": high}).where("low < high")
        .groupBy(F.col("file").alias("path")).agg(F.collect_list(F.struct("part", "number", "first", "low", "high")).alias("wanted"))
    )
    files = _files(spark, path).select("path", "content").join(wanted, "path")
    return files.select("content", "wanted").mapInArrow(_ranges, "start long, ids array<int>")
