"""Token counts of a piece vocabulary by heap-and-linked-list merging, without making ids."""

from functools import partial
from heapq import heapify, heappop, heappush

import numpy as np
from pyspark.sql import functions as F

from answerloom.llm.textscan import Memo, Pool
from answerloom.session import ship_package

MARK = "▁"


def load_pieces(path):
    """Ranks of the mergeable pieces of a sentencepiece BPE model: 0 is merged first."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [
        i for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))
    ]
    pieces = {model.id_to_piece(i): -model.get_score(i) for i in ids}
    if any(MARK in p.lstrip(MARK) for p in pieces):
        raise ValueError("pieces that span words are not supported")
    return pieces


def count_pieces(text, ranks):
    """Number of tokens of one chunk whose blanks are marks already.

    Symbols stand in a linked list; a heap holds the adjacent pairs that form a
    piece. The lowest rank (ties: leftmost) is merged first. The count is the
    symbols less the merges; a character outside the vocabulary counts its bytes.
    """
    symbols = list(text)
    n = len(symbols)
    get = ranks.get
    heap = []
    for i in range(n - 1):
        rank = get(symbols[i] + symbols[i + 1])
        if rank is not None:
            heap.append((rank, i, 2))
    merges = 0
    if heap:
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            _, i, size = heappop(heap)
            left = symbols[i]
            if left is None:
                continue
            j = after[i]
            if j == n or len(left) + len(symbols[j]) != size:
                continue
            merged = symbols[i] = left + symbols[j]
            symbols[j] = None
            merges += 1
            j = after[i] = after[j]
            if j < n:
                before[j] = i
                rank = get(merged + symbols[j])
                if rank is not None:
                    heappush(heap, (rank, i, len(merged) + len(symbols[j])))
            j = before[i]
            if j >= 0:
                rank = get(symbols[j] + merged)
                if rank is not None:
                    heappush(heap, (rank, j, len(symbols[j]) + len(merged)))
    extra = 0
    for s in symbols:
        if s is not None and len(s) == 1 and s not in ranks:
            extra += len(s.encode()) - 1
    return n - merges + extra


class _Counts(Memo):
    def __init__(self):
        super().__init__()
        self.counts = Pool(np.int64)

    def clear(self):
        self.counts = Pool(np.int64)


def _chunk_starts(data, offsets):
    """Chunks begin with a row, and with a blank after anything but a blank or a mark.

    No piece has a mark behind another character, so no merge crosses such a place.
    """
    first = np.zeros(len(data), bool)
    first[offsets[:-1][np.diff(offsets) > 0]] = True
    start = data == 0x20
    start[1:] &= data[:-1] != 0x20
    if len(data) > 3:
        start[3:] &= ~((data[:-3] == 0xE2) & (data[1:-2] == 0x96) & (data[2:-1] == 0x81))
    start |= first
    starts = np.flatnonzero(start)
    return starts, first[starts]


def _count(key, ranks, batches):
    import pyarrow as pa

    from answerloom.llm.textscan import chunk_hashes, kept, mix, pieces, text_bytes

    ranks = ranks.value
    memo = kept(("counts", key), _Counts)
    for batch in batches:
        for part in pieces(batch):
            data, offsets = text_bytes(part.column(1))
            starts, first = _chunk_starts(data, offsets)
            ends = np.append(starts[1:], len(data))
            hashes = chunk_hashes(data, starts)
            hashes[first] = mix(hashes[first] ^ np.uint64(0x5851F42D4C957F2D))  # has a mark in front

            def compute(new):
                memo.counts.extend([
                    count_pieces(
                        MARK * int(first[i]) + data[starts[i]:ends[i]].tobytes().decode().replace(" ", MARK), ranks)
                    for i in new.tolist()
                ])

            slots = memo.find(hashes, compute)
            total = np.concatenate([[0], np.cumsum(memo.counts.array[slots])])
            tokens = np.diff(total[np.searchsorted(starts, offsets)])
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(np.diff(offsets)), pa.array(tokens)], ["id", "n_bytes", "n_tokens"])


def token_counts(docs, model_path, id_col="doc_id", text_col="text", limit=4096):
    """``(id_col, n_bytes, n_tokens, over_limit)`` of every row of ``docs``.

    Counts equal those of the sentencepiece library for the BPE model at
    ``model_path`` (identity normaliser, dummy prefix, byte fallback) without
    begin, end or added tokens. NULL and empty texts have 0 bytes and 0 tokens;
    rows with NULL or repeated ids are counted like any other; other columns
    are ignored.

    A narrow pass without a shuffle. Texts fall into chunks at blanks; each
    worker merges a distinct chunk once and remembers its count (up to half a million chunks).
    The broadcast vocabulary is bounded by the model.
    """
    spark = docs.sparkSession
    ship_package(spark)
    ranks = spark.sparkContext.broadcast(load_pieces(model_path))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    counted = rows.mapInArrow(partial(_count, model_path, ranks), "id long, n_bytes long, n_tokens long")
    return counted.select(
        F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
