"""Array-at-a-time scanning of Arrow text columns: words, their hashes, plain chunks.

Everything here works on the bytes of a whole batch; no Python runs per word.
"""

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes looked at together; bounds the working arrays (about 40 bytes per byte of text).
BLOCK = 1_000_000
R = np.uint64(0x9E3779B97F4A7C15)
R_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x):
    """A bijective finaliser on 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * R)
_LOWER = _BYTES.copy()
_LOWER[ord("A"):ord("Z") + 1] = _BYTES[ord("a"):ord("z") + 1]


@lru_cache(maxsize=1)
def _powers(n):
    """Powers of the hash base and of its inverse, for n positions."""
    up, down = np.full(n, R), np.full(n, R_INVERSE)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def text_bytes(column):
    """Bytes and row offsets of an Arrow string column; NULL counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def span_hashes(data, starts, ends, lower=False):
    """64-bit hashes of the spans [starts, ends) of one block of bytes."""
    table = _LOWER if lower else _BYTES
    size = max(BLOCK + 1, 1 << (len(data) + 1).bit_length())
    up, down = _powers(size)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * up[:len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * R)


def blocks(data, offsets, cut=SPACE):
    """Byte ranges of about BLOCK bytes that end at a row's end or before a ``cut`` byte."""
    at, n = 0, len(data)
    while at < n:
        end = min(n, at + BLOCK)
        if end < n:
            row = offsets[np.searchsorted(offsets, end, "right") - 1]
            if row > at:
                end = int(row)
            else:
                stop = int(offsets[np.searchsorted(offsets, end, "left")])
                while end < stop:
                    found = np.flatnonzero(cut[data[end:min(stop, end + 65_536)]])
                    if len(found):
                        end += int(found[0])
                        break
                    end = min(stop, end + 65_536)
        yield at, end
        at = end


def row_starts(offsets, at, end):
    """A mask over the block [at, end): where a row begins."""
    first = np.zeros(end - at, bool)
    inside = offsets[np.searchsorted(offsets, at):np.searchsorted(offsets, end)] - at
    first[inside] = True
    return first


def word_hashes(data, offsets, lower=False):
    """Hashes of all maximal runs of non-space bytes, and each row's range in them."""
    hashes, begins = [], []
    for at, end in blocks(data, offsets):
        part, first = data[at:end], row_starts(offsets, at, end)
        space = SPACE[part]
        start, stop = ~space, ~space
        start[1:] &= space[:-1] | first[1:]
        stop[:-1] &= space[1:] | first[1:]
        starts, ends = np.flatnonzero(start), np.flatnonzero(stop) + 1
        hashes.append(span_hashes(part, starts, ends, lower))
        begins.append(starts + at)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(begins), offsets)


def gather(starts, lengths):
    """Indices of the concatenated ranges [start, start + length)."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def pieces(batch, column=1, size=2_000_000):
    """Slices of a record batch with about ``size`` bytes in its string column; a long text stands alone."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total, at = np.cumsum(lengths, dtype=np.int64), 0
    while at < len(total):
        end = int(np.searchsorted(total, (total[at - 1] if at else 0) + size, "right"))
        end = max(at + 1, end)
        yield batch.slice(at, end - at)
        at = end


def chunk_hashes(data, starts):
    """Hashes of the chunks that begin at ``starts`` and end where the next one begins."""
    ends = np.append(starts[1:], len(data))
    out, at = np.zeros(len(starts), np.uint64), 0
    while at < len(starts):
        end = max(at + 1, int(np.searchsorted(ends, starts[at] + BLOCK, "right")))
        base = starts[at]
        out[at:end] = span_hashes(data[base:ends[end - 1]], starts[at:end] - base, ends[at:end] - base)
        at = end
    return out


class Memo:
    """What a worker has computed for distinct chunks, by hash; emptied when it grows past ``limit``."""

    def __init__(self, limit=500_000):
        self.limit, self.slots = limit, {}

    def find(self, hashes, compute):
        """Slot numbers of ``hashes``; ``compute(indices)`` gets the first index of each new one."""
        unique, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.slots) + len(unique) > self.limit:
            self.slots.clear()
            self.clear()
        get = self.slots.get
        slots = np.fromiter((get(h, -1) for h in unique.tolist()), np.int64, len(unique))
        new = np.flatnonzero(slots < 0)
        if len(new):
            slots[new] = np.arange(len(self.slots), len(self.slots) + len(new))
            self.slots.update(zip(unique[new].tolist(), slots[new].tolist()))
            compute(first[new])
        return slots[inverse]

    def clear(self):
        """Forget what the slots stand for."""


_KEPT = {}


def kept(key, make):
    """What a worker process keeps from task to task: the last thing only, so that operators do not add up."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def forget():
    """Drop what this worker process keeps, before a task that needs the memory for something else."""
    _KEPT.clear()


class Pool:
    """A growing array."""

    def __init__(self, dtype):
        self.array, self.size = np.zeros(1024, dtype), 0

    def extend(self, values):
        need = self.size + len(values)
        if need > len(self.array):
            self.array = np.resize(self.array, max(need, 2 * len(self.array)))
        self.array[self.size:need] = values
        self.size = need
