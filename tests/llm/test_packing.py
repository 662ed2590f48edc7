"""Packing against the tokenizer library; the reduction against optimal packings."""

import random
import zlib
from itertools import groupby

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from answerloom.llm import packing
from conftest import SF

MODEL = public_tokenizers.path("byte_bpe_50k.json")
EDGES = [
    None, "", " ", "a", " a", "a ", "  a\n\nb \t c\n d", "x  y  z", "é è\nÀ b", "don't 's 'll\n're",
    "a<|endoftext|>\nb <|endoftext|> c", "\x1c x \x85 y", "日本 語\n漢字 ñ", "1 2\n3 .. !\n\n? \r\n end ", "a\x0bb\x0cc",
    "word " * 9000, "y" * 30_000, "\n", "🙂 🙂\n🙂", "(He's) 'sdog! x'y ('s) -a- Été×b÷c. <b>A</b>", "x<|endoftext|>y, z.", "e.́ ≮ a_b 3.5% $x",
]


def expected(rows, capacity=2048):
    tokenizer = Tokenizer.from_file(MODEL)
    out = {}
    for i, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        first = len(ids) - (-(-len(ids) // capacity) - 1) * capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
            out[i, p] = (a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))
    return out


def check(df, rows):
    got = df.collect()
    want = expected(rows)
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want
    assert len(got) == len(want)
    key = lambda r: r.sequence_id
    sequences = [sorted(g, key=lambda r: r.offset) for _, g in groupby(sorted(got, key=key), key=key)]
    for pieces in sequences:
        at = 0
        for r in pieces:
            assert r.offset == at
            at += r.length
        assert at <= 2048
    return len(sequences), sum(r.length for r in got)


def test_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    sequences, tokens = check(packing.pack_documents(docs, MODEL), rows)
    assert sequences <= -(-tokens // 2048) * 1.02 + 1


def test_edge_texts_extra_columns_and_ids(spark):
    rows = list(enumerate(EDGES))
    docs = spark.createDataFrame([(i, t, 5, "x", 3) for i, t in rows], "doc_id long, text string, rank int, task string, length int")
    got = packing.pack_documents(docs.repartition(3), MODEL, with_ids=True)
    check(got, rows)
    for r in got.collect():
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
    assert packing.pack_documents(docs.limit(0), MODEL).count() == 0
    same = packing.pack_documents(docs.where("doc_id = 3").withColumn("doc_id", packing.F.lit(None)).unionByName(docs.where("doc_id = 3")), MODEL)
    assert same.count() == 2


def test_chunks_keep_ids_of_random_texts():
    rng = random.Random(3)
    marks = [" ", "\n", "\t", "a", "B", "'s", "é", "1", ".", " ", " ", "語", "\r", "<|endoftext|>", "  ", "\x1d"]
    texts = ["".join(rng.choices(marks, k=rng.randint(0, 14))) for _ in range(3000)]
    from answerloom.llm.textscan import text_bytes

    tokenizer = Tokenizer.from_file(MODEL)
    known = packing.ChunkIds(open(MODEL, encoding="utf-8").read(), packing.WORD)
    ids, at = packing._row_ids(known, *text_bytes(pa.array(texts)))
    for i, text in enumerate(texts):
        assert ids[at[i]:at[i + 1] - 1].tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def fewest(items, capacity):
    """Smallest number of bins, by trying every placement."""
    items = sorted(items, reverse=True)
    best = len(items)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(items):
            best = len(rooms)
            return
        for r in sorted(set(rooms)):
            if r >= items[i]:
                at = rooms.index(r)
                place(i + 1, rooms[:at] + [r - items[i]] + rooms[at + 1:])
        place(i + 1, rooms + [capacity - items[i]])

    place(0, [])
    return best


def test_reduction_keeps_the_optimum():
    rng = random.Random(11)
    for _ in range(400):
        capacity = rng.randint(5, 20)
        items = [rng.randint(1, capacity) for _ in range(rng.randint(0, 9))]
        counts = np.bincount(items, minlength=capacity + 1)
        fixed, left = packing.reduce_by_dominance(counts, capacity)
        rest = [s for s in range(capacity + 1) for _ in range(left[s])]
        assert sum(t for _, t in fixed) + fewest(rest, capacity) == fewest(items, capacity), (capacity, items)
        assert all(sum(sizes) <= capacity for sizes, _ in fixed)


def test_plan_places_every_rank_once():
    rng = np.random.default_rng(2)
    for capacity, n in ((2048, 100_000), (2048, 300), (50, 1000)):
        counts = np.bincount(rng.integers(1, capacity + 1, n), minlength=capacity + 1)
        rows = packing.plan(counts, capacity)
        for size in range(capacity + 1):
            ranges = sorted((low, high) for s, low, high, *_ in rows if s == size)
            assert [a for a, _ in ranges] == [0, *[b for _, b in ranges]][:len(ranges)]
            assert (ranges[-1][1] if ranges else 0) == counts[size]
        fill = {}
        for size, low, high, base, bins, offset in rows:
            for i in range(bins if n < 5000 else 1):
                fill.setdefault(base + i, []).extend((offset + size * k, size) for k in range((high - low) // bins))
        for places in fill.values():
            at = 0
            for offset, size in sorted(places):
                assert offset == at
                at += size
            assert at <= capacity
