"""Grammar round trips, random access, and files against the public tokenizer library."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from answerloom.llm import token_files as t

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string"
ODD = ["", None, "a", "Don't (he's) 'sdog x'y ('s x", "<|endoftext|>x <|ENDOFTEXT|> foo<|startoftext|>.bar",
       "é́.̈a ≮ ≮b x,y", "12ab3.4 ½", "日本 語　x y", " \t\n", "İI K Σς ẞ", "</w> a</w>"]


def noise(rng, n):
    words = ["the", "State", "of", "affairs,", "été", "(x)", "3.14", "it's", "naïve.", "日本"]
    return "".join(rng.choice(words) + rng.choice([" ", "  ", "\n", " ", ""]) for _ in range(n))


def expected(rows):
    """Per row, in order: id, start, size, crc and ids, by the library."""
    library, at, out = Tokenizer.from_file(PATH), 0, []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        at += len(ids)
    return out


def written(spark, rows, path, **options):
    t.write_token_files(spark.createDataFrame(rows, SCHEMA), str(path), PATH, end_id=1, **options)
    return sorted(map(tuple, t.read_token_files(spark, str(path), with_ids=True).collect()), key=lambda r: r[1])


@pytest.mark.parametrize("seed, symbols, n", [(1, 2, 3000), (2, 30, 5000), (3, 65_535, 400), (4, 70_000, 5000), (5, 1, 100), (6, 5, 1)])
def test_grammars_expand_to_their_ids(seed, symbols, n):
    rng = np.random.default_rng(seed)
    ids = rng.integers(0, symbols, n).astype(np.uint32)
    ids[n // 2:] = ids[:n - n // 2]
    ends = rng.random(n) < .02
    ends[-1] = True
    first, left, right, text = t.repair(ids, ends)
    assert t.expand(text, first, left, right).tolist() == ids.tolist()
    assert (np.concatenate((left, right)) < np.tile(first + np.arange(len(left)), 2)).all()
    # No symbol crosses the end of a document, and no frequent pair is left within one.
    spans = np.array([len(t.expand([s], first, left, right)) for s in text.tolist()])
    stops = np.cumsum(spans)
    assert set((np.flatnonzero(ends) + 1).tolist()) <= set(stops.tolist())
    inner = ~ends[stops[:-1] - 1] & (text[:-1] != text[1:])
    pairs, counts = np.unique(np.stack((text[:-1], text[1:]))[:, inner], axis=1, return_counts=True)
    assert counts.max(initial=0) < t.LEAST or first + len(left) == 65_536


def test_blocks_give_any_range():
    rng = np.random.default_rng(9)
    ids = rng.integers(0, 40, 30_000).astype(np.uint32)
    ends = np.zeros(len(ids), bool)
    ends[[9_999, 20_499, 29_999]] = True
    blocks = [t.block_bytes(ids[a:a + 7_000], ends[a:a + 7_000]) for a in range(0, 30_000, 7_000)]
    data = t.record_bytes(2, 5, [4, None, 6], [10_000, 10_500, 9_500], blocks)
    record, = t.records(data * 1)
    assert (record.part, record.number, record.n_ids) == (2, 5, 30_000)
    for low, high in [(0, 30_000), (0, 0), (6_999, 7_001), (123, 124), (29_999, 30_000), (5_000, 28_000)]:
        assert record.ids(low, high).tolist() == ids[low:high].tolist()
    assert t._digests(record) == [zlib.crc32(ids[a:b].tobytes()) for a, b in [(0, 10_000), (10_000, 20_500), (20_500, 30_000)]]
    broken = bytearray(data)
    broken[200] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        list(t.records(bytes(broken)))
    with pytest.raises(ValueError, match="no whole record"):
        list(t.records(data[:-5]))


def test_files_equal_the_library(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i * 3 % 101, text) for i, text in enumerate(ODD + [noise(rng, rng.randint(0, 400)) for _ in range(80)])]
    got = written(spark, rows, tmp_path / "a")
    assert got == expected(rows)
    # Small records, many files: the same.
    assert written(spark, rows, tmp_path / "b", size=500, per_file=2) == got
    every = [i for r in got for i in r[4]]
    for start, n in [(0, 10), (700, 1500), (len(every) - 3, 50), (5, 0)]:
        parts = t.read_range(spark, str(tmp_path / "b"), start, n).orderBy("start").collect()
        assert [i for r in parts for i in r["ids"]] == every[start:start + n]


def test_long_texts_are_several_blocks(spark, tmp_path, monkeypatch):
    rng = random.Random(2)
    text = noise(rng, 30_000)
    monkeypatch.setattr(t._sections, "__defaults__", (20_000,))
    rows = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array(["x", text, "y z"])], ["id", "text"])
    known, ids, sections = t.ChunkIds(open(PATH).read(), t.SMALL), [], list(t._sections(rows))
    for doc_ids, data, offsets, unfinished in sections:
        ids += t._row_ids(known, data, offsets)[0].tolist()
    library = Tokenizer.from_file(PATH)
    assert ids == [i for s in ("x", text, "y z") for i in library.encode(s, add_special_tokens=False).ids]
    assert len(sections) > 5 and [s[3] for s in sections].count(False) == 3
    monkeypatch.undo()
    got = written(spark, [(1, "x"), (2, text), (3, "y z")], tmp_path / "a", size=3_000)
    assert got == expected([(1, "x"), (2, text), (3, "y z")])


def test_nulls_repeated_ids_empty_and_clashing_columns(spark, tmp_path):
    rows = [(None, "a b"), (None, None), (5, "same"), (5, "same"), (5, "other"), (-7, "first")]
    got = written(spark, rows, tmp_path / "a")
    assert [r[0] for r in got] == [None, None, -7, 5, 5, 5]
    assert sorted((str(r[0]), r[3]) for r in got) == sorted((str(r[0]), r[3]) for r in expected(rows))
    assert [r[1] for r in got] == np.cumsum([0] + [r[2] for r in got])[:-1].tolist()
    assert written(spark, [], tmp_path / "b") == []
    clash = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS id", "2 AS hash", "'z' AS record", "3 AS part")
    t.write_token_files(clash, str(tmp_path / "c"), PATH, end_id=1)
    assert t.read_token_files(spark, str(tmp_path / "c")).count() == len(rows)


def test_memory_of_chunks_is_dropped_by_halves():
    known = t.ChunkIds(open(PATH).read(), t.SMALL, limit=8)
    library = Tokenizer.from_file(PATH)
    for words in ([b"one", b"two"], [b"one", b"three."], [b"%d" % i for i in range(6)], [b"one", b"5", b"Ab"]):
        found = known.find(words)
        assert [np.frombuffer(f, np.uint32).tolist() for f in found] == [
            library.encode(w.decode(), add_special_tokens=False).ids for w in words]
    assert len(known.young) + len(known.old) <= 12
