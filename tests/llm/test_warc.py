"""Archive round trips, and what is left of damaged archives."""

import gzip
import random
from hashlib import sha1

from answerloom.llm import warc
from answerloom.session import work_dir
from conftest import SF


def expected(rows):
    top = {}
    for i, _, html in rows:
        if i is not None:
            top[html or ""] = max(top.get(html or "", i), i)
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        refers = top.get(html or "") if len(data) >= 1000 and i is not None and i != top[html or ""] else None
        out.append((i, len(data), sha1(data).hexdigest(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


def round_trip(spark, pages):
    path = work_dir(spark, "warc")
    warc.write_archives(pages, path)
    return warc.read_archives(spark, path), path


def rows_of(df):
    assert df.where("status <> 'valid'").count() == 0
    return sorted(
        ((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


def test_given_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got, _ = round_trip(spark, pages)
    rows = [(r.page_id, r.url, r.html) for r in pages.collect()]
    assert rows_of(got) == expected(rows)
    payloads = {r.page_id: r.payload.decode() for r in got.where("record_type = 'response'").collect()}
    assert all(payloads[i] == (h or "") for i, _, h in rows if i in payloads)


def test_edge_pages(spark):
    rng = random.Random(6)
    long = "".join(rng.choice("abcdé \r\n") for _ in range(40_000)) * 480  # above 16 MiB
    rows = [
        (1, "http://a/", None), (2, None, ""), (3, "http://a b/\r\n", "x" * 1000), (9, "u", "x" * 1000), (9, "u", "x" * 1000),
        (4, "u", "x" * 999), (5, "u", "x" * 999), (None, "u", "x" * 1000), (6, "u", "WARC/1.1\r\n\r\n\x1f\x8b\x08\0" * 100),
        (7, "u", long), (8, "u", "é" * 500), (10, "u", "é" * 500),
    ]
    pages = spark.createDataFrame([(i, u, h, 1, "x") for i, u, h in rows], "page_id long, url string, html string, id int, digest string")
    got, _ = round_trip(spark, pages.repartition(3))
    assert rows_of(got) == expected(rows)
    path = work_dir(spark, "warc-empty")
    warc.write_archives(pages.limit(0), path)
    assert warc.read_archives(spark, path).count() == 0


def record(i, payload):
    return warc.record_bytes(i, "http://x/", payload, len(payload), sha1(payload).hexdigest(), None, "2024-01-01T00:00:00Z")


def kept(data):
    found = list(warc.salvage(data))
    at = 0
    for offset, length, fields, *_ in found:
        assert offset == at
        at += length
    assert at == len(data)
    return [warc._number(f["warc-record-id"]) for _, _, f, _, _ in found if f], [(o, n, why) for o, n, f, _, why in found if not f]


def test_salvage_of_every_kind_of_damage():
    rng = random.Random(2)
    for pack in (lambda b: gzip.compress(b, 1), lambda b: b):
        parts = [pack(record(i, bytes(rng.choices(b"abcdefg \r\n", k=400)))) for i in range(6)]
        whole = b"".join(parts)
        assert kept(whole) == ([0, 1, 2, 3, 4, 5], [])
        start = len(parts[0]) + len(parts[1])
        for at in range(0, len(parts[2]), 13):  # one damaged byte in record 2
            bad = bytearray(whole)
            bad[start + at] ^= 0x5A
            ids, gaps = kept(bytes(bad))
            assert [0, 1, 3, 4, 5] == [i for i in ids if i in (0, 1, 3, 4, 5)] and len(gaps) <= 1
        ids, gaps = kept(b"junk" + parts[0] + b"\0" * 9 + parts[1] + parts[2][:50] + parts[3] + parts[4][:-2])
        assert ids == [0, 1, 3] and [g[:2] for g in gaps][0] == (0, 4) and len(gaps) == 4
    assert kept(b"") == ([], []) and kept(b"nothing here")[1] == [(0, 12, "no version line")]
    mixed = gzip.compress(record(1, b"a")) + record(2, b"b") + gzip.compress(record(3, b"c") + record(4, b"d"))
    assert [warc._number(f["warc-record-id"]) for _, _, f, _, _ in warc.salvage(mixed)] == [1, 2, 3, 4]


def test_damaged_file_through_spark(spark, tmp_path):
    parts = [gzip.compress(record(i, b"p" * 50)) for i in range(3)]
    (tmp_path / "a.warc.gz").write_bytes(parts[0] + parts[1][:20] + parts[2])
    got = {(r.page_id, r.status, r.offset, r.length) for r in warc.read_archives(spark, str(tmp_path)).collect()}
    assert (None, "damaged member", len(parts[0]), 20) in got or (None, "short member", len(parts[0]), 20) in got
    assert {g[0] for g in got} == {0, 2, None}


def ids_of(data):
    return [warc._number(f["warc-record-id"]) for _, _, f, _, _ in warc.salvage(data) if f]


def test_members_of_many_records_give_all_good_ones():
    rng = random.Random(3)
    parts = [record(i, bytes(rng.choices(range(256), k=4_000))) for i in range(40)]
    bad = bytearray(b"".join(parts))
    bad[len(b"".join(parts[:7])) + len(parts[7]) // 2] ^= 1  # in record 7, before it is packed
    found = list(warc.salvage(gzip.compress(bytes(bad), 1) + gzip.compress(parts[0], 1)))
    assert [warc._number(f["warc-record-id"]) for _, _, f, _, _ in found if f] == [i for i in range(40) if i != 7] + [0]
    start = len(b"".join(parts[:7]))
    assert [why for _, _, f, _, why in found if not f] == [f"block digest, unpacked bytes {start} to {start + len(parts[7])}"]
    whole = gzip.compress(b"".join(parts), 1)
    for level in (0, 1):
        packed = gzip.compress(b"".join(parts), level)
        got = ids_of(packed[:len(packed) // 2] + gzip.compress(record(77, b"next")))
        assert got[:-1] == list(range(len(got) - 1)) and len(got) in (20, 21) and got[-1] == 77
        assert len(ids_of(packed[:len(packed) // 2])) in (19, 20)
    for at in (-8, -1):  # checksum and length of the member
        broken = bytearray(whole)
        broken[at] ^= 1
        assert ids_of(bytes(broken)) == list(range(40))


def test_long_urls_are_read(spark):
    rows = [(1, "http://a/" + "x" * 100_000, "one"), (2, "http://a/" + "\x01 " * 50_000, "two"), (3, "http://a/", "three")]
    got, _ = round_trip(spark, spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert rows_of(got) == expected(rows)
