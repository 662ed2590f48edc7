"""Fingerprints against exact generalised Jaccard similarities."""

import re
from collections import Counter
from hashlib import sha256

import numpy as np
import pyarrow as pa

from answerloom.llm import weighted_sampling as ws
from conftest import SF


def weights(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return {t: n**0.5 for t, n in Counter(re.findall(r"[^\x20\x09-\x0D]+", lower)).items()}


def jaccard(a, b):
    a, b = weights(a), weights(b)
    keys = {*a, *b}
    top = sum(max(a.get(k, 0), b.get(k, 0)) for k in keys)
    return sum(min(a.get(k, 0), b.get(k, 0)) for k in keys) / top if top else 1.0


def check(df, rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    rows = [(i, t or "") for i, t in rows]
    got = sorted(df.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.n_chars))
    assert len(got) == len(rows)
    errors = []
    by_text = {}
    want = []
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        want.append((i, len(text), sha256(edited.encode()).hexdigest()))
        errors.append((text, edited, after))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_chars, r.edited_sha256)) for r in got)
    off = []
    for r, (i, n, digest), (text, edited, after) in zip(got, want, errors):
        if (r.doc_id, r.n_chars, r.edited_sha256) == (i, n, digest):
            off += [r.near_edited - jaccard(text, edited), r.near_next - jaccard(text, after)]
            assert by_text.setdefault(text, r.fingerprint) == r.fingerprint
            assert by_text.setdefault(edited, r.edited_fingerprint) == r.edited_fingerprint
    return np.array(off)


def test_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    off = check(ws.compare_with_next(docs), [(r.doc_id, r.text) for r in docs.collect()])
    assert abs(off.mean()) < 0.02 and np.sqrt((off**2).mean()) < 0.07 and len(off) > 390


def test_edge_rows_and_clashing_columns(spark):
    rows = [
        (5, "a b c d"), (None, "null id"), (7, None), (8, ""), (9, " "), (9, "tie b"), (9, "tie a"), (10, "é" * 7),
        (11, "word " * 20_000), (12, "Word\nword"), (-4, "a B c D"), (2**62, " ".join(map(str, range(120_000)))),
    ]
    docs = spark.createDataFrame([(i, t, 1, True, "x") for i, t in rows], "doc_id long, text string, range int, extra boolean, id string")
    check(ws.compare_with_next(docs.repartition(4)), rows)
    one = docs.where("doc_id = 5")
    assert [r.near_next for r in ws.compare_with_next(one).collect()] == [1.0]
    assert ws.compare_with_next(docs.limit(0)).count() == 0
    plain = {r.doc_id: r.fingerprint for r in ws.document_fingerprints(docs).collect()}
    assert plain[7] == plain[8] == "0" * 4 * ws.SAMPLES and plain[5] == plain[-4] != plain[12]


def test_collision_rate_is_the_generalised_jaccard_similarity():
    a, b = "x " * 9 + "y y y y z", "x x x x y y y y y y y y y w"
    pairs = [(re.sub(r"(\w)", rf"\g<1>{i}", a), re.sub(r"(\w)", rf"\g<1>{i}", b)) for i in range(300)]
    left, right = (ws.fingerprints(pa.array(list(side))) for side in zip(*pairs))
    assert abs((left == right).mean() - jaccard(a, b)) < 0.015


def test_ranges(spark):
    cuts = [2, 3, 5, 8, 13, 21, 34]
    ids = spark.range(0, 40).select("id", ws._range_of(ws.F.col("id"), cuts).alias("r"))
    assert all(r.r == sum(c <= r.id for c in cuts) for r in ids.collect())
