"""Near duplicates against a brute force over full shingle sets."""

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from answerloom.llm import graph, superminhash as sm, textscan
from conftest import SF

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return set()
    return {tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1))}


def brute(rows, k, percent):
    """Component of every (id, text) row by comparing all pairs that share a shingle."""
    sets = {i: shingles(t, k) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index = {}
    for i, s in sorted(sets.items()):
        met = {j for x in s for j in index.get(x, ())}
        for j in met:
            both = len(s & sets[j])
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
        for x in s:
            index.setdefault(x, []).append(i)
    return {i: (len(sets[i]), root(i)) for i in sets}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


@pytest.mark.parametrize("k,percent", [(2, 80), (5, 80), (3, 95)])
def test_equals_brute_force(spark, k, percent):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = sm.near_duplicates(docs, k=k, percent=percent)
    assert result(got) == brute(rows, k, percent)
    assert got.where("kept <> (doc_id = component_id)").count() == 0


def made_rows():
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(4000)]
    base = list(rng.choice(words, 120))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "One"), (5, "one"), (6, " one"), (7, "a b"), (8, "A  b\n")]
    for i in range(60):  # a chain and a cloud of edits: many links just above and below the limit
        edited = list(base)
        for at in rng.choice(120, rng.integers(0, 14), replace=False):
            edited[at] = f"x{rng.integers(1000)}"
        rows.append((100 + i, " ".join(edited)))
    rows.append((500, " ".join(rng.choice(words, 150_000))))
    rows.append((501, rows[-1][1] + " end"))
    return rows


def test_edge_cases_and_extra_columns(spark):
    rows = made_rows()
    frame = pd.DataFrame(rows, columns=["doc_id", "text"]).assign(id=7, n=1, bands="x", a=0, component_id=3)
    got = sm.near_duplicates(spark.createDataFrame(frame), k=2)
    assert result(got) == brute(rows, 2, 80)
    assert result(got)[8][1] == 7 and result(got)[5][1] == 4 and result(got)[6][1] == 6


def test_filter_keeps_one_of_each_group_and_null_ids(spark):
    docs = spark.createDataFrame(
        [(1, "a b c", "x"), (2, "a b c", "y"), (None, "a b c", "z"), (3, None, "w"), (9, "q", "q"), (9, "q", "q")],
        "doc_id long, text string, hub string")
    kept = sm.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.hub) for r in kept.collect()) == [(0, "z"), (1, "x"), (3, "w"), (9, "q")]
    empty = sm.drop_near_duplicates(docs.limit(0))
    assert empty.count() == 0 and empty.columns == docs.columns


def test_rows_that_repeat_an_id_are_not_copies(spark):
    long = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame(
        [(5, long, "a"), (5, "wholly other words stand in this second text", "b"), (7, long, "c"), (7, "", "d"), (7, None, "e"),
         (8, "a third text with words of its very own here", "f"), (8, "a third text with words of its very own here", "g"), (None, long, "h")],
        "doc_id long, text string, row string").repartition(4)
    kept = sm.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    got = {r.row for r in kept.collect()}
    # One of each pair of equal rows goes; a text that only shares its id with one stays.
    assert got - {"f", "g"} == {"a", "b", "d", "e", "h"} and len(got & {"f", "g"}) == 1


def test_signature_equals_one_element_at_a_time():
    """The rank-at-a-time form gives the minimum over full permutations, and estimates well."""
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 2**63, 300).astype(np.uint64))
    b = np.concatenate([a[:240], rng.integers(0, 2**63, 60).astype(np.uint64)])
    one, two, tiny = sm.signatures([a, b, a[:1]], 128)
    assert sorted(np.floor(tiny)) == list(range(128))
    merged = sm.signatures([np.union1d(a, b)], 128)[0]
    assert np.array_equal(np.minimum(one, two), merged)
    assert abs((one == two).mean() - 240 / 360) < 0.15


def test_words_do_not_depend_on_blocks(monkeypatch):
    texts = ["Ab  cd", None, "", "été x" * 30, "zz" * 50]
    whole = textscan.word_hashes(*textscan.text_bytes(pa.array(texts)))
    monkeypatch.setattr(textscan, "BLOCK", 7)
    cut = textscan.word_hashes(*textscan.text_bytes(pa.array(texts)))
    assert np.array_equal(whole[0], cut[0]) and np.array_equal(whole[1], cut[1])
    assert np.diff(whole[1]).tolist() == [2, 0, 0, 31, 1]


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(300)] + [(1000, 2000 + i) for i in range(300)] + [(5, 5)]
    got = {r.id: r.component_id for r in graph.components(spark.createDataFrame(chain, "x long, y long").repartition(6)).collect()}
    assert set(got.values()) == {0, 1000} and len(got) == 602 and got[300] == 0
