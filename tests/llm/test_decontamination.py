"""Leaks against a brute force over all diagonals."""

import random
import re

import numpy as np

from answerloom.llm import decontamination as de
from conftest import SF


def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def brute(docs, items):
    out = {}
    for doc_id, text in docs:
        h = words(text)
        for item, passage in items:
            g = words(passage)
            need = max(8, min(13, -(-len(g) // 2)))
            if len(g) < 8 or not set(g) & set(h):
                continue
            best = None
            for at in range(-len(g) + need, len(h) - need + 1):
                run = top = 0
                matched = 0
                for k in range(max(0, -at), min(len(g), len(h) - at)):
                    same = g[k] == h[at + k]
                    matched += same
                    run = max(0, run + (1 if same else -1))
                    top = max(top, run)
                if top >= need:
                    best = max(best or (0, 0, 0), (top, matched, -at))
            if best:
                out[doc_id, item] = (best[0], best[1], len(g), -best[2])
    return out


def result(df):
    got = df.collect()
    assert len({(r.doc_id, r.item_id) for r in got}) == len(got)
    return {(r.doc_id, r.item_id): (r.score, r.matched, r.item_words, r["at"]) for r in got}


def test_given_documents(spark):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    rows = [(r.doc_id, r.text) for r in docs.collect() if len(r.text) < 4000]
    passages = [(r.item_id, r.text) for r in items.collect()]
    got = result(de.leaks(docs, items))
    short = {i for i, _ in rows}
    assert {k: v for k, v in got.items() if k[0] in short} == brute(rows, passages)
    held = {(i, j) for i, t in rows for j, p in passages if p in t}
    assert held <= set(got)


def made():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(3000)] + ["The", "of,", "und"] * 200
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(say(n))) for i, n in enumerate([5, 8, 9, 12, 15, 20, 30, 45, 60] * 3)]
    docs = [(1000 + i, " ".join(say(rng.randint(0, 80)))) for i in range(60)]
    for i, (item, passage) in enumerate(items):
        for share in (0, 0.07, 0.15):
            copy = [f"x{rng.randint(0, 99)}" if rng.random() < share else w.upper() + "!" for w in passage.split()]
            docs.append((10_000 + 10 * i + int(share * 20), " ".join(say(rng.randint(0, 30)) + copy + say(rng.randint(0, 30)))))
    half = items[8][1].split()
    docs += [(1, None), (2, ""), (3, " ... "), (4, " ".join(half[:30])), (5, " ".join(half[30:])), (6, " ".join(say(30_000) + half))]
    return docs, items


def test_substitutions_edges_and_both_joins(spark, monkeypatch):
    docs, items = made()
    frame = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in docs], "doc_id long, text string, at int, seed int, item string")
    bench = spark.createDataFrame(items + items[:5], "item_id long, text string")
    want = brute([d for d in docs if d[0] != 6], items)
    got = result(de.leaks(frame.repartition(5), bench))
    missed = {k for k in want if k not in got}
    assert len(missed) <= 0.01 * len(want), missed
    assert all(got[k][0] <= want[k][0] for k in got if k in want) and {k for k in got if k[0] != 6} <= set(want)
    assert got[6, 8][:2] == (60, 60) and got[4, 8][3] == 0 and got[5, 8][3] == -30
    monkeypatch.setattr(de, "BROADCAST_SEEDS", 0)
    assert result(de.leaks(frame, bench)) == got
    assert de.leaks(frame.limit(0), bench).count() == 0 and de.leaks(frame, bench.limit(0)).count() == 0
    kept = de.drop_leaks(frame.unionAll(frame), bench)
    assert kept.columns == frame.columns
    leaking = {d for d, _ in got}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, _ in docs * 2 if d not in leaking)


def test_plan_has_no_python(spark):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    plan = de.leaks(docs, items)._jdf.queryExecution().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan
    assert np.all([name in plan for name in ("BroadcastHashJoin", "Generate")])


def test_only_small_rows_travel(spark, monkeypatch):
    docs, items = made()
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    saved, cut = {}, de.cut_lineage

    def noted(df, name):
        out = cut(df, name)
        saved[name] = (out, str(df._jdf.queryExecution().executedPlan().toString()))
        return out

    monkeypatch.setattr(de, "cut_lineage", noted)
    for bound in (de.BROADCAST_SEEDS, 0):
        monkeypatch.setattr(de, "BROADCAST_SEEDS", bound)
        plan = str(de.leaks(frame, bench)._jdf.queryExecution().executedPlan().toString())
        assert plan.count("SortMergeJoin") == (bound == 0)  # with the items, by their number
        # A diagonal is compared once, however many windows lie on it.
        places, before = saved["leak-places"]
        rows = [(r.text_key, r.item, at) for r in places.collect() for at in r.ats]
        assert rows and len(rows) == len(set(rows)) and all(r.n <= 60 for r in places.collect())
        assert "getbit" in before.lower()  # windows are sorted out before they meet the seeds
    de.drop_leaks(frame, bench)
    leaking = saved["leaking-texts"][0]
    assert leaking.columns == ["__gone"] and leaking.count()
    kept = de.drop_leaks(frame, bench)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in kept and "SortMergeJoin" not in kept


def test_the_filter_of_seeds_loses_none(spark, monkeypatch):
    seeds = spark.range(20_000).selectExpr("xxhash64(id) AS seed")
    others = spark.range(20_000, 60_000).selectExpr("xxhash64(id) AS seed")
    for bits, most in ((de.FILTER_BITS, 0.004), (1 << 16, 0.4)):
        monkeypatch.setattr(de, "FILTER_BITS", bits)
        held = de._may_be_in(seeds, 20_000)
        assert seeds.where(held).count() == 20_000 and others.where(held).count() <= most * 40_000
    assert others.where(de._may_be_in(seeds.limit(0), 0)).count() == 0


def test_two_texts_of_one_item(spark):
    long, short = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(9))
    bench = spark.createDataFrame([(1, long), (1, short)], "item_id long, text string")
    docs = spark.createDataFrame([(1, " ".join(long.split()[25:])), (2, short), (None, long)], "doc_id long, text string")
    got = {(r.doc_id, r.item_id, r.score, r.item_words, r["at"]) for r in de.leaks(docs, bench).collect()}
    assert got == {(1, 1, 15, 40, -25), (2, 1, 9, 9, 0), (None, 1, 40, 40, 0)}
