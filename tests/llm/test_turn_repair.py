"""Cheapest repairs against all possible edits, long conversations in many blocks, edge rows."""

import random
from functools import lru_cache
from hashlib import sha256

import pytest

from answerloom.llm import turn_repair
from answerloom.llm.turn_repair import cheapest_edits, damage, repair_conversations

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """Faults and the (cost, audit, lines) of the best edits of ``(role, text)`` rows, by trying all."""
    faults, seen = [], set()
    for role, text in rows:
        kept = text.strip(" \t\n\v\f\r")
        faults.append("blank" if not kept else "duplicate" if (role, text) in seen
                      else "truncated" if kept[-1] not in ".!?" else "")
        seen.add((role, text))
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @lru_cache(None)
    def best(i, last, inserted):
        ways = [(0, "", ())] if i == len(rows) and last in ("", "a") else []
        if inserted < 3:
            for role in ("user", "assistant"):
                if (last, role[0]) in step:
                    c, a, t = best(i, role[0], inserted + 1)
                    ways.append((c + 5, "I" + a, (role + ":",) + t))
        if i < len(rows):
            role, text = rows[i]
            c, a, t = best(i + 1, last, 0)
            ways.append((c + 2, "D" + a, t))
            if faults[i] in ("", "truncated"):
                extra = 5 if faults[i] else 0
                if (last, role[:1]) in step:
                    c, a, t = best(i + 1, role[0], 0)
                    ways.append((c + extra, "K" + a, (f"{role}:{text}",) + t))
                for new in ("user", "assistant"):
                    if (last, new[0]) in step:
                        c, a, t = best(i + 1, new[0], 0)
                        ways.append((c + extra + 1, "R" + a, (f"{new}:{text}",) + t))
        return min(ways, default=(10**9, "", ()))

    return faults, best(0, "", 0)


def report(spark, rows):
    table, turns, digests = repair_conversations(spark.createDataFrame(rows, SCHEMA))
    kept = {}
    for r in turns.orderBy("conv_id", "at", "n").collect():
        kept.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    return {r["conv_id"]: r for r in table.collect()}, kept, {r["conv_id"]: r["repaired_sha256"] for r in digests.collect()}


def test_random_conversations_against_all_edits(spark):
    rng = random.Random(5)
    texts = ["One.", "Two!", "cut of", "", " \n", "Why?", "One."]
    convs = {
        c: [(rng.choice(["system", "user", "assistant", "tool", ""]), rng.choice(texts) + (str(i) + "." if rng.random() < .5 else ""))
            for i in range(rng.randint(1, 9))]
        for c in range(150)
    }
    rows = [(c, i, r, t) for c, v in convs.items() for i, (r, t) in enumerate(v)]
    got, kept, digests = report(spark, rows)
    for c, v in convs.items():
        faults, (cost, audit, lines) = brute(v)
        assert (got[c]["cost"], got[c]["audit"]) == (cost, audit), v
        assert [got[c][f] for f in ("blank", "duplicate", "truncated")] == [
            faults.count(f) for f in ("blank", "duplicate", "truncated")]
        assert kept.get(c, []) == list(lines)
        assert digests.get(c, sha256(b"").hexdigest()) == sha256("\n".join(lines).encode()).hexdigest()
        assert got[c]["illegal"] == sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in zip(v, v[1:]))
        assert got[c]["gaps"] == 0


def test_checkpoints_and_cuts_do_not_change_the_edits():
    rng = random.Random(7)
    for n in (1, 2, 3, 17, 400):
        codes = bytes(rng.randrange(16) for _ in range(n))
        cost, parts = cheapest_edits(codes)
        whole = "".join(e for _, e in parts)
        cuts = sorted({0, *(rng.randrange(n) for _ in range(5))})
        again, cut_parts = cheapest_edits(codes, cuts)
        assert again == cost and "".join(e for _, e in cut_parts) == whole and len(cut_parts) == len(cuts)


def test_one_long_conversation_is_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(turn_repair, "BLOCK_BITS", 3)
    rng = random.Random(1)
    rows = [(7, i, rng.choice(["user", "assistant"]), rng.choice(["So.", "half", f"No {i}."])) for i in range(120)]
    got, kept, digests = report(spark, rows + [(8, 0, "user", "Hi."), (8, 1, "assistant", "Yes.")])
    _, (cost, audit, lines) = brute([r[2:] for r in rows])
    assert (got[7]["cost"], got[7]["audit"]) == (cost, audit)
    assert kept[7] == list(lines) and digests[7] == sha256("\n".join(lines).encode()).hexdigest()
    assert got[8]["audit"] == "KK"


def test_nulls_ties_gaps_and_empty_tables(spark):
    rows = [
        (None, None, None, None), (None, 3, "user", "A."), (None, 3, "user", "A."), (None, 9, "assistant", "B."),
        (1, None, "user", "x" * 300_000), (2, 5, None, "Text."), (2, 5, None, "Text."),
    ]
    got, kept, _ = report(spark, rows)
    assert got[None]["audit"] == "DKDK" and got[None]["gaps"] == 5 and got[None]["blank"] == 1
    assert got[None]["duplicate"] == 1 and kept[None] == ["user:A.", "assistant:B."]
    # A cut turn without an answer is cheaper to delete; its conversation is left empty.
    assert got[1]["audit"] == "D" and got[1]["gaps"] == 0 and 1 not in kept
    assert got[2]["audit"] == "DD" and got[2]["illegal"] == 1
    assert report(spark, []) == ({}, {}, {})


def test_clashing_columns_are_ignored(spark):
    rows = spark.createDataFrame([(1, 0, "user", "Hi.", 3), (1, 1, "assistant", "Yes.", 4)], SCHEMA + ", at int")
    rows = rows.selectExpr("*", "1 AS code", "2 AS same", "'x' AS edits", "5 AS block")
    table, turns, _ = repair_conversations(rows)
    assert table.first()["audit"] == "KK" and turns.count() == 2


@pytest.mark.parametrize("draw, expected", [
    (0, []), (1, [("assistant", "")]), (2, [("assistant", "So it is")]),
    (3, [("assistant", "So it is.")] * 2), (4, [("user", "So it is.")]), (5, [("assistant", "So it is.")]),
])
def test_damage_by_draw(spark, draw, expected):
    import zlib

    turn = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == draw)
    out = damage(spark.createDataFrame([(5, turn, "assistant", "So it is.")], SCHEMA))
    assert [tuple(r) for r in out.select("role", "text").collect()] == expected
    nulls = damage(spark.createDataFrame([(None, None, None, None)], SCHEMA)).collect()
    assert zlib.crc32(b" : ") % 20 not in range(5) and [tuple(r) for r in nulls] == [(None, None, " ", " ")]
