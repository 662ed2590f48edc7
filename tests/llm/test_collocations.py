"""Phrase scores against plain counting; the quicksort, overlapping blocks and spread heads on their own."""

import random
import re
from collections import Counter

import numpy as np

from answerloom.llm import collocations as c

SCHEMA = "doc_id long, text string, lang string"


def brute(rows, least=10, top=2000):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lowered):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                f.update((lang, tuple(words[i:i + k])) for i in range(len(words) - k + 1))
    out = []
    for (lang, p), a in f.items():
        if len(p) == 1 or a < least:
            continue
        longer = [m for (other, q), m in f.items() if other == lang and len(q) == 3 > len(p) and p in (q[:2], q[1:]) and m >= least]
        if any(100 * m >= 50 * a for m in longer):
            continue
        cuts = [(10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    result = []
    for lang in {r[0] for r in out}:
        best = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:top]
        result += [(lang, i + 1, *r[1:]) for i, r in enumerate(best)]
    return sorted(result)


def texts(seed, n):
    rng = random.Random(seed)
    words = ["the", "The", "of", "new", "york", "city", "état", "ß", "a b", "日本"]
    return ["".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", " "])
                    for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_partitions_are_counts():
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 5, (2000, 3))
    keys[rng.random(2000) < .2, 2] = c.END
    weights = rng.integers(1, 4, 2000)
    plain = Counter()
    for row, w in zip(keys.tolist(), weights.tolist()):
        for d in (1, 2, 3):
            if c.END not in row[:d]:
                plain[tuple(row[:d])] += w
    found = lambda *args: {tuple(keys[p, :d].tolist()): w for p, d, w in zip(*(x.tolist() for x in args))}
    assert found(*c.equal_partitions(keys, weights, [0, 0, 0, 0])) == plain
    some = found(*c.equal_partitions(keys, weights, [0, 0, 30, 30]))
    assert some == {k: w for k, w in plain.items() if len(k) == 1 or w >= 30}
    pointer, _, weight = c.equal_partitions(keys, weights, [0, 0, 0, 0], leaves=True)
    whole = Counter()
    for row, w in zip(map(tuple, keys.tolist()), weights.tolist()):
        whole[row] += w
    assert {tuple(keys[p].tolist()): w for p, w in zip(pointer, weight)} == whole
    assert [len(x) for x in c.equal_partitions(keys[:0], weights[:0], [0, 0, 0, 0])] == [0, 0, 0]


def test_against_plain_counting(spark):
    rows = [(i, t, [None, "en", "de"][i % 3]) for i, t in enumerate(texts(1, 200))]
    rows += [(None, None, "en"), (1, "", None), (2, " .,\t", "xx"), (3, "x" * 100_000, "en"), (3, "x" * 100_000, "en")]
    got = c.collocations(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got)) == brute(rows) and len(got) > 20
    few = c.collocations(spark.createDataFrame(rows, SCHEMA), top=3).collect()
    assert sorted(map(tuple, few)) == brute(rows, top=3)


def test_long_texts_come_in_overlapping_blocks(spark):
    rows = [(1, " ".join(texts(2, 80)), "en"), (2, "new york " * 50, "en"), (3, "." * 500 + "new york city" * 3, "en")]
    phrases = lambda block: sorted(map(tuple, c.frequent_phrases(
        c.suffix_counts(spark.createDataFrame(rows, SCHEMA), block=block), least=1).collect()))
    whole = phrases(1_000_000)
    for block in (7, 40, 333):
        assert phrases(block) == whole


def test_heavy_heads_are_spread(spark):
    rows = [(i, t, "en") for i, t in enumerate(texts(4, 150))] + [(i, f"new york place{i % 40}", "en") for i in range(600)]
    suffixes = c.suffix_counts(spark.createDataFrame(rows, SCHEMA).repartition(16))
    usual = sorted(map(tuple, c.frequent_phrases(suffixes).collect()))
    assert usual == sorted(map(tuple, c.frequent_phrases(suffixes, most=20).collect()))


def test_empty_and_clashing_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert c.collocations(empty).count() == 0
    rows = spark.createDataFrame([(i, "so it goes", "en") for i in range(12)], SCHEMA)
    rows = rows.selectExpr("*", "1 AS suffix", "'q' AS head", "2 AS n", "3 AS phrase")
    got = c.collocations(rows).collect()
    assert [tuple(r) for r in got] == [("en", 1, "so it goes", 12, 12, 12, 36, 1_000_000)]
