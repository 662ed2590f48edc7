"""Merge replay on an index of places, exact following of counts, guesses that are wrong."""

import random
from collections import Counter

import pytest

from answerloom.operators import merges as mg, tokenizer as tk


def naive_pairs(table):
    pairs = Counter()
    for w, n in table:
        for a, b in zip(w, w[1:]):
            pairs[mg.pair_key(ord(a), ord(b))] += n
    return pairs


def naive_merge(table, left, right, symbol):
    return [(w.replace(chr(left) + chr(right), chr(symbol)), n) for w, n in table]


def random_words(rng):
    return [("".join(rng.choice("aabcd") for _ in range(rng.randint(0, 9))), rng.randint(1, 9)) for _ in range(rng.randint(1, 40))]


@pytest.mark.parametrize("seed", range(40))
def test_replay_changes_counts_as_replacing_text_does(seed):
    rng = random.Random(seed)
    table = random_words(rng)
    steps, symbols = [], [ord(c) for c in "abcd"]
    for i in range(8):
        # Now and then a pair becomes a symbol that exists already.
        symbol = rng.choice(symbols) if rng.random() < .2 else 0x100 + i
        steps.append((rng.choice(symbols), rng.choice(symbols), symbol))
        symbols.append(symbol)
    steps = [s for s in steps if s[2] not in s[:2]]
    for wanted in (None, [mg.pair_key(a, b) for a, b, _ in steps]):
        places, now = mg.Places([w for w, _ in table], [n for _, n in table], wanted), table
        for step in steps:
            kept = places.copy()
            keys, change, _ = places.merge(*step)
            after = naive_merge(now, *step)
            plain = naive_pairs(after)
            plain.subtract(naive_pairs(now))
            assert dict(zip(keys.tolist(), change.tolist())) == {k: d for k, d in plain.items() if d}
            assert kept.words() == [w for w, _ in now]
            now = after
            assert places.words() == [w for w, _ in now]


def test_random_tables_at_every_setting(spark):
    rng = random.Random(11)
    for case in range(2):
        raw = [(w, n) for w, n in random_words(rng) + random_words(rng) if w]
        vocab = tk._Vocabulary([ord(c) for c in "abcd"])
        table = [("".join(vocab.byte_symbols[ord(c)] for c in w), n) for w, n in raw]
        plain, now = vocab.copy(), table
        while len(plain.tokens) < 40 and (pairs := naive_pairs(now)):
            key = min(pairs, key=lambda k: (-pairs[k], k))
            symbol = plain.add(mg._chars(key))
            now = naive_merge(now, key >> 32, key & 0xFFFFFFFF, ord(symbol))
        words = spark.createDataFrame(table, "word string, n long").repartition(3)
        for rounds in ({}, {"guess_words": 2}, {"listed": 3}, {"guess_words": 5, "listed": 6, "at_once": 4, "max_pending": 3}):
            got = vocab.copy()
            mg.learn_merges(words, got, 40, **rounds)
            assert got.merges == plain.merges, (case, rounds)


def test_wrong_guesses_cost_rounds_only(spark):
    from conftest import SF

    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(40).collect() if r.text]
    counts = tk.pretoken_counts(spark.createDataFrame([(t,) for t in texts], "line string")).cache()
    whole = tk.learn_bpe(counts, 350)
    assert tk.learn_bpe(counts, 350, guess_words=50).merges == whole.merges


def test_two_thousand_tokens_equal_the_library(spark):
    lib = pytest.importorskip("tokenizers")
    from conftest import SF

    lines = [t for r in spark.read.parquet(f"{SF}/conversations.parquet").collect() for t in r.text.split("\n") if t]
    rounds, plain = [], mg.learn_merges
    try:
        tk.learn_merges = lambda *a, **k: rounds.append(plain(*a, **k))
        model = tk.learn_bpe(tk.pretoken_counts(spark.createDataFrame([(t,) for t in lines], "line string")), 2000)
    finally:
        tk.learn_merges = plain
    tok = lib.Tokenizer(lib.models.BPE(unk_token="<unk>"))
    tok.pre_tokenizer = lib.pre_tokenizers.ByteLevel(add_prefix_space=False)
    trainer = lib.trainers.BpeTrainer(vocab_size=2000, special_tokens=list(tk.SPECIALS), show_progress=False)
    tok.train_from_iterator(lines, trainer=trainer)
    assert [t for t, _ in sorted(tok.get_vocab().items(), key=lambda kv: kv[1])] == list(model.tokens)
    # All words fit in the sample, so guesses are right and a round is 512 merges.
    assert rounds == [4]


def test_word_blocks_are_bounded_by_symbols():
    import pyarrow as pa
    from answerloom.operators import merges as mg

    words = ["x" * 5_000] * 1_000 + ["y" * 3] * 1_000
    batches = [pa.RecordBatch.from_pydict({"word": words[i:i + 500], "n": list(range(i, i + 500))}) for i in range(0, 2_000, 500)]
    blocks = list(mg._word_blocks(batches))
    assert [w for ws, _ in blocks for w in ws] == words and [n for _, ns in blocks for n in ns] == list(range(2_000))
    assert max(sum(map(len, ws)) for ws, _ in blocks) < mg.SYMBOLS_AT_ONCE + 5_000


def test_remembered_words_are_bounded_by_ids(monkeypatch):
    from answerloom.operators import encode as en

    monkeypatch.setattr(en, "CACHED_IDS", 1_000)
    known = en._Words(["<pad>", "<unk>", *en.SPECIALS[2:], *"abc"], [])
    for i in range(50):
        slots = known.slots([f"{'abc'[i % 3] * 90}{'ab' * i}"])
        assert known.sizes[slots[0]] == 90 + 2 * i and len(known.flat) < 1_000 + 200
