"""Encoding texts to fixed-length id rows, and decoding ids back to text."""

from typing import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F, types as T

from answerloom.functions.ids import pad_right
from answerloom.functions.templates import pair_text, text_is_cut
from answerloom.operators.merges import every_other
from answerloom.operators.tokenizer import SPECIALS, segments, token_bytes
from answerloom.session import ship_package

IDS = T.ArrayType(T.IntegerType(), False)
CACHED_WORDS = 500_000  # words a task remembers,
CACHED_IDS = 4_000_000  # and their ids


class _Words:
    """Ids of all words met so far in one task, as flat arrays with one slot per word.

    New words are encoded together: every round merges, in each word, the pair
    of lowest rank at all its places, left to right, until no word has a pair left.
    """

    def __init__(self, tokens, merges):
        self.ids = {t: i for i, t in enumerate(tokens)}
        self.byte_ids = np.full(256, self.ids["<unk>"], np.int64)
        for token, i in self.ids.items():
            if token not in SPECIALS and len(token) == 1:
                self.byte_ids[token_bytes(token)[0]] = i
        self.base = len(tokens)
        pairs = np.array(
            [(self.ids[a] * self.base + self.ids[b], self.ids[a + b]) for a, b in merges],
            np.int64,
        ).reshape(-1, 2)
        order = np.argsort(pairs[:, 0], kind="stable")
        self.keys, self.ranks, self.joined = pairs[order, 0], order, pairs[:, 1]
        self._forget()

    def _forget(self):
        self.slot = {}
        self.flat, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def slots(self, words):
        """Slot numbers of distinct words, after encoding those not met before."""
        if len(self.slot) > CACHED_WORDS or len(self.flat) > CACHED_IDS:
            self._forget()
        new = [w for w in words if w not in self.slot]
        if new:
            flat, sizes = self._encode(new)
            first = len(self.slot)
            self.slot.update((w, first + i) for i, w in enumerate(new))
            self.flat = np.concatenate((self.flat, flat))
            self.sizes = np.concatenate((self.sizes, sizes))
        return np.fromiter((self.slot[w] for w in words), np.int64, len(words))

    def _pair_ranks(self, symbols, word):
        none = len(self.keys)
        ranks = np.full(len(symbols), none, np.int64)
        if none and len(symbols) > 1:
            key = symbols[:-1] * self.base + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), none - 1)
            known = (self.keys[at] == key) & (word[:-1] == word[1:])
            ranks[:-1][known] = self.ranks[at[known]]
        return ranks

    def _encode(self, words):
        raw = [b"?" if w in SPECIALS else w.encode("utf-8") for w in words]
        sizes = np.fromiter((len(r) for r in raw), np.int64, len(raw))
        symbols = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        starts = np.cumsum(sizes) - sizes
        for i, w in enumerate(words):
            if w in SPECIALS:
                symbols[starts[i]] = self.ids[w]
        word = np.repeat(np.arange(len(words)), sizes)
        done = []
        while len(symbols):
            ranks = self._pair_ranks(symbols, word)
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            best = np.repeat(
                np.minimum.reduceat(ranks, first), np.diff(np.append(first, len(word)))
            )
            open_words = best < len(self.keys)
            done.append((symbols[~open_words], word[~open_words]))
            hit = (ranks == best)[open_words]
            symbols, word, ranks = symbols[open_words], word[open_words], ranks[open_words]
            left = every_other(np.flatnonzero(hit))
            symbols[left] = self.joined[ranks[left]]
            keep = np.ones(len(symbols), bool)
            keep[left + 1] = False
            symbols, word = symbols[keep], word[keep]
        symbols, word = (np.concatenate(c) for c in zip(*done))
        return symbols[np.argsort(word, kind="stable")].astype(np.int32), np.bincount(word, minlength=len(words))


def _encode_batch(rows, known):
    """Encode each distinct word of a batch once and lay the ids out by offsets."""
    offsets = rows.offsets.to_numpy() - rows.offsets[0].as_py()
    coded = pc.dictionary_encode(rows.flatten())
    slots = known.slots(coded.dictionary.to_pylist())
    used = slots[coded.indices.to_numpy(zero_copy_only=False)]
    starts = (np.cumsum(known.sizes) - known.sizes)[used]
    lengths = known.sizes[used]
    ends = np.concatenate(([0], np.cumsum(lengths)))
    ids = known.flat[np.arange(ends[-1]) + np.repeat(starts - ends[:-1], lengths)]
    return pa.ListArray.from_arrays(pa.array(ends[offsets], pa.int32()), pa.array(ids, pa.int32()))


def encoder(spark, model):
    """A column function: text to ids, NULL to NULL. The word split runs in the JVM.

    Only the word arrays cross to Python, one Arrow batch at a time; there is no
    shuffle. The model is broadcast; its size is bounded by the vocabulary.
    """
    ship_package(spark)
    shared = spark.sparkContext.broadcast((model.tokens, model.merges))

    @F.arrow_udf(IDS)
    def encode_words(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = _Words(*shared.value)
        for rows in batches:
            yield _encode_batch(rows, known)

    return lambda text: F.when(text.isNotNull(), encode_words(segments(text)))


def id_rows(df, ids, max_len, pad=0):
    """Fixed-length rows with the token count before padding and a cut flag."""
    return df.withColumn("_ids", ids).withColumns({
        "input_ids": pad_right(F.col("_ids"), max_len, pad),
        "n_tokens": F.least(F.size("_ids"), F.lit(max_len)),
        "truncated": F.size("_ids") > max_len,
    }).drop("_ids")


def tokenize_pairs(pairs, model, max_seq_len=1024, max_chars=None, style="standard"):
    """Template, encode, cut and pad every pair; keys and split stay with the row.

    ``truncated`` rows have more ids than ``max_seq_len``, ``text_cut`` rows more
    characters than ``max_chars`` allows.
    """
    encode = encoder(pairs.sparkSession, model)
    keys = [c for c in ("question_id", "answer_id", "split") if c in pairs.columns]
    texts = pairs.select(
        *keys, text_is_cut(pairs, max_chars).alias("text_cut"), pair_text(pairs, max_chars, style).alias("_text"))
    return id_rows(texts, encode(F.col("_text")), max_seq_len, model.token_id("<pad>")).drop("_text")


def decode(ids, model, skip_specials=True):
    """Ids to text without a join: the vocabulary is one constant array of hex strings.

    NULL gives NULL; an id outside the vocabulary is an error.
    """
    hexes = []
    for token in model.tokens:
        special = token in SPECIALS
        raw = b"" if special and skip_specials else token.encode() if special else token_bytes(token)
        hexes.append(raw.hex())
    table = F.split(F.lit(" ".join(hexes)), " ")
    outside = F.raise_error(F.lit("an id is outside the vocabulary")).cast("string")
    text = F.array_join(F.transform(ids, lambda i: F.coalesce(F.get(table, i), outside)), "")
    return F.make_valid_utf8(F.unhex(text).cast("string"))
