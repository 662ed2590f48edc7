"""Learning byte-pair merges: rounds that guess many dependent merges and check them on all words.

A word is a string with one character per symbol; the character order equals the id order. The
words stay on the cluster. A round
1. guesses the next merges from exact pair counts and a bounded sample of the most frequent words,
2. has every task replay them, one after the other, on its words, found by an index from pairs to places,
   and report how each merge changes pair counts,
3. follows the exact counts in the driver and keeps the merges up to the first one that is not the
   most frequent pair. The first is always right, so a wrong guess costs a round, never a merge.
"""

from functools import partial
from heapq import heapify, heappop, heappush

import numpy as np
from pyspark.sql import functions as F

from answerloom.session import delete_path, ship_package, work_dir

GUESS_WORDS = 200_000  # words of the sample that guesses are made from
AT_ONCE = 512  # merges guessed in a round
MAX_PENDING = 1_024  # merges replayed before the words are written anew
WORDS_AT_ONCE = 200_000  # words indexed together by a task,
SYMBOLS_AT_ONCE = 1_000_000  # or so many symbols, whichever is reached first


def every_other(places):
    """Of each run of neighbouring places keep the first, third, ... (no overlaps)."""
    starts = np.concatenate(([True], np.diff(places) != 1)) if len(places) else np.zeros(0, bool)
    run_start = np.maximum.accumulate(np.where(starts, np.arange(len(places)), 0))
    return places[(np.arange(len(places)) - run_start) % 2 == 0]


def pair_key(left, right):
    return left << 32 | right


class Places:
    """Words as linked lists of symbols, and an index from pairs to the places where they stand."""

    def __init__(self, words, counts, wanted=None):
        """``wanted``: the pair keys that will be merged (None: any may be)."""
        text = "".join(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        self.symbols = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
        self.bounds = np.concatenate(([0], np.cumsum(sizes)))
        self.weights = np.repeat(np.asarray(counts, np.int64), sizes)
        self.following = np.arange(1, len(text) + 1)
        self.before = np.arange(-1, len(text) - 1)
        self.following[self.bounds[1:][sizes > 0] - 1] = -1
        self.before[self.bounds[:-1][sizes > 0]] = -1
        self.wanted = None if wanted is None else np.unique(np.asarray(wanted, np.int64))
        at = np.flatnonzero(self.following >= 0)
        keys = self._keys(at)
        if wanted is not None:
            some = np.isin(keys, self.wanted)
            at, keys = at[some], keys[some]
        order = np.argsort(keys, kind="stable")
        self.keys, self.at, self.added = keys[order], at[order], {}

    def copy(self):
        """A copy to try merges on; what never changes is shared."""
        other = object.__new__(Places)
        other.__dict__.update(self.__dict__)
        for name in ("symbols", "following", "before"):
            setattr(other, name, getattr(self, name).copy())
        other.added = {key: list(parts) for key, parts in self.added.items()}
        return other

    def _keys(self, at):
        return pair_key(self.symbols[at], self.symbols[self.following[at]])

    def _places(self, left, right):
        low, high = np.searchsorted(self.keys, [pair_key(left, right), pair_key(left, right) + 1])
        parts = [self.at[low:high], *self.added.pop(pair_key(left, right), [])]
        at = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
        at = at[(self.symbols[at] == left) & (self.following[at] >= 0)]
        at = at[self.symbols[self.following[at]] == right]
        if left == right and len(at) > 1:
            # In a run of one symbol every other place is merged, from the left.
            linked = np.cumsum(np.concatenate(([0], 1 + (self.following[at[:-1]] != at[1:]))))
            at = at[np.isin(linked, every_other(linked))]
        return at

    def merge(self, left, right, symbol):
        """Put ``symbol`` where the pair stands; ``(pair keys, changes of their counts, places merged)``."""
        at = self._places(left, right)
        if not len(at):
            return at, at, 0
        gone = self.following[at]
        behind = self.following[gone]
        front = self.before[at]
        old = np.unique(np.concatenate((front[front >= 0], at, gone[behind >= 0])))
        old_keys = self._keys(old)
        self.symbols[at], self.symbols[gone] = symbol, -1
        self.following[at] = behind
        self.before[behind[behind >= 0]] = at[behind >= 0]
        front = self.before[at]
        new = np.unique(np.concatenate((front[front >= 0], at[behind >= 0])))
        new_keys = self._keys(new)
        self._index(new, new_keys)
        keys = np.concatenate((old_keys, new_keys))
        change = np.concatenate((-self.weights[old], self.weights[new]))
        order = np.argsort(keys)
        keys, change = keys[order], change[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        change = np.add.reduceat(change, first)
        return keys[first][change != 0], change[change != 0], int(self.weights[at].sum())

    def _index(self, at, keys):
        if self.wanted is not None:
            some = np.isin(keys, self.wanted)
            at, keys = at[some], keys[some]
        if not len(at):
            return
        order = np.argsort(keys, kind="stable")
        at, keys = at[order], keys[order]
        cuts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        for key, part in zip(keys[cuts].tolist(), np.split(at, cuts[1:])):
            self.added.setdefault(key, []).append(part)

    def words(self):
        """The words as they are now."""
        alive = self.symbols >= 0
        text = self.symbols[alive].astype("<u4").tobytes().decode("utf-32-le")
        ends = np.concatenate(([0], np.cumsum(alive)))[self.bounds].tolist()
        return [text[a:b] for a, b in zip(ends, ends[1:])]


class PairCounts:
    """Exact counts of the most frequent pairs; a pair that is not among them has at most ``floor``."""

    def __init__(self, counts, floor):
        self.counts, self.floor, self.fresh = counts, floor, True
        self.heap = [(-n, key) for key, n in counts.items()]
        heapify(self.heap)

    def copy(self):
        other = object.__new__(PairCounts)
        other.counts, other.floor, other.fresh, other.heap = dict(self.counts), self.floor, self.fresh, list(self.heap)
        return other

    def best(self):
        """The most frequent pair (ties: the smaller one), if no pair outside can be as frequent."""
        while self.heap:
            n, key = self.heap[0]
            now = self.counts.get(key, 0)
            if now == -n:
                # Straight after a full count the list is sorted, so its head is right even in a tie.
                return (key, now) if now > self.floor or self.fresh else None
            heappop(self.heap)
            if now > 0:
                heappush(self.heap, (-now, key))
        return None

    def change(self, keys, changes, symbol):
        """Add to the counts of known pairs and of those with the new ``symbol``."""
        self.fresh = False
        for key, d in zip(keys, changes):
            if key in self.counts or key >> 32 == symbol or key & 0xFFFFFFFF == symbol:
                n = self.counts[key] = self.counts.get(key, 0) + d
                if n <= 0:
                    del self.counts[key]
                elif d > 0:
                    heappush(self.heap, (-n, key))


def _chars(key):
    return chr(key >> 32) + chr(key & 0xFFFFFFFF)


def _guess(sample, exact, vocab, most):
    """The next merges ``(left, right, symbol)`` as they follow from the counts and the sample's changes.

    A merge's changes in the sample are scaled up by how much more frequent its pair is in all
    words. The guess ends with a pair whose joined token exists already.
    """
    sample, counts, trial, out = sample.copy(), exact.copy(), vocab.copy(), []
    while len(out) < most and (best := counts.best()):
        key, n = best
        existed = trial.joined(_chars(key)) in trial.ids
        symbol = ord(trial.add(_chars(key)))
        out.append((key >> 32, key & 0xFFFFFFFF, symbol))
        if existed:
            break
        keys, change, found = sample.merge(*out[-1])
        scale = n / found if found else 0
        change = change if scale == 1 else np.rint(change * scale).astype(np.int64)
        counts.change(keys.tolist(), change.tolist(), symbol)
        counts.counts.pop(key, None)
    return out


def _word_blocks(batches):
    """Words and counts in blocks bounded by words and by symbols, so that long words take no more memory."""
    words, counts, symbols = [], [], 0
    for batch in batches:
        for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words.append(word)
            counts.append(n)
            symbols += len(word)
            if len(words) >= WORDS_AT_ONCE or symbols >= SYMBOLS_AT_ONCE:
                yield words, counts
                words, counts, symbols = [], [], 0
    if words:
        yield words, counts


def _replay(pending, merges, batches):
    """How each of ``merges`` changes pair counts in these words, ``pending`` ones applied first."""
    import pyarrow as pa

    wanted = [pair_key(a, b) for a, b, _ in pending + merges]
    for words, counts in _word_blocks(batches):
        places = Places(words, counts, wanted)
        for merge in pending:
            places.merge(*merge)
        found = [places.merge(*merge)[:2] for merge in merges]
        sizes = [len(keys) for keys, _ in found]
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat(np.arange(len(merges), dtype=np.int32), sizes)),
            *(pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*found))], ["step", "pair", "d"])


def _rewrite(merges, batches):
    import pyarrow as pa

    wanted = [pair_key(a, b) for a, b, _ in merges]
    for words, counts in _word_blocks(batches):
        places = Places(words, counts, wanted)
        for merge in merges:
            places.merge(*merge)
        yield pa.RecordBatch.from_arrays([pa.array(places.words(), pa.string()), pa.array(counts, pa.int64())], ["word", "n"])


def _merged(words, merges):
    """The word table with merges applied; words of one symbol have no pairs and go."""
    if not merges:
        return words
    return words.mapInArrow(partial(_rewrite, merges), "word string, n long").where(F.length("word") > 1)


def top_pairs(words, limit):
    """The most frequent pairs of a full count, and the count no other pair exceeds."""
    last = F.length("word") - 1
    pairs = F.transform(F.sequence(F.lit(1), last), lambda i: F.substring("word", i, F.lit(2)))
    rows = (
        words.where(F.length("word") > 1).select(F.explode(pairs).alias("pair"), "n").groupBy("pair")
        .agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.asc("pair")).limit(limit + 1).collect()
    )
    floor = rows[-1]["n"] if len(rows) > limit else 0
    return PairCounts({pair_key(*map(ord, r["pair"])): r["n"] for r in rows[:limit]}, floor)


def learn_merges(words, vocab, vocab_size, listed=16_384, guess_words=GUESS_WORDS, at_once=AT_ONCE,
                 max_pending=MAX_PENDING):
    """Add the merges of a ``(word, n)`` table to ``vocab`` until it has ``vocab_size`` tokens; the rounds it took.

    Exact at every setting. What reaches the driver is bounded: ``listed`` pairs, ``guess_words``
    words, and per merge the pairs it touches (at most four per symbol). A round is one job that scans the words once.
    ``max_pending`` merges are replayed on the words before they are written anew and the
    table before is deleted, so a lost executor costs at most that many merges.
    """
    spark = words.sparkSession
    ship_package(spark)
    base, pending, path, rounds, reach = words, [], None, 0, at_once
    head = words.orderBy(F.desc("n"), F.asc("word")).limit(guess_words).toArrow().to_pydict()
    sample = Places(head["word"], head["n"])
    exact = top_pairs(base, listed)
    while len(vocab.tokens) < vocab_size:
        if exact.best() is None:
            if exact.fresh:
                break
            exact = top_pairs(_merged(base, pending), listed)
            continue
        rounds += 1
        merges = _guess(sample, exact, vocab, min(reach, vocab_size - len(vocab.tokens)))
        rows = base.mapInArrow(partial(_replay, pending, merges), "step int, pair long, d long")
        changes = rows.groupBy("step", "pair").agg(F.sum("d").alias("d")).where("d <> 0").orderBy("step").toArrow().to_pydict()
        cuts = np.searchsorted(changes["step"], np.arange(len(merges) + 1)).tolist()
        done = len(vocab.merges)
        for i, merge in enumerate(merges):
            best = exact.best()
            if best is None or best[0] != pair_key(*merge[:2]):
                break
            existed = vocab.joined(_chars(best[0])) in vocab.ids
            vocab.add(_chars(best[0]))
            sample.merge(*merge)
            pending.append(merge)
            exact.change(changes["pair"][cuts[i]:cuts[i + 1]], changes["d"][cuts[i]:cuts[i + 1]], merge[2])
            if existed:
                # Pairs with a symbol that was there before may have grown unseen: count anew.
                exact = PairCounts({}, 0)
                exact.fresh = False
                break
        # Guesses reach about twice as far as the last ones were right.
        reach = min(at_once, max(2 * (len(vocab.merges) - done), 32))
        if len(pending) >= max_pending:
            old, path = path, work_dir(spark, "merged-words")
            _merged(base, pending).write.parquet(path)
            base, pending = spark.read.schema("word string, n long").parquet(path), []
            if old:
                delete_path(spark, old)
    if path:
        delete_path(spark, path)
    return rounds
