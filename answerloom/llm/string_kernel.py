"""Toxicity by a subsequence-kernel support vector machine with Nyström landmarks."""

import pickle
import re
import unicodedata
from functools import lru_cache, partial
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from answerloom.llm.textscan import Memo, Pool
from answerloom.session import ship_package

ORDER, SPAN, DECAY, LONGEST = 4, 8, 0.6, 16
SYMBOLS = 32
BEGIN, END, OTHER = 27, 28, 29
LANDMARKS, ROUNDS = 160, 2
#: A text is judged by so many of its units, whose values count from FLOOR up.
BEST, FLOOR = 3, -0.5
#: Log-likelihood ratio (chi-squared, one degree) that a first piece of evidence must reach.
SIGNIFICANT = 15

#: Bytes of a UTF-8 character by its first byte.
LETTER_BYTES = np.repeat([1, 2, 3, 4], [0xC0, 0x20, 0x10, 0x10])
#: Characters that stand in for letters.
LOOKALIKE = str.maketrans("01345@$7!|", "oieasastii")
EDGE = re.compile(r"^[\W_]+|[\W_]+$")
SPELLED = re.compile(r"[^\W_](?:[\W_]+[^\W_]){2,}")
SENTENCE = re.compile(r"[.?!\n]\s+|\n")


@lru_cache(maxsize=50_000)
def fold(word):
    """Lower-case base letters of a word; marks at its ends go, marks inside stay as gaps.

    Letters that are all set apart (``i.d-i.o.t``) are joined.
    """
    word = word if word.isascii() else "".join(
        c for c in unicodedata.normalize("NFKD", word.replace("ß", "ss")) if not unicodedata.combining(c))
    word = EDGE.sub("", word.lower())
    if SPELLED.fullmatch(word):
        word = re.sub(r"[\W_]", "", word)
    return word.translate(LOOKALIKE)


@lru_cache(maxsize=None)
def _paths(length):
    """Index tuples of the gapped subsequences of a unit, their weights, and the unit's norm."""
    paths = [
        (i, *rest) for i in range(length - ORDER + 1)
        for rest in combinations(range(i + 1, min(length, i + SPAN)), ORDER - 1)
    ]
    weights = np.array([DECAY ** (p[-1] - p[0] + 1 - ORDER) for p in paths])
    return np.array(paths).T, weights, float(np.sqrt((weights**2).sum()))


def encode(unit):
    """Symbol numbers of a folded unit between its end marks; none if it has no two letters.

    Letters of other scripts share the 26 letter symbols by their code point, so neighbours in an alphabet differ.
    """
    codes = [ord(c) - 96 if "a" <= c <= "z" else 1 + ord(c) % 26 if c.isalpha() else OTHER for c in unit]
    if sum(c != OTHER for c in codes) < 2:
        return []
    codes = [BEGIN, *codes, END]
    if len(codes) <= LONGEST:
        return [codes]
    # Long strings are looked at through overlapping windows.
    last = len(codes) - LONGEST
    return [codes[a:a + LONGEST] for a in [*range(0, last, LONGEST // 2), last]]


def _batches(units, size=4_000):
    """Windows of equal length together: (owner, feature numbers, weights / norm)."""
    by_length = {}
    for i, unit in enumerate(units):
        for codes in encode(unit):
            by_length.setdefault(len(codes), []).append((i, codes))
    for length, found in by_length.items():
        paths, weights, norm = _paths(length)
        for a in range(0, len(found), size):
            part = found[a:a + size]
            codes = np.array([c for _, c in part], np.int32)
            features = codes[:, paths[0]]
            for p in paths[1:]:
                features = features * SYMBOLS + codes[:, p]
            yield np.array([i for i, _ in part]), features, (weights / norm).astype(np.float32)


def unit_scores(model, units):
    """The machine's value of every unit (a window's best); units without letters get the lowest."""
    out = np.full(len(units), -3.0)
    for owner, features, weights in _batches(units):
        np.maximum.at(out, owner, model["primal"][features] @ weights + model["bias"])
    return out


def _landmark_kernel(units, landmarks):
    """K(unit, landmark) from the explicit subsequence features (first window of a unit)."""
    column = np.zeros(SYMBOLS**ORDER, np.int32)
    cells = []
    for owner, features, weights in _batches(landmarks):
        for i, row in zip(owner, features):
            cells.append((i, row, weights))
    known = np.unique(np.concatenate([row for _, row, _ in cells]))
    column[known] = np.arange(1, len(known) + 1)
    table = np.zeros((len(known) + 1, len(landmarks)), np.float32)
    for i, row, weights in cells:
        np.add.at(table[:, i], column[row], weights)
    kernel = np.zeros((len(units), len(landmarks)), np.float32)
    for owner, features, weights in _batches(units, 50):
        values = np.einsum("ufm,f->um", table[column[features]], weights)
        kernel[owner] = np.maximum(kernel[owner], values)
    return kernel, cells


def _svm(x, y, cost, ridge=1.0):
    """Squared-hinge linear machine by Newton steps; the last coefficient is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
    w = np.zeros(x.shape[1])
    reg = np.full(x.shape[1], ridge)
    reg[-1] = 1e-3
    for _ in range(30):
        short = y * (x @ w) < 1
        a = x[short] * cost[short, None]
        new = np.linalg.solve(np.diag(reg) + a.T @ x[short], a.T @ y[short])
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return w


def _top(row, values, rows):
    """The BEST highest distinct values of every row, highest first, from (row, value) pairs."""
    out = np.full((rows, BEST), FLOOR)
    high = values > FLOOR
    order = np.lexsort((-values[high], row[high]))
    row, values = row[high][order], values[high][order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (values[1:] != values[:-1])
    row, values = row[new], values[new]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    kept = place < BEST
    out[row[kept], place[kept]] = values[kept]
    return out


def _merged(a, b):
    """The highest distinct values of two such tables."""
    both = np.hstack([a, b])
    return _top(np.repeat(np.arange(len(a)), both.shape[1]), both.reshape(-1), len(a))


def _monotone(values, y):
    """Logistic weights of which none is negative (such a column is left out), and an offset."""
    used = list(range(values.shape[1]))
    while True:
        w = _logistic(values[:, used], y)
        if len(used) == 1 or w[:-1].min() >= 0:
            break
        used.pop(int(w[:-1].argmin()))
    out = np.zeros(values.shape[1] + 1)
    out[[*used, -1]] = w
    return out


def _logistic(values, y):
    """Weights of P(y | values) and an offset, with Platt's smoothed targets."""
    n, m = y.sum(), (~y).sum()
    target = np.where(y, (n + 1) / (n + 2), 1 / (m + 2))
    x = np.hstack([values, np.ones((len(values), 1))])
    w, ridge = np.zeros(x.shape[1]), 1e-5 * np.eye(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - target) / len(y) + ridge @ w
        hess = (x * (p * (1 - p) / len(y))[:, None]).T @ x + ridge
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -2, 2)
        if abs(step).max() < 1e-7:
            break
    return w


def _spelled(words):
    """Runs of three or more one-letter words, joined: ``i d i o t`` is one unit."""
    run = []
    for w in [*words, ""]:
        if len(w) == 1 and w.isalnum():
            run.append(w)
        else:
            if len(run) > 2:
                yield "".join(run)
            run = []


def sentence_units(text):
    """The sentences of a text, each as the set of its folded units."""
    sentences = []
    for sentence in SENTENCE.split(text or ""):
        words = sentence.split()
        units = {fold(w) for w in [*words, *_spelled(words)]}
        units.discard("")
        if units:
            sentences.append(units)
    return sentences


def _grams(unit):
    """Four symbols in a row of a unit between its end marks."""
    marked = f"^{unit}$"
    return [marked[i:i + ORDER] for i in range(len(marked) - ORDER + 1)]


def fit(texts, toxic, landmarks=LANDMARKS, rounds=ROUNDS, negatives=8_000):
    """A model from labelled texts; None unless both labels occur.

    Instances are sentences. Those of clean texts are negative; a toxic text
    gives the sentence that holds its most telling unit, and others with telling units, at first by the
    log odds of the units' four-symbol pieces over texts, then, in every further round, by the machine itself.
    The kernel of two units counts their common subsequences of four symbols, each weighted by
    0.6 per skipped place within a span of eight. Landmarks are frequent
    telling units and evenly drawn other units; the linear machine on the
    Nyström map is folded back into one weight per subsequence, which gives the same values.
    A logistic rule turns a text's three highest values into its score.
    """
    number, bags, labels = {}, [], []
    for text, y in zip(texts, toxic):
        sentences = [
            np.array(sorted(number.setdefault(u, len(number)) for u in sorted(units)), np.int32)
            for units in sentence_units(text)
        ]
        if sentences:
            bags.append(sentences)
            labels.append(bool(y))
    toxic = np.array(labels, bool)
    if not toxic.any() or toxic.all():
        return None
    names = list(number)
    size = len(names)
    gram_number = {}
    grams = [np.array([gram_number.setdefault(g, len(gram_number)) for g in _grams(u)], np.int32) for u in names]
    # Counted over distinct sentences, so that copies of a text are no evidence of their own.
    seen, held_in, total = np.zeros((2, size), np.int64), np.zeros((2, len(gram_number)), np.int64), [0, 0]
    met = [set(), set()]
    for bag, y in zip(bags, toxic.astype(int)):
        for units in bag:
            mark = hash(units.tobytes())
            if mark not in met[y]:
                met[y].add(mark)
                total[y] += 1
                seen[y, units] += 1
                held_in[y, np.concatenate([grams[u] for u in units])] += 1
    odds, ratio = _evidence(held_in, total)
    telling = np.where((odds > 1) & (ratio > SIGNIFICANT), odds, 0.0)
    value = np.array([telling[g].max() if len(g) else 0.0 for g in grams])
    told = value > 0
    unit_odds = _evidence(seen, total)[0]
    usable = np.array([bool(encode(u)) for u in names])
    in_order = np.array(sorted(range(size), key=names.__getitem__))
    clean = in_order[(seen[0] > 0)[in_order]]
    hard, model = [], None
    for _ in range(rounds):
        witness = np.zeros(size, np.int64)
        for bag, y in zip(bags, toxic):
            if y:
                # The best unit stands in the witness sentence; other telling units count as well.
                every = np.unique(np.concatenate(bag))
                best = every[value[every].argmax()]
                witness[every[(value[every] > 0) | (every == best)]] += 1
        # A unit that clean texts hold as often, or that shares no evidence with other texts, gives none.
        found = np.flatnonzero((witness > 0) & usable & (unit_odds > 1) & told)
        positive = sorted(found.tolist(), key=lambda u: (-witness[u], names[u]))
        if not positive:
            return None
        held = set(positive)
        spread = clean[::max(1, len(clean) // negatives)].tolist()
        negative = [u for u in dict.fromkeys([*hard, *spread]) if u not in held and usable[u]]
        if not negative:
            return None
        marks = positive[:landmarks // 2] + negative[::max(1, len(negative) // (landmarks // 2))][:landmarks // 2]
        marks = [names[u] for u in marks]
        kzz, cells = _landmark_kernel(marks, marks)
        values, vectors = np.linalg.eigh((kzz + kzz.T).astype(np.float64) / 2)
        good = values > 1e-4 * values[-1]
        root = vectors[:, good] / np.sqrt(values[good])
        # Units that clean texts hold too stand on both sides, in proportion to their sentences.
        shared = [u for u in positive if seen[0, u]]
        units = positive + negative + shared
        x = _landmark_kernel([names[u] for u in units], marks)[0] @ root
        y = np.where(np.arange(len(units)) < len(positive), 1.0, -1.0)
        own = witness[positive] * (200 / witness[positive].sum())
        other = 1 + np.log1p(seen[0, negative])
        other *= 200 / other.sum()
        price = dict(zip(positive, own))
        both = np.array([price[u] * seen[0, u] / max(1, seen[1, u]) for u in shared])
        w = _svm(x, y, np.concatenate([own, other, both]))
        alpha = root @ w[:-1]
        primal = np.zeros(SYMBOLS**ORDER, np.float32)
        for i, row, weights in cells:
            np.add.at(primal, row, (alpha[i] * weights).astype(np.float32))
        model = {"primal": primal, "bias": float(w[-1])}
        value = unit_scores(model, names)
        hard = clean[np.argsort(-value[clean], kind="stable")[:2_000]].tolist()
    owners = np.repeat(np.arange(len(bags)), [sum(map(len, bag)) for bag in bags])
    best = _top(owners, value[np.concatenate([u for bag in bags for u in bag])], len(bags))
    model["weights"] = _monotone(best, toxic)
    fold.cache_clear()
    return model


def _evidence(counts, total):
    """Log odds and log-likelihood ratio of being in toxic rather than clean sentences."""
    a, b = counts[1].astype(float), counts[0].astype(float)
    n, m = total[1], total[0]
    odds = np.log((a + 0.5) / (n + 1)) - np.log((b + 0.5) / (m + 1))
    rate = (a + b) / (n + m)
    ratio = np.zeros(len(a))
    for seen, due in ((a, rate * n), (b, rate * m), (n - a, (1 - rate) * n), (m - b, (1 - rate) * m)):
        ratio += 2 * np.where(seen > 0, seen * np.log(np.where(seen > 0, seen, 1) / np.where(due > 0, due, 1)), 0)
    return odds, ratio


class _Values(Memo):
    def __init__(self):
        super().__init__(300_000)
        self.clear()

    def clear(self):
        self.values = Pool(np.float64)


def _row_scores(model, memo, column):
    """The scores of one Arrow column of texts."""
    from answerloom.llm.textscan import SPACE, blocks, row_starts, span_hashes, text_bytes

    data, offsets = text_bytes(column)
    best = np.full((len(column), BEST), FLOOR)
    for at, end in blocks(data, offsets):
        own, first = data[at:end], row_starts(offsets, at, end)
        space = SPACE[own]
        start, stop = ~space, ~space
        start[1:] &= space[:-1] | first[1:]
        stop[:-1] &= space[1:] | first[1:]
        starts, ends = np.flatnonzero(start), np.flatnonzero(stop) + 1
        row = np.searchsorted(offsets, starts + at, "right") - 1
        slots = memo.find(span_hashes(own, starts, ends, lower=True), lambda new: memo.values.extend(
            unit_scores(model, [fold(own[starts[i]:ends[i]].tobytes().decode()) for i in new.tolist()])))
        found = [(row, memo.values.array[slots])]
        single = np.flatnonzero(ends - starts == LETTER_BYTES[own[starts]])
        runs = np.split(single, np.flatnonzero((np.diff(single) != 1) | (np.diff(row[single]) != 0)) + 1)
        for run in runs:
            if len(run) > 2:
                words = [own[starts[i]:ends[i]].tobytes().decode() for i in run.tolist()]
                joined = [fold(w) for w in _spelled(words)]
                if joined:
                    found.append((np.full(len(joined), row[run[0]]), unit_scores(model, joined)))
        best = _merged(best, _top(*map(np.concatenate, zip(*found)), len(best)))
    logit = best @ model["weights"][:-1] + model["weights"][-1]
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def _memo(model):
    """The values a worker knows already; they belong to one model."""
    from answerloom.llm.textscan import kept

    return kept(("values", hash((model["primal"].tobytes(), model["bias"]))), _Values)


def _score(model, batches):
    import pyarrow as pa

    from answerloom.llm.textscan import pieces

    memo = _memo(model.value)
    for batch in batches:
        for part in pieces(batch):
            score = _row_scores(model.value, memo, part.column(1))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score)], ["id", "score"])


def _clean_rows(model, column, limit, batches):
    import pyarrow as pa

    from answerloom.llm.textscan import pieces

    memo = _memo(model.value)
    for batch in batches:
        at = batch.schema.names.index(column)
        for part in pieces(batch, at):
            yield part.filter(pa.array(_row_scores(model.value, memo, part.column(at)) < limit))


def _sample_rows(docs, labels, id_col, text_col, label_col, toxic_rows, clean_rows):
    one = labels.where(f"{id_col} IS NOT NULL AND {label_col} IS NOT NULL").groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).alias("y"))
    order = [F.xxhash64("id"), "id"]
    chosen = one.where("y = 1").orderBy(*order).limit(toxic_rows).unionByName(
        one.where("y = 0").orderBy(*order).limit(clean_rows))
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(
        F.broadcast(chosen), "id").select("id", "text", (F.col("y") == 1).alias("toxic"))


def labelled_sample(docs, labels, id_col="doc_id", text_col="text", label_col="toxic", toxic_rows=2_000, clean_rows=4_000):
    """At most so many texts of either label, by the hash of their id: ``(texts, labels)`` at the driver.

    The bound holds for the classifier's training alone. Only ids are sorted; the
    chosen ids (no more than the bound) are broadcast to one scan of the texts.
    An id with several label rows counts as toxic if one says so. ``learn`` fits without the driver.
    """
    rows = _sample_rows(docs, labels, id_col, text_col, label_col, toxic_rows, clean_rows).orderBy("id", "text").toArrow()
    # Texts are taken out of the Arrow table one by one.
    return (t.as_py() for t in rows.column("text")), rows.column("toxic").to_pylist()


def _fit_batches(batches):
    import pyarrow as pa

    from answerloom.llm.textscan import forget

    forget()
    columns = [(batch.column(1), batch.column(2)) for batch in batches]
    texts = (t.as_py() for texts, _ in columns for t in texts)
    model = fit(texts, [y for _, toxic in columns for y in toxic.to_pylist()])
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])


def learn(docs, labels, id_col="doc_id", text_col="text", label_col="toxic", toxic_rows=2_000, clean_rows=4_000):
    """The model of ``fit`` from the sample of ``labelled_sample``, fitted by one task.

    That task reads at most ``toxic_rows + clean_rows`` documents (more only where ids repeat),
    whatever the size of the corpus; the driver receives the model (4 MB), never a text.
    Empty tables, and labels of one kind only, give None.
    """
    ship_package(docs.sparkSession)
    rows = _sample_rows(docs, labels, id_col, text_col, label_col, toxic_rows, clean_rows)
    fitted = rows.repartition(1).sortWithinPartitions("id", "text").mapInArrow(_fit_batches, "model binary").collect()
    return pickle.loads(fitted[0]["model"]) if fitted else None


def toxicity_scores(docs, model, id_col="doc_id", text_col="text"):
    """``(id_col, score)`` for every row, in one pass without a shuffle.

    A text is judged by its three most toxic distinct units: blank-separated words, or runs of
    spelled-out letters. Texts without letters, NULL and
    empty texts get the lowest score; without a model (labels of one kind
    only) every score is 0. Rows with NULL or repeated ids are scored like any other.
    """
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    if model is None:
        return rows.select(F.col("id").alias(id_col), F.lit(0.0).alias("score"))
    shared = spark.sparkContext.broadcast(model)
    return rows.mapInArrow(partial(_score, shared), "id long, score double").withColumnRenamed("id", id_col)


def drop_toxic(docs, model, text_col="text", limit=0.7):
    """``docs`` without the rows that score ``limit`` or more; all columns as they are."""
    spark = docs.sparkSession
    ship_package(spark)
    if model is None:
        return docs
    shared = spark.sparkContext.broadcast(model)
    return docs.mapInArrow(partial(_clean_rows, shared, text_col, limit), docs.schema)
