"""Phrases whose words stand together more often than chance, counted by multikey quicksort of suffixes."""

from functools import partial

import numpy as np
from pyspark.sql import Window, functions as F

from answerloom.llm.textscan import R, gather, mix, pieces, span_hashes, text_bytes
from answerloom.session import cut_lineage, ship_package

LONGEST = 3
END = -1  # the key behind a piece's last word
FAN = 256  # buckets a routing step deals to
BUCKET_ROWS = 1_000_000  # larger buckets are routed again

_BREAK = np.zeros(256, bool)  # ends a piece
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_CUT = _BREAK.copy()  # ends a word
_CUT[[0x20, 0x09]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32


def equal_partitions(keys, weights, floors, leaves=False):
    """Multikey three-way quicksort of pointers to the rows of ``keys``, all open partitions at once.

    A partition is split by its middle pointer's key at its depth into less,
    equal and greater; the equal part goes one key deeper, up to the last key or
    an END. Returns ``(pointer, depth, weight)`` arrays: for every equal part
    one of its pointers, how many keys its rows share, and their total weight (None: a row is 1). Parts
    whose weight is below ``floors[depth]`` are abandoned. With ``leaves`` only parts that
    share all their keys are returned.
    """
    n, deepest = keys.shape
    floors, columns = np.asarray(floors), [np.ascontiguousarray(k) for k in keys.T.astype(np.int32)]
    # Open partitions of each depth; they stand one after the other, with their sizes.
    waiting = [[] for _ in range(deepest + 1)]
    if n:
        waiting[0].append((np.arange(n, dtype=np.int32), np.array([n])))
    found = [(np.zeros(0, np.int64),) * 3]
    for depth in range(deepest):
        while waiting[depth]:
            pointer, size = (np.concatenate(x) for x in zip(*waiting[depth]))
            waiting[depth] = []
            begin = np.cumsum(size) - size
            key = columns[depth][pointer]
            pivot = key[begin + size // 2]
            middle = np.repeat(pivot, size)
            less, equal = key < middle, key == middle
            n_less, n_equal = (np.add.reduceat(m, begin, dtype=np.int64) for m in (less, equal))
            masks, counts = (less, equal, ~(less | equal)), (n_less, n_equal, size - n_less - n_equal)
            if weights is None:
                totals = counts
            else:
                weight = weights[pointer]
                totals = [np.add.reduceat(np.where(m, weight, 0), begin) for m in masks]
            parts = [pointer[m] for m in masks]

            whole = (pivot == END) | (depth + 1 == deepest)
            done = whole | (n_equal == 1) if leaves else whole
            report = (done if leaves else pivot != END) & (totals[1] >= floors[depth + 1])
            first = parts[1][np.cumsum(n_equal) - n_equal]
            found.append((first[report].astype(np.int64), np.full(report.sum(), depth + 1), totals[1][report]))
            kept = [(c > 0) & (t >= floors[depth + 1]) for c, t in zip(counts, totals)]
            kept[1] = ~done & (totals[1] >= floors[min(depth + 2, deepest)])
            for side, deep in ((0, depth), (2, depth), (1, depth + 1)):
                if kept[side].any():
                    waiting[deep].append((parts[side][np.repeat(kept[side], counts[side])], counts[side][kept[side]]))
    return tuple(np.concatenate(c) for c in zip(*found))


def _words(data, offsets):
    """Word codes, their dictionary, rows, and whether the next word stands in the same piece."""
    import pyarrow as pa

    data = _LOWER[data]
    inside = ~_CUT[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets[:-1]] = True
    start, stop = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1] | first[1:-1]
    stop[:-1] &= ~inside[1:] | first[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(stop) + 1
    bounds = np.concatenate(([0], np.cumsum(ends - starts)))
    words = pa.Array.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data[inside])])
    coded = words.dictionary_encode()
    row = np.searchsorted(offsets, starts, "right") - 1
    piece = np.cumsum(_BREAK[data])[starts]
    joined = np.zeros(len(starts), bool)
    joined[:-1] = (row[1:] == row[:-1]) & (piece[1:] == piece[:-1])
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary, row, joined


def _text_blocks(batch, size):
    """``(data, offsets, first row, open)`` of pieces of a batch; a long text comes in overlapping blocks.

    A block that leaves its text ``open`` ends with two words that begin the next one.
    """
    row = 0
    for part in pieces(batch, size=size):
        data, offsets = text_bytes(part.column(1))
        if len(data) <= 2 * size:
            yield data, offsets, row, False
        else:
            at, tail = 0, np.zeros(0, np.uint8)
            while at < len(data):
                end = min(at + size, len(data))
                while end < len(data) and not _CUT[data[end]]:
                    ahead = np.flatnonzero(_CUT[data[end:end + 65_536]])
                    end = min(end + (int(ahead[0]) if len(ahead) else 65_536), len(data))
                block = np.concatenate((tail, data[at:end]))
                yield block, np.array([0, len(block)]), row, end < len(data)
                inside = ~_CUT[block]
                starts = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
                tail = block[starts[-2:][0]:] if len(starts) else block[:0]
                at = end
        row += part.num_rows


def _phrases(dictionary, columns):
    """Blank-joined words of code columns, as bytes; END codes are left out."""
    import pyarrow as pa
    import pyarrow.compute as pc

    words = [dictionary.take(pa.array(c, mask=c == END)) for c in columns]
    return pc.binary_join_element_wise(*words, pa.scalar(b" ", dictionary.type), null_handling="skip")


def _word_hashes(dictionary):
    """A hash of every word and, last, one for END."""
    bounds = np.frombuffer(dictionary.buffers()[1], np.int64)[dictionary.offset:dictionary.offset + len(dictionary) + 1]
    out = np.full(len(dictionary) + 1, 0x9E37, np.uint64)
    if len(dictionary):
        out[:-1] = span_hashes(np.frombuffer(dictionary.buffers()[2], np.uint8), bounds[:-1], bounds[1:])
    return out


def _buckets(words, hashes, level, spread):
    """Where suffixes go at a routing level: by their first two words or, spread, by all."""
    out = np.full(len(words), level + 1, np.uint64)
    for k in range(LONGEST if spread else 2):
        out = mix(out * R ^ hashes[words[:, k]])
    return (out % np.uint64(FAN)).astype(np.int64)


# ---- payloads: many suffixes with their counts in one compressed cell -------------------------

def _pack(texts, counts, cuts):
    """A payload for each range of ``cuts`` of a binary array: sizes, counts and texts."""
    import pyarrow as pa

    codec = pa.Codec("zstd", compression_level=1)
    texts = texts.cast(pa.large_binary())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = memoryview(texts.buffers()[2]) if len(texts) else b""
    sizes, counts = np.diff(bounds).astype("<u4"), counts.astype("<u8")
    for a, b in zip(cuts, cuts[1:]):
        raw = b"".join((sizes[a:b].tobytes(), counts[a:b].tobytes(), data[bounds[a]:bounds[b]]))
        yield np.array([b - a, len(raw)], "<u8").tobytes() + codec.compress(raw, asbytes=True)


def _unpack(payload):
    import pyarrow as pa

    n, size = np.frombuffer(payload, "<u8", 2).tolist()
    raw = pa.Codec("zstd").decompress(memoryview(payload)[16:], size, asbytes=True)
    bounds = np.concatenate(([0], np.cumsum(np.frombuffer(raw, "<u4", n), dtype=np.int64)))
    texts = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(bounds), pa.py_buffer(raw[12 * n:])])
    return texts, np.frombuffer(raw, "<u8", n, 4 * n).astype(np.int64)


def _keys_of(payloads):
    """Word codes (a row per suffix), the dictionary and the counts of some payloads."""
    import pyarrow as pa
    import pyarrow.compute as pc

    parts = [_unpack(p) for p in payloads]
    split = pc.split_pattern(pa.concat_arrays([t for t, _ in parts]), b" ")
    coded = split.flatten().cast(pa.large_binary()).dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    bounds = split.offsets.to_numpy() - split.offsets[0].as_py()
    keys = np.full((len(split), LONGEST), END)
    for k in range(LONGEST):
        has = bounds[:-1] + k < bounds[1:]
        keys[has, k] = codes[(bounds[:-1] + k)[has]]
    return keys, coded.dictionary, np.concatenate([c for _, c in parts])


def _routed(langs, lang, keys, dictionary, counts, level, spread, above=0):
    """Rows ``(lang, bucket, spread, n_rows, n, payload)`` of distinct suffixes, a row per language and bucket."""
    import pyarrow as pa

    group = lang * FAN + _buckets(keys, _word_hashes(dictionary), level, spread)
    low = (1 << 21) - 1  # equal heads stand together, which compresses well
    order = np.argsort(group << 42 | (keys[:, 0] & low) << 21 | (keys[:, 1] + 1 & low))
    group, keys, counts = group[order], keys[order], counts[order]
    cuts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True]))) if len(group) else np.zeros(1, int)
    texts = _phrases(dictionary, keys.T)
    first = group[cuts[:-1]]
    return pa.RecordBatch.from_arrays([
        langs.take(pa.array(first // FAN)), pa.array(above * FAN + first % FAN), pa.array(np.full(len(first), spread)),
        pa.array(np.diff(cuts)), pa.array(np.add.reduceat(counts, cuts[:-1]) if len(first) else counts),
        pa.array(_pack(texts, counts, cuts.tolist()), pa.binary())], ["lang", "bucket", "spread", "n_rows", "n", "payload"])


_ROUTED = "lang string, bucket long, spread boolean, n_rows long, n long, payload binary"


def _suffixes(size, batches):
    """Distinct suffixes (up to three words) of each block of text with their counts, dealt to buckets."""
    for batch in batches:
        langs = batch.column(0).dictionary_encode()
        lang_of = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        for data, offsets, row, unfinished in _text_blocks(batch, size):
            codes, dictionary, rows, joined = _words(data, offsets)
            n = len(codes)
            keys = np.full((n + 2, LONGEST), END)
            keys[:n, 0] = codes
            linked = np.ones(n, bool)
            for k in range(1, LONGEST):
                linked = linked & np.append(joined, np.zeros(k, bool))[k - 1:n + k - 1]
                keys[:n, k][linked] = keys[k:n + k, 0][linked]
            # Language and first word are one key.
            keys[:n, 0] += lang_of[row + rows] * len(dictionary)
            keys = keys[:max(n - 2, 0) if unfinished else n]
            pointer, _, count = equal_partitions(keys, None, [0] * (1 + LONGEST), leaves=True)
            found = keys[pointer]
            lang, found[:, 0] = np.divmod(found[:, 0], max(len(dictionary), 1))
            yield _routed(langs.dictionary, lang, found, dictionary, count, 0, False)


def _runs(batches, most):
    """Lists of payloads that follow each other in one bucket: ``(lang, bucket, spread, payloads, last)``.

    A list has about ``most`` suffixes at the most; ``last`` closes its bucket.
    """
    held, key, n = [], None, 0
    for batch in batches:
        columns = [batch.column(i) for i in range(batch.num_columns)]
        for lang, bucket, spread, n_rows, payload in zip(*(c.to_pylist() for c in columns)):
            if held and (lang, bucket, spread) != key:
                yield *key, held, True
                held, n = [], 0
            elif held and n + n_rows > most:
                yield *key, held, False
                held, n = [], 0
            key = (lang, bucket, spread)
            held.append(payload)
            n += n_rows
    if held:
        yield *key, held, True


def _reroute(level, spread, most, batches):
    """The suffixes of large buckets, equal ones joined, one routing level further."""
    import pyarrow as pa

    for lang, bucket, _, payloads, _ in _runs(batches, most):
        keys, dictionary, counts = _keys_of(payloads)
        pointer, _, total = equal_partitions(keys, counts, [0] * (1 + LONGEST), leaves=True)
        yield _routed(pa.array([lang]), np.zeros(len(pointer), np.int64), keys[pointer], dictionary, total,
                      level, spread, above=bucket)


def _count(least, most, batches):
    """Phrase counts, bucket after bucket; infrequent partitions whose rows are all here are abandoned."""
    import pyarrow as pa

    joined = []
    for lang, _, spread, payloads, last in _runs(batches, most):
        keys, dictionary, counts = _keys_of(joined + payloads)
        if not last:
            # A bucket that is too large for one look: equal suffixes are joined before more are read.
            pointer, _, total = equal_partitions(keys, counts, [0] * (1 + LONGEST), leaves=True)
            joined = list(_pack(_phrases(dictionary, keys[pointer].T), total, [0, len(pointer)]))
            continue
        joined = []
        # A first word's suffixes are in many buckets; its first two words' only if they are spread.
        pointer, words, weight = equal_partitions(keys, counts, [0, 0, 0 if spread else least, least])
        columns = [np.where(words > k, keys[pointer, k], END) for k in range(LONGEST)]
        phrases = _phrases(dictionary, columns).cast(pa.binary()).view(pa.string())
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(words), pa.string()), phrases, pa.array(words), pa.array(weight)],
            ["lang", "phrase", "words", "f"])


def suffix_counts(docs, lang_col="lang", text_col="text", block=4_000_000):
    """Suffixes of all texts, written: ``lang, bucket, spread, n_rows, n, payload``.

    Texts are lower-cased (A-Z), split into pieces at ``.,;:!?`` and line ends and
    into words at blanks and tabs; a suffix is a run of up to three words and ends with its piece. Equal suffixes
    of a block of about ``block`` bytes are counted before anything is shuffled, and those of one
    language and bucket (by a hash of their first two words) travel in one compressed cell.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return cut_lineage(rows.mapInArrow(partial(_suffixes, block), _ROUTED), "suffixes")


def _ordered(table):
    parts = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = table.repartition(parts, "lang", "bucket", "spread").sortWithinPartitions("lang", "bucket", "spread")
    return rows.select("lang", "bucket", "spread", "n_rows", "payload")


def routed_again(suffixes, most=BUCKET_ROWS, levels=6):
    """Buckets of more than ``most`` suffixes dealt to smaller ones, until there are none or ``levels`` are used up.

    The first two steps look at the first two words alone, later ones at the whole suffix, which
    splits a head that is frequent itself. Every step joins equal suffixes first, so a suffix that is found in
    many blocks does not keep its bucket large.
    """
    tables, here = [], suffixes
    for level in range(1, levels):
        sizes = here.groupBy("lang", "bucket", "spread").agg(F.sum("n_rows").alias("rows"), F.count("*").alias("cells"))
        large = cut_lineage(sizes.where((F.col("rows") > most) & (F.col("cells") > 1)).drop("rows", "cells"), "large")
        n = large.count()  # at most one in ``most`` suffixes
        if not n:
            break
        large = F.broadcast(large) if n <= 100_000 else large
        keys = ["lang", "bucket", "spread"]
        tables.append(here.join(large, keys, "left_anti"))
        # Cells are dealt at random, not by bucket: a large one is many tasks' work.
        dealt = here.join(large, keys, "left_semi").select("lang", "bucket", "spread", "n_rows", "payload")
        here = cut_lineage(
            dealt.sortWithinPartitions("lang", "bucket").mapInArrow(partial(_reroute, level, level > 2, most), _ROUTED),
            "suffixes")
    tables.append(here)
    whole = tables[0]
    for table in tables[1:]:
        whole = whole.unionByName(table)
    return whole


def frequent_phrases(suffixes, least=10, most=BUCKET_ROWS):
    """``(lang, phrase, words, f)``, written: phrases of one to three words that occur ``least`` times.

    Every bucket is quicksorted on its own. What single buckets count of a first word, and
    of two first words that are spread, is added up.
    """
    dealt = _ordered(routed_again(suffixes, most))
    counted = dealt.mapInArrow(partial(_count, least, 2 * most), "lang string, phrase string, words long, f long")
    summed = counted.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    return cut_lineage(summed, "phrases")


def scored_phrases(phrases):
    """Candidates (two or three words) with their weakest cut: ``lang, phrase, words, a, k, l, r, score``.

    The score floor(1000000 * a * a / (l * r)) is computed in decimals of 38 digits.
    """
    word = F.split("phrase", " ")
    part = lambda low, n: F.array_join(F.slice(word, low, n), " ")
    cut = lambda k: F.struct(
        F.lit(k).alias("k"), part(1, k).alias("left"), F.array_join(F.slice(word, F.lit(k + 1), F.size(word) - k), " ").alias("right"))
    cuts = F.when(F.col("words") == 2, F.array(cut(1))).otherwise(F.array(cut(1), cut(2)))
    candidates = phrases.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), F.inline(cuts))
    left = phrases.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    right = phrases.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    exact = lambda c: f"CAST({c} AS DECIMAL(38, 0))"
    score = F.expr(f"({exact(1_000_000)} * {exact('a')} * {exact('a')}) div ({exact('l')} * {exact('r')})")
    return (
        candidates.join(left, ["lang", "left"]).join(right, ["lang", "right"])
        .groupBy("lang", "phrase", "words", "a")
        .agg(F.min(F.struct(score.cast("long").alias("score"), "k", "l", "r")).alias("cut"))
        .select("lang", "phrase", "words", "a", "cut.k", "cut.l", "cut.r", "cut.score")
    )


def collocations(docs, lang_col="lang", text_col="text", least=10, top=2_000, covered=50):
    """The best ``top`` phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    ``a`` counts the phrase, ``l`` and ``r`` the two parts of its weakest cut, ``n`` all words of
    the language. Phrases that stand inside a longer candidate with at least ``covered`` percent of their
    count are left out. Order: score and count descending, phrase ascending by bytes.

    NULL languages are ``und``, NULL and empty texts have no words. Repeated rows count as often as they
    occur; an empty table gives no rows. Texts of any length are read in blocks that overlap by two
    words. Other columns are ignored.
    """
    suffixes = suffix_counts(docs, lang_col, text_col)
    phrases = frequent_phrases(suffixes, least)
    words = suffixes.groupBy("lang").agg(F.sum("n").alias("n"))
    scored = scored_phrases(phrases)
    word = F.split("phrase", " ")
    inner = F.array(F.array_join(F.slice(word, 1, 2), " "), F.array_join(F.slice(word, 2, 2), " "))
    around = (
        phrases.where("words = 3").select("lang", F.explode(inner).alias("phrase"), F.col("f").alias("longer"))
        .groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    )
    kept = scored.join(around, ["lang", "phrase"], "left").where(
        f"longer IS NULL OR words = 3 OR CAST(100 AS DECIMAL(38, 0)) * longer < CAST({covered} AS DECIMAL(38, 0)) * a")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = kept.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.join(F.broadcast(words) if words.count() <= 10_000 else words, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
