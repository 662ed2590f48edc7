"""Benchmark passages in documents, found by spaced seeds and verified around every hit."""

from pyspark.sql import functions as F

from answerloom.session import cut_lineage

#: Positions that count within a window; the others may hold any word.
MASKS = ("111011", "1101011", "110010101")
SHORTEST = min(map(len, MASKS))
#: Least score of a leak: half the item's words, within these limits.
LEAST, ENOUGH = 8, 13
#: Benchmark seeds that are broadcast at most (24 bytes each); more are joined by a shuffle.
BROADCAST_SEEDS = 2_000_000
#: Bits of the filter that windows of documents pass before that join (8 MB), at most.
FILTER_BITS = 1 << 26
#: Texts and their places that are broadcast at most; more are joined by a shuffle.
BROADCAST_PLACES = 1_000_000


def _hashed_words(text):
    """64-bit hashes of the lower-cased words (runs of letters and digits)."""
    words = F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _windows(df):
    """A row per place and mask: ``p`` (from 0) and the ``seed`` of the counted words there."""
    at = df.where(F.size("h") >= SHORTEST).withColumn(
        "p", F.explode(F.sequence(F.lit(0), F.size("h") - SHORTEST)))
    seeds = F.array(*[
        F.when(F.col("p") + len(mask) <= F.size("h"), F.xxhash64(
            F.lit(no), *[F.get("h", F.col("p") + i) for i, c in enumerate(mask) if c == "1"]))
        for no, mask in enumerate(MASKS)
    ])
    return at.withColumn("seed", F.explode(seeds)).where("seed IS NOT NULL")


def _may_be_in(seeds, n):
    """A condition on ``seed``: true for all of ``n`` seeds and for few others (1 in 250, up to 2 million seeds).

    Two bits of each seed are set in one array of longs; beyond ``FILTER_BITS`` the share of others grows.
    """
    bits = min(FILTER_BITS, max(1 << 12, 1 << (32 * n).bit_length()))

    def places(seed):
        return [part.bitwiseAND(F.lit(bits - 1)) for part in (seed, F.shiftrightunsigned(seed, 32))]

    def word(place):
        return F.shiftright(place, 6)

    def bit(place):
        return place.bitwiseAND(F.lit(63)).cast("int")

    masks = seeds.select(F.explode(F.array(*places(F.col("seed")))).alias("place")).groupBy(word(F.col("place")).alias("id")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit(F.col("place")))).alias("mask"))
    words = seeds.sparkSession.range(bits // 64).join(masks, "id", "left").agg(
        F.array_sort(F.collect_list(F.struct("id", F.coalesce("mask", F.lit(0)).alias("mask")))).alias("w"))
    held = words.select(F.col("w.mask")).scalar()
    first, second = [F.getbit(F.get(held, word(p).cast("int")), bit(p)) == 1 for p in places(F.col("seed"))]
    return first & second


def leaks(docs, benchmark, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text"):
    """Benchmark items that documents hold: one row per document row and item.

    Columns: ``id_col, text_key, item_id, score, matched, item_words, at`` with the word
    position ``at`` where the item's first word lies (or would lie). Words are
    compared lower-cased without punctuation. Windows of up to nine words are hashed under three
    spaced masks; windows of documents and items with equal seeds give a
    diagonal, along which all of the item's words are compared. The score is
    that of the best stretch, +1 for an equal and -1 for another word, so single
    substitutions do not end it. A leak scores at least half the item's words, at least 8
    and never more than 13. Items of fewer than eight words are not searched for.

    JVM expressions only. Documents are read twice: first for the places where items may lie, which are saved,
    then, only texts with such places, to compare the words there. Between the two travel texts' hashes and
    places, no words. Seeds pass a filter of bounded size, then are looked up in
    the broadcast benchmark, whose size is checked first; a larger benchmark is
    joined by a shuffle of the bare seeds that passed. NULL and empty texts leak nothing;
    rows with NULL or repeated ids are searched like any other; repeated items
    count once; other columns are ignored. ``text_key`` is a hash of the text.
    """
    items = (
        benchmark.select(F.col(item_col).cast("long").alias("item"), _hashed_words(F.col(item_text_col).cast("string")).alias("g"))
        .where(F.size("g") >= LEAST).distinct()
    )
    seeds = _windows(items.withColumnRenamed("g", "h")).select("seed", "item", F.col("p").alias("q")).distinct()
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn(
        "text_key", F.xxhash64("text"))
    total = (items.agg(F.sum(F.size("g")).alias("n")).first()["n"] or 0) * len(MASKS)
    windows = _windows(texts.select("text_key", _hashed_words(F.col("text")).alias("h"))).where(_may_be_in(seeds, total))
    small = total <= BROADCAST_SEEDS
    hits = windows.select("text_key", "p", "seed").join(F.broadcast(seeds) if small else seeds, "seed")
    # Most hits of an item lie on one diagonal, which is compared once.
    places = hits.select("text_key", "item", (F.col("p") - F.col("q")).alias("at")).distinct()
    places = places.groupBy("text_key", "item").agg(F.collect_list("at").alias("ats"))
    longest = items.groupBy("item").agg(F.max(F.size("g")).alias("n"))
    places = cut_lineage(places.join(F.broadcast(longest) if small else longest, "item"), "leak-places")
    keys = places.select("text_key").distinct()
    if places.count() <= BROADCAST_PLACES:
        places, keys = F.broadcast(places), F.broadcast(keys)
    rows = texts.join(keys, "text_key", "left_semi").select("id", "text_key", _hashed_words(F.col("text")).alias("h"))
    # Only the stretch that the item can lie on goes further than this row.
    first = F.greatest(F.col("at"), F.lit(0))
    after = F.least(F.col("at"), F.lit(0))
    stretch = rows.join(places, "text_key").withColumn("at", F.explode("ats")).select(
        "id", "text_key", "item", "at", F.slice("h", first + 1, F.col("n") + after).alias("own"))
    stretch = stretch.join(F.broadcast(items) if small else items, "item").withColumn(
        "own", F.slice("own", 1, F.greatest(F.size("g") + after, F.lit(0))))
    skipped = F.greatest(-F.col("at"), F.lit(0))
    equal = F.zip_with("own", F.slice("g", skipped + 1, F.size("own")), lambda x, y: F.when(x == y, 1).otherwise(-1))
    start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(acc, x):
        run = F.greatest(acc.run + x, F.lit(0))
        return F.struct(run.alias("run"), F.greatest(acc.best, run).alias("best"))

    scored = stretch.withColumn("equal", equal).select(
        "id", "text_key", "item", "at", F.size("g").alias("item_words"),
        F.aggregate("equal", start, step, lambda acc: acc.best).alias("score"),
        F.size(F.filter("equal", lambda x: x > 0)).alias("matched"))
    need = F.greatest(F.lit(LEAST), F.least(F.lit(ENOUGH), F.ceil(F.col("item_words") / 2)))
    best = scored.where(F.col("score") >= need).groupBy("id", "text_key", "item", "item_words").agg(
        F.max(F.struct("score", "matched", (-F.col("at")).alias("back"))).alias("x"))
    return best.select(
        F.col("id").alias(id_col), "text_key", F.col("item").alias("item_id"), F.col("x.score").alias("score"),
        F.col("x.matched").alias("matched"), "item_words", (-F.col("x.back")).alias("at"))


def drop_leaks(docs, benchmark, text_col="text", **columns):
    """``docs`` without the rows whose text holds a benchmark item; all columns as they are.

    Rows meet the leaking texts by a hash of the text; NULL texts always stay.
    """
    gone = leaks(docs.select(F.lit(0).alias("__row"), text_col), benchmark, "__row", text_col, **columns).select(
        F.col("text_key").alias("__gone")).distinct()
    gone = cut_lineage(gone, "leaking-texts")
    if gone.count() <= BROADCAST_PLACES:
        gone = F.broadcast(gone)  # else every text is shuffled and sorted
    return docs.join(gone, F.xxhash64(F.col(text_col).cast("string")) == F.col("__gone"), "left_anti")
