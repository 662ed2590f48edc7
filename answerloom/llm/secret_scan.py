"""Secrets in texts: fixed patterns, and strings that pass a battery of randomness tests."""

import math

from pyspark.sql import Window, functions as F

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Kind, pattern, group whose length counts, least length of it.
BASE = [("assign", ASSIGN, 1, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24)]
#: The same strings for kinds without a group of their own, found without a try at every short run.
FAST = {"access": "AKIA[A-Z0-9]{16,}+", "hex": "(?<![0-9a-f])[0-9a-f]{24,}+"}
CANDIDATE = "(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+={0,2}"
DECOY = "^[A-Za-z]?[a-z]+$"

SYMBOLS = {
    "hex": "0123456789abcdef", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_",
}
SPAN = "struct<start:bigint,kind_no:int,stop:bigint>"
LEVELS, NOT_REJECTED, RATE = 80, 22, 0.01
#: Lengths of the bins, and what made decoys are put together from.
BINS = ((16, 19), (20, 23), (24, 31), (32, 47), (48, 64))
PIECES = (
    "the and ing ion ent her for that int ere tion ver all ter ment ness able less ful over under out back work hand "
    "light house name value time line file user data list table index string number key map test run set get new old "
    "er en ein sch ich und der die das keit heit ung lich ver be ge auf aus mit nach vor zeit haus wort teil stand "
    "le la les que ou en re de ment ence eau eur ette aire oir on ez ant par pour sur entre contre"
).split()
#: Of 20,000 made decoys per bin, how many score at the levels 0, 1, .. LEVELS (``made_decoys`` makes them again).
MADE = {
    16: [1, 4, 11, 23, 67, 108, 154, 193, 227, 277, 332, 364, 373, 401, 427, 454, 460, 465, 388, 455, 396, 457, 426, 400, 354, 384, 457,
         407, 404, 380, 295, 295, 333, 358, 344, 265, 277, 282, 291, 263, 226, 240, 202, 207, 203, 233, 233, 256, 192, 144, 123, 127, 134, 137,
         177, 196, 200, 161, 107, 80, 57, 55, 73, 117, 187, 182, 158, 128, 99, 293, 524, 511, 430, 306, 278, 196, 166, 119, 89, 70, 132],
    20: [0, 0, 1, 6, 5, 11, 17, 47, 54, 69, 76, 112, 133, 156, 164, 189, 187, 213, 246, 233, 261, 206, 323, 324, 317, 297, 281,
         294, 298, 354, 338, 320, 306, 260, 284, 278, 339, 316, 300, 225, 211, 231, 310, 349, 326, 216, 174, 154, 223, 243, 324, 290, 237, 165,
         123, 118, 220, 305, 308, 223, 164, 150, 94, 61, 157, 256, 224, 206, 149, 549, 951, 970, 810, 643, 487, 357, 301, 245, 194, 137, 305],
    24: [0, 0, 0, 0, 0, 0, 1, 3, 4, 6, 6, 9, 13, 20, 17, 34, 33, 29, 41, 56, 59, 59, 66, 86, 84, 99, 101,
         101, 114, 131, 116, 129, 134, 161, 156, 145, 160, 151, 124, 155, 197, 226, 162, 130, 148, 268, 240, 166, 173, 115, 207, 255, 296, 185,
         146, 138, 172, 243, 240, 210, 155, 135, 160, 197, 230, 188, 182, 162, 166, 1006, 1909, 1877, 1588, 1258, 1045, 808, 598, 458, 341, 289, 728],
    32: [0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1, 1, 0, 1, 1, 0, 1, 1, 1,
         3, 3, 2, 5, 5, 8, 9, 7, 5, 10, 17, 10, 9, 8, 13, 19, 15, 19, 25, 22, 25, 22, 21, 39, 26, 27, 29,
         43, 44, 32, 29, 42, 39, 70, 41, 54, 46, 45, 56, 54, 54, 56, 1227, 2702, 3022, 2651, 2035, 1684, 1348, 1033, 808, 583, 454, 1338],
    48: [0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0,
         0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0,
         0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1020, 2393, 2847, 2530, 2297, 1922, 1497, 1202, 940, 773, 603, 1976],
}


def _let(value, body):
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def _by_blocks(items, measure, combine, walk, size=256):
    """``walk(block, base)`` of blocks of an array, joined; ``base`` combines the ``measure`` of all blocks before.

    A fold copies what it has gathered at every step, so one fold over a long array
    costs its square; folds over blocks of a fixed size do not.
    """
    def whole(xs):
        last = F.greatest(F.floor((F.size(xs) - 1) / size), F.lit(0)).cast("int")
        return _let(F.transform(
            F.sequence(F.lit(0), last), lambda i: F.slice(xs, i * size + 1, F.lit(size))), joined)

    def joined(blocks):
        start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("bases"))
        bases = F.aggregate(F.transform(blocks, measure), start, lambda acc, m: F.struct(
            combine(acc.at, m).alias("at"), F.concat(acc.bases, F.array(acc.at)).alias("bases")), lambda acc: acc.bases)
        return F.flatten(F.zip_with(blocks, bases, walk))

    return _let(items, whole)


def _positions(text, pattern, group, least, kind_no):
    """Spans (start, kind_no, stop) in characters of the leftmost matches of ``pattern``.

    Matches follow each other, so a match starts after the pieces and matches
    before it. A match whose ``group`` has fewer than ``least`` characters is left out.
    """
    lengths = lambda a: F.transform(a, lambda x: F.char_length(x).cast("long"))
    whole = lengths(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    sized = lengths(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)))
    gaps = lengths(F.split(text, pattern, -1))
    steps = F.zip_with(
        F.zip_with(gaps, whole, lambda g, m: F.struct(g.alias("g"), F.coalesce(m, F.lit(0).cast("long")).alias("m"))), sized,
        lambda x, s: F.struct(x.g.alias("g"), x.m.alias("m"), s.alias("s")))

    def step(acc, x):
        begin = acc.at + x.g
        end = begin + x.m
        one = F.array(F.struct(begin.alias("start"), F.lit(kind_no).alias("kind_no"), end.alias("stop")))
        return F.struct(
            end.alias("at"), F.when(x.s >= least, F.concat(acc.spans, one)).otherwise(acc.spans).alias("spans"))

    def walk(block, base):
        start = F.struct(base.alias("at"), F.array().cast(f"array<{SPAN}>").alias("spans"))
        return F.aggregate(block, start, step, lambda acc: acc.spans)

    long = lambda block: F.aggregate(block, F.lit(0).cast("long"), lambda n, x: n + x.g + x.m)
    spans = _by_blocks(steps, long, lambda a, b: a + b, walk)
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(f"array<{SPAN}>"))


def _last_stop(block):
    return F.aggregate(block, F.lit(0).cast("long"), lambda n, s: F.greatest(n, s.stop))


def _tail(z):
    """P(N(0, 1) > z) for z >= 0, by the Abramowitz-Stegun polynomial; at least 1e-15."""
    t = 1 / (1 + 0.2316419 * z)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.greatest(F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * poly, F.lit(1e-15))


def battery(token):
    """Evidence against randomness of a string: about chi-squared with 6 degrees if it is random.

    The encoding is inferred (hex, base32, else base64); three tests on the
    symbols' numbers v_1..v_n in its alphabet of size A are combined by
    Fisher's rule: chi-squared uniformity over the alphabet, the number of runs above and
    below the alphabet's middle, and the serial correlation of neighbours.
    """
    core = F.regexp_replace(token, "=+$", "")
    kind = F.when(core.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), 0).when(core.rlike("^[A-Z2-7]+$"), 1).otherwise(2)

    def with_kind(k):
        symbols, size = (F.when(k == 0, F.lit(SYMBOLS["hex"])).when(k == 1, F.lit(SYMBOLS["base32"])).otherwise(F.lit(SYMBOLS["base64"])),
                         F.when(k == 0, F.lit(16.0)).when(k == 1, F.lit(32.0)).otherwise(F.lit(64.0)))
        shown = F.when(k == 0, F.lower(core)).otherwise(core)
        values = F.transform(F.split(shown, ""), lambda c: F.least(F.instr(symbols, c).cast("double"), size))
        return _let(F.filter(values, lambda x: x > 0), lambda v: _fisher(v, size))

    return _let(kind, with_kind)


def _fisher(v, a):
    """The combined score of the numbers ``v`` over an alphabet of size ``a``."""
    n = F.size(v).cast("double")
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda s, x: s + x)
    follow = lambda f: total(F.zip_with(F.slice(v, 1, F.size(v) - 1), F.slice(v, 2, F.size(v) - 1), f))
    counts = F.transform(F.array_distinct(v), lambda x: F.size(F.filter(v, lambda y: y == x)).cast("double"))
    uniform = (total(F.transform(counts, lambda c: c * c)) * a / n - n - (a - 1)) / F.sqrt(2 * (a - 1) * (1 - 1 / n))
    p_uniform = _let(uniform, lambda z: F.when(z >= 0, _tail(z)).otherwise(1 - _tail(-z)))

    def p_runs(above):
        changes = follow(lambda x, y: F.when((x > a / 2) != (y > a / 2), 1.0).otherwise(0.0))
        pairs = 2 * above * (n - above)
        spread = F.greatest(pairs * (pairs - n) / (n * n * (n - 1)), F.lit(1e-9))
        # All on one side of the middle: as likely as that many equal tosses of a coin.
        return F.when((above == 0) | (above == n), F.greatest(F.pow(F.lit(2.0), 1 - n), F.lit(1e-15))).otherwise(
            two((changes - pairs / n) / F.sqrt(spread)))

    def p_serial(mean):
        spread = total(F.transform(v, lambda x: (x - mean) * (x - mean)))
        both = follow(lambda x, y: (x - mean) * (y - mean))
        return two(_let(spread, lambda s: F.when(s > 0, both / s * F.sqrt(n) + 1 / F.sqrt(n)).otherwise(F.sqrt(n))))

    two = lambda z: _let(F.abs(z), lambda x: F.least(2 * _tail(x), F.lit(1.0)))
    above = F.size(F.filter(v, lambda x: x > a / 2)).cast("double")
    return -2 * (F.log(p_uniform) + F.log(_let(above, p_runs)) + F.log(_let(total(v) / n, p_serial)))


def _length_bin(token):
    n = F.char_length(token)
    return F.when(n < 20, 16).when(n < 24, 20).when(n < 32, 24).when(n < 48, 32).otherwise(48)


def made_decoys(spark, n):
    """``n`` plain words per length bin, put together from ``PIECES`` by a hash: columns ``bin`` and ``token``."""
    bins = F.explode(F.array(*[F.struct(F.lit(low).alias("bin"), F.lit(high).alias("high")) for low, high in BINS]))
    pieces = F.array(*map(F.lit, PIECES))
    rows = spark.range(n).select("id", bins.alias("b")).select("id", "b.*")
    draw = lambda i, size: F.pmod(F.xxhash64("id", "bin", i), F.lit(size)).cast("int")
    word = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.get(pieces, draw(i, len(PIECES)))), "")
    return rows.select("bin", F.substring(
        word, F.lit(1), F.col("bin") + F.pmod(F.xxhash64("id", "bin", F.lit(0)), F.col("high") - F.col("bin") + 1).cast("int")).alias("token"))


def thresholds(docs, text_col="text", rate=RATE):
    """Per length bin the highest battery score at which at most ``rate`` of the finds are false.

    All candidate strings of the corpus are scored. Plain words are decoys: they
    are no secrets. Made ones (``MADE``) join those of the corpus in every bin, so a bin with
    few or none has a control too. With N0 the candidates that are no secrets (estimated from those as
    unlike randomness as most decoys are), the false share at a score s is
    N0 * (decoys up to s + 1) / (decoys + 1) / (candidates up to s). A score
    the battery would reject as random at 0.1 % is never taken. The result
    has at most five rows, whatever the corpus.
    """
    tokens = docs.select(F.explode(F.regexp_extract_all(
        F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(CANDIDATE), F.lit(0))).alias("token"))
    scored = tokens.select(
        F.col("token").rlike(DECOY).alias("decoy"), _length_bin(F.col("token")).alias("bin"),
        F.least(F.floor(battery(F.col("token"))), F.lit(LEVELS)).alias("level"))
    counts = scored.groupBy("bin", "level").agg(
        F.count_if(F.col("decoy")).alias("decoys"), F.count_if(~F.col("decoy")).alias("others"))
    made = docs.sparkSession.sql("SELECT * FROM VALUES " + ", ".join(
        f"({low}, {level}L, {n}L, 0L)" for low, found in MADE.items() for level, n in enumerate(found) if n))
    counts = counts.union(made).groupBy("bin", "level").agg(F.sum("decoys").alias("decoys"), F.sum("others").alias("others"))
    per_bin = Window.partitionBy("bin")
    upto = per_bin.orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    # Decoys above the middle score of decoys, and the candidates up there, give N0.
    counts = counts.withColumns({
        "d": F.sum("decoys").over(upto), "t": F.sum("others").over(upto),
        "all_d": F.sum("decoys").over(per_bin), "all_t": F.sum("others").over(per_bin)})
    middle = F.max(F.when(2 * F.col("d") <= F.col("all_d"), F.col("level"))).over(per_bin)
    counts = counts.withColumn("middle", F.greatest(F.coalesce(middle, F.lit(0)), F.lit(NOT_REJECTED)))
    high = F.col("level") > F.col("middle")
    counts = counts.withColumns({
        "high_d": F.sum(F.when(high, F.col("decoys")).otherwise(0)).over(per_bin),
        "high_t": F.sum(F.when(high, F.col("others")).otherwise(0)).over(per_bin)})
    no_secrets = F.least(F.col("high_t") * (F.col("all_d") + 1) / (F.col("high_d") + 1), F.col("all_t"))
    false = no_secrets * (F.col("d") + 1) / (F.col("all_d") + 1) / F.greatest(F.col("t"), F.lit(1))
    return (
        counts.where((F.col("level") <= NOT_REJECTED) & (F.col("t") > 0) & (false <= rate))
        .groupBy("bin").agg(F.max("level").alias("limit"))
    )


def secret_spans(docs, text_col="text", rate=RATE):
    """``docs`` with a column ``secret_spans``: spans (start, kind_no, stop), by start, then kind.

    Kinds 0 to 2 are the fixed patterns of ``BASE``; kind 3 are strings of 16
    or more characters that the battery takes for random within the
    false-discovery limit of their length and that no fixed span covers. Positions are
    characters, the stop is exclusive. NULL and empty texts have no spans.
    Repeated rows and rows without an id are scanned like any other; a column
    that is already called ``secret_spans`` is replaced.

    JVM expressions only, without a shuffle of texts: one aggregate of the
    corpus gives the limits (at most five rows), then texts are scanned in place.
    """
    limits = {r["bin"]: r["limit"] for r in thresholds(docs, text_col, rate).collect()}
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    none = F.array().cast(f"array<{SPAN}>")
    names = [f"__span_{kind}" for kind, *_ in BASE]
    marked = docs.withColumns({
        name: _positions(text, FAST.get(kind, pattern), group, least, no)
        for no, (name, (kind, pattern, group, least)) in enumerate(zip(names, BASE))
    }).withColumn("__span_base", F.concat(*names))
    found = none
    if limits:
        likely = lambda token: _let(token, lambda x: F.floor(battery(x)) <= _limit(x, limits))
        tokens = F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))
        named = lambda s, t: F.struct(s.start.alias("start"), s.kind_no.alias("kind_no"), s.stop.alias("stop"), t.alias("token"))
        likeliest = F.filter(
            F.zip_with(_positions(text, CANDIDATE, 0, 16, 3), tokens, lambda s, t: F.when(s.isNotNull(), named(s, t))),
            lambda p: p.isNotNull() & ~p.token.rlike(DECOY))
        both = F.array_sort(F.concat(
            F.transform("__span_base", lambda s: named(s, F.lit(None).cast("string"))), likeliest))
        # In order of start, fixed spans first: a candidate is covered if a fixed span so far reaches its stop.
        fixed = lambda p: F.when(p.kind_no < 3, p.stop).otherwise(0)
        reach = lambda block: F.aggregate(block, F.lit(0).cast("long"), lambda n, p: F.greatest(n, fixed(p)))

        def walk(block, base):
            start = F.struct(base.alias("at"), none.alias("spans"))

            def step(acc, p):
                at = F.greatest(acc.at, fixed(p))
                span = F.struct(p.start.alias("start"), p.kind_no.alias("kind_no"), p.stop.alias("stop"))
                new = (p.kind_no == 3) & (at < p.stop) & F.coalesce(likely(p.token), F.lit(False))
                return F.struct(
                    at.alias("at"), F.when(new, F.concat(acc.spans, F.array(span))).otherwise(acc.spans).alias("spans"))

            return F.aggregate(block, start, step, lambda acc: acc.spans)

        found = _by_blocks(both, reach, F.greatest, walk)
        found = F.when(text.rlike(CANDIDATE), found).otherwise(none)
    return marked.withColumn("secret_spans", F.array_sort(F.concat("__span_base", found))).drop(*names, "__span_base")


def _limit(token, limits):
    bin_ = _length_bin(token)
    out = F.lit(-1)
    for n, limit in limits.items():
        out = F.when(bin_ == n, limit).otherwise(out)
    return out


def describe(spans):
    """``kind:start:stop`` of the spans, joined by commas."""
    kinds = F.array(*[F.lit(kind) for kind, *_ in BASE], F.lit("random"))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(kinds, s.kind_no), s.start.cast("string"), s.stop.cast("string"))), ",")


def redact_secrets(docs, text_col="text", mark="[SECRET]", chars_col="n_chars", rate=RATE):
    """``docs`` with every span replaced by ``mark`` (overlapping ones by one mark).

    Texts without spans, NULL texts and all other columns stay as they are;
    ``chars_col``, if there is such a column, is set anew where the text changed.
    """
    marked = secret_spans(docs, text_col, rate)
    text, spans = F.col(text_col), F.col("secret_spans")

    def walk(block, base):
        """The text from where the spans before end to where these end; positions count from there, so a long text is cut once a block."""
        stop = F.greatest(base, _last_stop(block))
        here = F.substring(text, (base + 1).cast("int"), (stop - base).cast("int"))

        def parts(piece):
            start = F.struct(base.alias("at"), F.array().cast("array<string>").alias("parts"))

            def step(acc, s):
                fresh = F.concat(acc.parts, F.array(
                    F.substring(piece, (acc.at - base + 1).cast("int"), (s.start - acc.at).cast("int")), F.lit(mark)))
                return F.struct(
                    F.greatest(acc.at, s.stop).alias("at"), F.when(s.start >= acc.at, fresh).otherwise(acc.parts).alias("parts"))

            return F.aggregate(block, start, step, lambda acc: acc.parts)

        return _let(here, parts)

    end = _last_stop(spans)
    clean = F.concat(
        F.array_join(_by_blocks(spans, _last_stop, F.greatest, walk), ""),
        F.substring(text, (end + 1).cast("int"), F.char_length(text)))
    hit = F.size("secret_spans") > 0
    marked = marked.withColumn("__clean", F.when(hit, clean))
    changed = {text_col: F.coalesce("__clean", text_col)}
    if chars_col in docs.columns:
        kind = docs.schema[chars_col].dataType
        changed[chars_col] = F.when(hit, F.char_length("__clean").cast(kind)).otherwise(F.col(chars_col))
    return marked.withColumns(changed).select(*docs.columns)
