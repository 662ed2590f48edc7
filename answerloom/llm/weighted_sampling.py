"""Document fingerprints by consistent weighted sampling."""

from functools import partial

import numpy as np
from pyspark.sql import functions as F

from answerloom.llm.textscan import Memo, Pool
from answerloom.session import ship_package

SAMPLES = 64


class _Samples(Memo):
    """Per (term, weight) its hash value in every sample; the smallest of a document wins.

    For a term and a sample, r and c are Gamma(2, 1) draws and b is uniform, all
    from the term's hash. A weight w gives t = floor(ln w / r + b),
    ln y = r (t - b) and the value c / (y exp(r)) (improved consistent weighted
    sampling). A weight picks the same (term, t) as a near weight does, so two
    documents share a sample's winner with the generalised Jaccard similarity
    of their weighted terms. A value depends on nothing but (term, t, sample), so the
    least value itself names the winner.
    """

    def __init__(self, samples):
        super().__init__(200_000)
        self.samples = samples
        self.clear()

    def clear(self):
        self.values = Pool(np.float32)

    def add(self, terms, weights):
        from answerloom.llm.textscan import R, mix

        steps = np.arange(1, self.samples + 3, dtype=np.uint64) * R
        seed = mix(terms[:, None] ^ steps[:self.samples])

        def uniforms(i):
            """Two uniform draws on 32 bits each."""
            draw = mix(seed + steps[i])
            return (
                ((draw >> np.uint64(32)).astype(np.float64) + 0.5) * 2.0**-32,
                ((draw & np.uint64(0xFFFFFFFF)).astype(np.float64) + 0.5) * 2.0**-32,
            )

        u, v = uniforms(0)
        r = -np.log(u * v)
        u, v = uniforms(1)
        log_c = np.log(-np.log(u * v))
        b = uniforms(2)[0]
        t = np.floor(np.log(weights)[:, None] / r + b)
        self.values.extend((log_c - r * (t - b) - r).astype(np.float32).reshape(-1))


def fingerprints(column, samples=SAMPLES):
    """16-bit sample names, one row per text: ``uint16[len(column), samples]``.

    Terms are words (runs of non-space, A-Z lower-cased) weighted by the square
    root of their count. A text without words has the all-zero fingerprint.
    """
    from answerloom.llm.textscan import R, kept, mix, text_bytes, word_hashes

    memo = kept(("samples", samples), lambda: _Samples(samples))
    words, at = word_hashes(*text_bytes(column), lower=True)
    out = np.zeros((len(column), samples), np.uint16)
    # Rows are worked on in runs of about 20,000 distinct terms; a long text stands alone.
    terms, counts, sizes = [], [], np.zeros(len(column), np.int64)
    for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
        if b > a:
            term, count = np.unique(words[a:b], return_counts=True)
            terms.append(term)
            counts.append(count)
            sizes[i] = len(term)
    ends = np.cumsum(sizes)
    rows = np.flatnonzero(sizes)
    begin = 0
    while begin < len(rows):
        base = ends[rows[begin - 1]] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends[rows], base + 20_000, "right")))
        own = rows[begin:end]
        least = np.full((len(own), samples), np.inf, np.float32)
        term, count = np.concatenate(terms[begin:end]), np.concatenate(counts[begin:end])
        starts = np.cumsum(sizes[own]) - sizes[own]
        # A very long text is folded into its row part by part.
        for low in range(0, len(term), 50_000):
            part = slice(low, low + 50_000)
            x, n = term[part], count[part]
            slots = memo.find(mix(x + n.astype(np.uint64) * R), lambda new: memo.add(x[new], np.sqrt(n[new])))
            values = memo.values.array[:memo.values.size].reshape(-1, samples)[slots]
            first = np.clip(starts - low, 0, len(x))
            inside = np.flatnonzero(np.diff(np.append(np.clip(starts - low, 0, len(x)), len(x))) > 0)
            least[inside] = np.minimum(least[inside], np.minimum.reduceat(values, first[inside], axis=0))
        bits = least.view(np.uint32) * np.uint32(0x9E3779B1)
        out[own] = np.maximum((bits ^ (bits >> np.uint32(15))) >> np.uint32(16), 1)
        begin = end
    return out


def likeness(a, b):
    """Share of equal samples per row: an estimate of the generalised Jaccard similarity."""
    return (a == b).mean(axis=1)


def hex_names(prints):
    """A fingerprint as text, four hex digits per sample."""
    width = prints.shape[1] * 4
    text = prints.astype(">u2").tobytes().hex()
    return [text[i * width:(i + 1) * width] for i in range(len(prints))]


def _fingerprint(samples, batches):
    import pyarrow as pa

    from answerloom.llm.textscan import pieces

    for batch in batches:
        for part in pieces(batch):
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(hex_names(fingerprints(part.column(1), samples)), pa.string())],
                ["id", "fingerprint"])


def document_fingerprints(docs, id_col="doc_id", text_col="text", samples=SAMPLES):
    """``(id_col, fingerprint)`` of every row: a narrow pass without a shuffle.

    Equal texts have equal fingerprints; two fingerprints agree in a share of
    samples that estimates the generalised Jaccard similarity of the texts'
    weighted words. NULL and wordless texts share the all-zero fingerprint.
    Rows with NULL or repeated ids count like any other; other columns are ignored.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(partial(_fingerprint, samples), "id long, fingerprint string")
    return out.withColumnRenamed("id", id_col)


def _compare(samples, batches):
    """Sorted rows (id, text, extra): each with its edited and its following text.

    Every range of rows ends with an extra row, a copy of the row that follows
    it; that copy has no output of its own.
    """
    from hashlib import sha256

    import pyarrow as pa

    from answerloom.llm.textscan import pieces

    carried = []
    for batch in batches:
        for part in pieces(batch):
            rows = carried + list(zip(
                part.column(0).to_pylist(), [t or "" for t in part.column(1).to_pylist()],
                part.column(2).to_pylist()))
            carried = rows[-1:]
            texts = [t for _, t, _ in rows]
            real = np.array([not extra for _, _, extra in rows[:-1]], bool)
            if not real.any():
                continue
            edited = [
                a[:len(a) - len(a) // 2] + b[:len(a) // 2] for a, b in zip(texts, texts[1:])
            ]
            prints = fingerprints(pa.array(texts + edited, pa.large_string()), samples)
            own, following, changed = prints[:len(edited)], prints[1:len(texts)], prints[len(texts):]
            yield pa.RecordBatch.from_arrays([
                pa.array([i for i, _, _ in rows[:-1]], pa.int64()),
                pa.array([len(t) for t in texts[:-1]], pa.int64()),
                pa.array([sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                pa.array(hex_names(own), pa.string()), pa.array(hex_names(changed), pa.string()),
                pa.array(likeness(own, changed)), pa.array(likeness(own, following)),
            ], ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next",
                ]).filter(pa.array(real))


def _range_of(key, cuts):
    """How many of the sorted ``cuts`` are not above ``key`` (0 for NULL), in two short scans."""
    if not cuts:
        return F.lit(0)
    step = int(len(cuts) ** 0.5) + 1
    coarse, fine = F.lit(np.array(cuts[::step], np.int64)), F.lit(np.array(cuts, np.int64))
    whole = F.size(F.filter(coarse, lambda c: c <= key))
    part = F.slice(fine, F.greatest((whole - 1) * step + 1, F.lit(1)), step)
    inside = F.size(F.filter(part, lambda c: c <= key))
    return F.when(key.isNull() | (whole == 0), 0).otherwise((whole - 1) * step + inside)


def compare_with_next(docs, id_col="doc_id", text_col="text", samples=SAMPLES):
    """Every row's fingerprint beside those of its edited text and of the next row.

    Rows stand in ascending order of (id, text), NULL first; the last row is
    followed by the first. In the edited text the last floor(n_chars / 2)
    characters are replaced by the first as many (or all) of the next text.
    NULL texts are empty. Returns ``id_col, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next``; other columns are ignored.

    Ids are cut into as many ranges as the session has shuffle partitions, at
    quantiles of the ids. One shuffle brings each range, sorted, to a task together with a
    copy of the row that follows it. Only the ranges' first ids (one number per
    range) pass through the driver.
    """
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    steps = [i / ranges for i in range(1, ranges)]
    cuts = rows.where("id IS NOT NULL").approxQuantile("id", steps, 0.2 / ranges) if steps else []
    rows = rows.withColumn("range", _range_of(F.col("id"), sorted({int(c) for c in cuts})))
    firsts = sorted(
        (r["range"], None if r["nulls"] else r["first"])
        for r in rows.groupBy("range").agg(F.min("id").alias("first"), F.count_if(F.col("id").isNull()).alias("nulls")).collect()
    )
    # The first row of a range closes the range before it, that of the first range the last one.
    closes = [(at, first, firsts[i - 1][0]) for i, (at, first) in enumerate(firsts)]
    ends = F.broadcast(spark.createDataFrame(closes, "at int, first long, closes int"))
    copies = (
        rows.join(ends, (F.col("range") == F.col("at")) & F.col("id").eqNullSafe(F.col("first")))
        .groupBy("closes").agg(F.min(F.struct("id", "text")).alias("row"))
        .select("row.id", "row.text", F.col("closes").alias("range"), F.lit(True).alias("extra"))
    )
    ordered = (
        rows.withColumn("extra", F.lit(False)).unionByName(copies)
        .repartitionByRange(ranges, "range").sortWithinPartitions("range", "extra", "id", "text")
        .select("id", "text", "extra")
    )
    return ordered.mapInArrow(
        partial(_compare, samples),
        "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double").withColumnRenamed("id", id_col)
