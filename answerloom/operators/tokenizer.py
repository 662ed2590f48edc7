"""Byte-level BPE: corpus word counts and merges learned with Spark jobs."""

from dataclasses import dataclass

from pyspark.sql import functions as F

from answerloom import schemas
from answerloom.functions.text import sample_lines
from answerloom.functions.templates import pair_text
from answerloom.functions.splits import is_val
from answerloom.operators.merges import learn_merges
from answerloom.operators.sampling import keyed_sample
from answerloom.session import cut_lineage

# The special tokens (ids 0-4) and the public byte-level word pattern:
# 's|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+
SPECIALS = ("<pad>", "<unk>", "<bos>", "<eos>", "<sep>")
# Alternatives that cannot start alike are tried most frequent first.
WORD_PATTERN = (
    r"(?U) ?\p{L}++| ?\p{N}++|'s|'t|'re|'ve|'m|'ll|'d| ?[^\s\p{L}\p{N}]++|\s+(?!\S)|\s+"
)
# The same words, with special tokens cut out of the text first.
_NAMES = "|".join(t[1:] for t in SPECIALS)
SEGMENT_PATTERN = (
    r"(?U) ?\p{L}++| ?\p{N}++|'s|'t|'re|'ve|'m|'ll|'d"
    rf"|<(?:{_NAMES})| ?(?:[^\s\p{{L}}\p{{N}}<]++|<(?!{_NAMES}))++"
    rf"|\s+(?=<(?:{_NAMES}))|\s+(?!\S)|\s+"
)


def _byte_chars():
    """One printable character per byte: itself if printable, else 256, 257, ..."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {b: chr(b) for b in printable}
    for n, b in enumerate(b for b in range(256) if b not in chars):
        chars[b] = chr(256 + n)
    return chars


BYTE_CHARS = _byte_chars()
CHAR_BYTES = {c: b for b, c in BYTE_CHARS.items()}


def token_bytes(token):
    """The bytes a vocabulary token stands for."""
    return bytes(CHAR_BYTES[c] for c in token)


@dataclass(frozen=True)
class BpeModel:
    """Vocabulary (position = id) and merges in rank order; bounded by the vocabulary size."""

    tokens: tuple
    merges: tuple

    @property
    def size(self):
        return len(self.tokens)

    def token_id(self, token):
        """Id of a token; a missing one is an error."""
        try:
            return self.tokens.index(token)
        except ValueError:
            raise ValueError(f"token {token!r} is not in the vocabulary") from None

    def vocab_df(self, spark):
        return spark.createDataFrame([(t, i) for i, t in enumerate(self.tokens)], schemas.VOCAB)

    def merges_df(self, spark):
        return spark.createDataFrame(
            [(r, a, b) for r, (a, b) in enumerate(self.merges)], schemas.MERGES
        )

    def save(self, spark, folder):
        self.vocab_df(spark).coalesce(1).write.mode("overwrite").parquet(f"{folder}/vocab")
        self.merges_df(spark).coalesce(1).write.mode("overwrite").parquet(f"{folder}/merges")

    @classmethod
    def load(cls, spark, folder):
        vocab = spark.read.schema(schemas.VOCAB).parquet(f"{folder}/vocab").orderBy("id").collect()
        merges = spark.read.schema(schemas.MERGES).parquet(f"{folder}/merges").orderBy("rank").collect()
        return cls(tuple(r["token"] for r in vocab), tuple((r["left"], r["right"]) for r in merges))


# ---- samples -------------------------------------------------------------------------------

def train_sample(train, n=None, max_chars=None, style="standard", key="answer_id", seed=42):
    """Template text of ``n`` rows of the train split (all if None), as stripped lines."""
    rows = train if n is None else keyed_sample(train, n, key, seed)
    return rows.select(F.explode(sample_lines(pair_text(rows, max_chars, style))).alias("line"))


def two_way_sample(pairs, n=None, val_fraction=0.01, max_chars=None, key="answer_id", seed=42):
    """The low-memory variant: rows outside val, standard template only."""
    return train_sample(pairs.where(~is_val(F.col("question_id"), val_fraction)), n, max_chars,
                        "standard", key, seed)


# ---- words ---------------------------------------------------------------------------------

def pretokens(text):
    return F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(0))


def segments(text):
    """Words and special tokens of a text, in order."""
    return F.regexp_extract_all(text, F.lit(SEGMENT_PATTERN), F.lit(0))


def pretoken_counts(df, text_col="line"):
    """Corpus-wide word counts; partial aggregation absorbs very frequent words."""
    return (
        df.select(F.explode(pretokens(F.col(text_col))).alias("pretoken"))
        .groupBy("pretoken").agg(F.count("*").alias("count"))
    )


# ---- learning ------------------------------------------------------------------------------
# While merges are learned, a word is a string with one character per symbol. The
# character order equals the id order, so sorting pairs breaks ties by ids.

def _symbol(token_id):
    code = 0x100 + token_id
    return chr(code if code < 0xD800 else code + 0x800)


class _Vocabulary:
    """Grows with every merge; bounded by the requested vocabulary size."""

    def __init__(self, alphabet):
        chars = sorted(BYTE_CHARS[b] for b in alphabet)
        self.tokens = [*SPECIALS, *chars]
        self.ids = {t: i for i, t in enumerate(self.tokens)}
        self.of_symbol = {_symbol(self.ids[c]): c for c in chars}
        self.merges = []
        self.byte_symbols = {CHAR_BYTES[c]: _symbol(self.ids[c]) for c in chars}

    def joined(self, pair):
        return self.of_symbol[pair[0]] + self.of_symbol[pair[1]]

    def add(self, pair):
        """Record a merge and return the symbol of the joined token."""
        token = self.joined(pair)
        self.merges.append((self.of_symbol[pair[0]], self.of_symbol[pair[1]]))
        if token not in self.ids:
            self.ids[token] = len(self.tokens)
            self.tokens.append(token)
        symbol = _symbol(self.ids[token])
        self.of_symbol[symbol] = token
        return symbol

    def copy(self):
        other = object.__new__(_Vocabulary)
        other.__dict__.update({name: value.copy() for name, value in self.__dict__.items()})
        return other

    def model(self):
        return BpeModel(tuple(self.tokens), tuple(self.merges))


def learn_bpe(counts, vocab_size, alphabet="observed", min_count=1, **rounds):
    """Learn a BPE vocabulary from a ``(pretoken, count)`` table.

    The most frequent pair is merged first, ties go to the smaller ids.
    ``alphabet="observed"`` starts from the bytes that occur, ``"bytes"`` from
    all 256. ``min_count`` > 1 ignores rarer words. ``rounds`` go to ``learn_merges``; the merges are the same
    for all of them.

    The word table stays on the cluster at every size; what reaches the driver (letters, the
    most frequent pairs, a sample of words to guess from, changes of pair counts) is bounded.
    """
    if alphabet not in ("observed", "bytes"):
        raise ValueError("alphabet is 'observed' or 'bytes'")
    latin = F.decode(F.encode("pretoken", "UTF-8"), "ISO-8859-1")
    kept = counts.where(F.col("count") >= min_count)
    words = cut_lineage(
        kept.select(latin.alias("word"), F.col("count").cast("long").alias("n")), "words"
    )
    letters = (
        words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).where("c <> ''")
        .distinct().collect()  # at most 256 rows
    )
    seen = range(256) if alphabet == "bytes" else [ord(r["c"]) for r in letters]
    vocab = _Vocabulary(seen)
    source = "".join(chr(b) for b in vocab.byte_symbols)
    target = "".join(vocab.byte_symbols.values())
    symbols = words.where(F.length("word") > 1).select(
        F.translate("word", source, target).alias("word"), "n"
    )
    learn_merges(symbols, vocab, vocab_size, **rounds)
    return vocab.model()
