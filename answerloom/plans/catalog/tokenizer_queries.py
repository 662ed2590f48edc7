"""Word splitting, BPE learning, encoding and decoding."""

from pyspark.sql import functions as F

from answerloom.functions.templates import pair_text
from answerloom.functions.text import sample_lines
from answerloom.operators import encode as en, tokenizer as tk
from answerloom.plans import fixtures as fx
from answerloom.plans.catalog.pair_queries import _curated, _pairs
from answerloom.plans.catalog.registry import CURATED, PAIRS, pair_text_sql, query, strip_sql
from answerloom.session import cut_lineage, work_dir

VOCAB_SIZE = 320

_WORD = (
    r"''s|''t|''re|''ve|''m|''ll|''d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}\x01]+|\s+"
)
_SPECIALS = "|".join(tk.SPECIALS)


def words_sql(text, specials):
    """Word list of a text. The engine's regex has no look-ahead, so a control
    character marks where a blank run gives its last blank away, and specials."""
    if specials:
        text = rf"regexp_replace({text}, '({_SPECIALS})', chr(1) || '\1' || chr(1), 'g')"
    text = rf"regexp_replace({text}, '(\s+)(\s)([^\s\x01])', '\1' || chr(1) || '\2\3', 'g')"
    return f"regexp_extract_all({text}, '{_SPECIALS + '|' if specials else ''}{_WORD}')"


LINES = f"""lines AS (SELECT {strip_sql('l')} AS line FROM (
  SELECT unnest(string_split(replace(text, chr(10), ' '), chr(13))) AS l FROM sample))"""

_CHAR = """CASE WHEN b BETWEEN 33 AND 126 OR b BETWEEN 161 AND 172 OR b BETWEEN 174 AND 255 THEN b
  WHEN b <= 32 THEN 256 + b WHEN b <= 160 THEN 256 + 33 + b - 127 ELSE 256 + 67 END"""


def bpe_sql(vocab_size=VOCAB_SIZE):
    """CTEs after ``lines(line)`` and ``texts(k, text)``: ``rec`` holds every round's words.

    A word is a string with one character (256 + id) per symbol; each round
    replaces the most frequent pair, ties by the smaller ids.
    """
    return f"""counts AS (SELECT w, count(*) AS n FROM (SELECT unnest({words_sql('line', False)}) AS w FROM lines) GROUP BY w),
  used AS (SELECT DISTINCT unnest({words_sql('text', True)}) AS w FROM texts),
  allw AS (SELECT w, CAST(sum(n) AS BIGINT) AS n FROM (SELECT w, n FROM counts UNION ALL SELECT w, 0 FROM used) GROUP BY w),
  hexed AS (SELECT w, n, hex(encode(w)) AS h FROM allw),
  coded AS (SELECT w, n, list_transform(range(0, CAST(length(h) // 2 AS BIGINT)),
    lambda i: CAST('0x' || substr(h, i * 2 + 1, 2) AS INTEGER)) AS bs FROM hexed),
  alpha AS (SELECT b, cp, CAST(4 + row_number() OVER (ORDER BY cp) AS INTEGER) AS id FROM (
    SELECT b, {_CHAR} AS cp FROM (SELECT DISTINCT unnest(bs) AS b FROM coded WHERE n > 0))),
  amap AS (SELECT map_from_entries(list((b, chr(256 + id)))) AS m, max(id) + 1 AS next_id FROM alpha),
  words AS (SELECT w, n, array_to_string(list_transform(bs, lambda x: coalesce(m[x], chr(257))), '') AS s
    FROM coded, amap),
  rec AS (
    SELECT 0 AS it, w, n, s, CAST(NULL AS VARCHAR) AS pair FROM words
    UNION ALL
    SELECT r.it + 1, r.w, r.n, replace(r.s, b.pair, chr(CAST(256 + a.next_id + r.it AS INTEGER))), b.pair
    FROM rec r, amap a, (
      SELECT pair FROM (SELECT substr(s, i, 2) AS pair, n FROM (
        SELECT s, n, unnest(range(1, length(s))) AS i FROM rec WHERE n > 0 AND length(s) > 1))
      GROUP BY pair ORDER BY sum(n) DESC, pair LIMIT 1) b
    WHERE a.next_id + r.it < {vocab_size}),
  final AS (SELECT w, s FROM rec WHERE it = (SELECT max(it) FROM rec)),
  dict AS (SELECT w, CASE w {' '.join(f"WHEN '{t}' THEN '{i}'" for i, t in enumerate(tk.SPECIALS))}
    ELSE array_to_string(list_transform(string_split(s, ''), lambda c: CAST(unicode(c) - 256 AS VARCHAR)), ' ') END AS ids
    FROM final),
  pieces AS (SELECT k, unnest({words_sql('text', True)}) AS w,
    generate_subscripts({words_sql('text', True)}, 1) AS pos FROM texts),
  encoded AS (SELECT k, string_agg(ids, ' ' ORDER BY pos) AS ids FROM pieces JOIN dict USING (w) GROUP BY k)"""


_CONV = f"""sample AS (SELECT text FROM conversations), {LINES},
  texts AS (SELECT conv_id * 100 + turn AS k, text FROM conversations), {bpe_sql()}"""


def _conv(spark, d):
    return fx.text_table(spark, d, "conversations").select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("k"), "text"
    )


def _model(spark, d, **options):
    lines = _conv(spark, d).select(F.explode(sample_lines(F.col("text"))).alias("line"))
    return tk.learn_bpe(tk.pretoken_counts(lines), VOCAB_SIZE, **options)


def _joined(ids):
    return F.array_join(F.col(ids).cast("array<string>"), " ")


@query(f"""SELECT conv_id * 100 + turn AS k, array_to_string({words_sql('text', False)}, '¦') AS words
FROM conversations""")
def pretokens(spark, d):
    return _conv(spark, d).select("k", F.array_join(tk.pretokens(F.col("text")), "¦").alias("words"))


@query(f"""SELECT pretoken, count(*) AS count FROM (
  SELECT unnest({words_sql('text', False)}) AS pretoken FROM documents) GROUP BY pretoken""")
def pretoken_counts(spark, d):
    return tk.pretoken_counts(fx.text_table(spark, d, "documents"), "text")


@query(f"""WITH {CURATED}, t AS (SELECT answer_id, {pair_text_sql()} AS text FROM curated)
SELECT answer_id, array_to_string({words_sql('text', True)}, '¦') AS parts FROM t""")
def special_segments(spark, d):
    """Template texts cut at special tokens, the rest split into words."""
    rows = _curated(spark, d)
    texts = rows.select("answer_id", pair_text(rows).alias("text"))
    return texts.select("answer_id", F.array_join(tk.segments(F.col("text")), "¦").alias("parts"))


_RANK = "md5(concat_ws('|', '42', CAST(answer_id AS VARCHAR)))"


@query(f"""WITH {CURATED}, sample AS (SELECT {pair_text_sql()} AS text FROM curated WHERE split = 'train'
  ORDER BY {_RANK}, answer_id LIMIT 50), {LINES} SELECT line FROM lines""")
def tokenizer_sample(spark, d):
    """Exactly 50 train rows by rank; the sample size is the feature."""
    return tk.train_sample(_curated(spark, d).where("split = 'train'"), 50)


@query(f"""WITH {PAIRS}, sample AS (SELECT {pair_text_sql()} AS text FROM pairs
  WHERE NOT coalesce((question_id * 2654435761) % 10000 < 100, false)
  ORDER BY {_RANK}, answer_id LIMIT 50), {LINES} SELECT line FROM lines""")
def two_way_sample(spark, d):
    return tk.two_way_sample(_pairs(spark, d), 50)


_MERGES = f"""WITH RECURSIVE {_CONV} SELECT DISTINCT CAST(it - 1 AS INTEGER) AS rank,
CAST(unicode(substr(pair, 1, 1)) - 256 AS INTEGER) AS left_id,
CAST(unicode(substr(pair, 2, 1)) - 256 AS INTEGER) AS right_id FROM rec WHERE it > 0"""


def _merge_ids(spark, model):
    merges, vocab = model.merges_df(spark), model.vocab_df(spark)
    left = vocab.select(F.col("token").alias("left"), F.col("id").alias("left_id"))
    right = vocab.select(F.col("token").alias("right"), F.col("id").alias("right_id"))
    return merges.join(left, "left").join(right, "right").select("rank", "left_id", "right_id")


@query(_MERGES)
def bpe_merges(spark, d):
    """All merges, in order."""
    return _merge_ids(spark, _model(spark, d))


@query(_MERGES)
def bpe_merges_by_jobs(spark, d):
    """The same merges with a short list of pairs, so that rounds often count all pairs anew."""
    model = _model(spark, d, listed=40)
    return _merge_ids(spark, model)


@query(f"""WITH RECURSIVE {_CONV} SELECT id, chr(CAST(cp AS INTEGER)) AS token FROM alpha
UNION ALL SELECT * FROM (VALUES {', '.join(f"({i}, '{t}')" for i, t in enumerate(tk.SPECIALS))})""")
def vocabulary_alphabet(spark, d):
    """Special tokens and byte alphabet with their ids, from a saved and reloaded model."""
    folder = work_dir(spark, "tokenizer")
    _model(spark, d).save(spark, folder)
    model = tk.BpeModel.load(spark, folder)
    known = model.size - len(model.merges)
    return model.vocab_df(spark).where(F.col("id") < known).select("id", "token")


@query(f"WITH RECURSIVE {_CONV} SELECT k, ids FROM encoded")
def encode_texts(spark, d):
    encode = en.encoder(spark, _model(spark, d))
    return _conv(spark, d).withColumn("ids", encode(F.col("text"))).select("k", _joined("ids").alias("ids"))


@query("SELECT conv_id * 100 + turn AS k, text FROM conversations")
def decode_ids(spark, d):
    """Decoding the encoded text gives the text back (full byte alphabet)."""
    model = _model(spark, d, alphabet="bytes")
    encode = en.encoder(spark, model)
    return _conv(spark, d).select("k", en.decode(encode(F.col("text")), model).alias("text"))


def token_rows_sql(rows, table, train, length):
    """Token rows of ``table`` (after the CTEs ``rows``), with merges learned on its rows that meet ``train``."""
    return f"""WITH RECURSIVE {rows}, sample AS (SELECT {pair_text_sql()} AS text FROM {table} WHERE {train}),
  {LINES}, texts AS (SELECT answer_id AS k, {pair_text_sql()} AS text FROM {table}), {bpe_sql()},
  listed AS (SELECT k, string_split(ids, ' ') AS ids FROM encoded)
SELECT question_id, answer_id, split,
  array_to_string(list_concat(ids[1:{length}], list_transform(range(greatest({length} - len(ids), 0)), lambda i: '0')), ' ') AS input_ids,
  CAST(least(len(ids), {length}) AS INTEGER) AS n_tokens, len(ids) > {length} AS truncated
FROM {table} JOIN listed ON k = answer_id"""


@query(token_rows_sql(CURATED, "curated", "split = 'train'", 256))
def tokenize_split(spark, d):
    """Curate, split, learn on the train split, encode, cut and pad every split."""
    rows = cut_lineage(_curated(spark, d), "curated")
    lines = tk.train_sample(rows.where("split = 'train'"))
    model = tk.learn_bpe(tk.pretoken_counts(lines), VOCAB_SIZE)
    return en.tokenize_pairs(rows, model, 256).select(
        "question_id", "answer_id", "split", _joined("input_ids").alias("input_ids"),
        "n_tokens", "truncated",
    )
