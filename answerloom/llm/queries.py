"""One query per operator, with production settings over the whole table it is meant for."""

from pyspark.sql import functions as F

from answerloom.llm.bpe_counts import token_counts
from answerloom.llm.collocations import collocations
from answerloom.llm.decontamination import leaks
from answerloom.llm.packing import pack_documents
from answerloom.llm.pseudonyms import pseudonymise
from answerloom.llm.secret_scan import describe, secret_spans
from answerloom.llm.string_kernel import learn, toxicity_scores
from answerloom.llm.superminhash import near_duplicates
from answerloom.llm.token_files import read_token_files, write_token_files
from answerloom.llm.turn_repair import damage, repair_conversations
from answerloom.llm.url_lists import blocked_captures, url_keys
from answerloom.llm.warc import read_archives, write_archives
from answerloom.llm.weighted_sampling import compare_with_next
from answerloom.session import work_dir

QUERIES, ORACLES = {}, {}


def query(sql=None):
    """Register a ``(spark, sf_dir) -> DataFrame`` function under its own name."""
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn
    return add


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op1_decontamination(spark, sf_dir):
    """Benchmark items in documents, a row per document and item."""
    return leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("text_key")


@query()
def op2_superminhash(spark, sf_dir):
    return near_duplicates(_table(spark, sf_dir, "documents"), k=2, percent=80)


def _tokenizer(name):
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte(text, n):
    """The n-th byte of the md5 of a text."""
    digit = lambda i: F.instr(F.lit("0123456789abcdef"), F.substring(F.md5(text), i, 1)) - 1
    return digit(2 * n + 1) * 16 + digit(2 * n + 2)


def _list_events(pages):
    """Dated list entries for the hosts and first path segments that pages have, drawn by md5."""
    keys = pages.select(url_keys(F.col("url")).alias("k")).where("k IS NOT NULL")
    hosts = keys.select(F.lit("hosts").alias("list"), F.col("k")[0].alias("key"))
    paths = keys.select(F.lit("paths").alias("list"), F.explode(F.filter("k", lambda k: F.size(F.split(k, "/")) == 2)).alias("key"))
    drawn = hosts.unionByName(paths).distinct().where(_byte(F.col("key"), 0) % 2 == 0)
    byte = lambda n: _byte(F.col("key"), n)
    start = F.date_add(F.lit("2024-01-01").cast("date"), byte(1))
    stop = F.date_add(start, byte(2) + 1)
    again = F.date_add(stop, byte(3) + 1)
    event = lambda day, action: F.struct(day.alias("day"), F.lit(action).alias("action"))
    steps = F.array(event(start, "add"), event(stop, "remove"), event(again, "add"))
    return drawn.select("list", "key", F.explode(F.slice(steps, F.lit(1), byte(4) % 3 + 1)).alias("e")).select("list", "key", "e.*")


_HOST = r"""regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)(?::[0-9]*)?([^?#]*)', 1)), '\.+$', '')"""
_PATH = r"""regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)(?::[0-9]*)?([^?#]*)', 2)"""


def _byte_sql(text, n):
    digit = "(strpos('0123456789abcdef', substr(md5({}), {}, 1)) - 1)"
    return f"({digit.format(text, 2 * n + 1)} * 16 + {digit.format(text, 2 * n + 2)})"


URL_LISTS_SQL = f"""
WITH parsed AS (
  SELECT page_id, url, {_HOST} AS host, list_filter(string_split({_PATH}, '/'), lambda x: x <> '') AS segs,
         DATE '2024-01-01' + CAST({_byte_sql("CAST(page_id AS VARCHAR)", 0)} * 2 AS INTEGER) AS day FROM pages),
keyed AS (
  SELECT page_id, host, day, CASE WHEN host <> '' THEN list_distinct(list_concat(
      list_transform(range(1, len(string_split(host, '.')) + 1), lambda i: array_to_string(string_split(host, '.')[i:], '.')),
      list_transform(range(1, len(segs) + 1), lambda i: host || '/' || array_to_string(segs[:i], '/')))) END AS ks
  FROM parsed),
names AS (
  SELECT DISTINCT 'hosts' AS list, host AS key FROM parsed WHERE host <> ''
  UNION SELECT DISTINCT 'paths', host || '/' || segs[1] FROM parsed WHERE host <> '' AND len(segs) > 0),
drawn AS (
  SELECT list, key, DATE '2024-01-01' + CAST({_byte_sql("key", 1)} AS INTEGER) AS start,
         CAST({_byte_sql("key", 2)} AS INTEGER) + 1 AS n, CAST({_byte_sql("key", 3)} AS INTEGER) + 1 AS m,
         {_byte_sql("key", 4)} % 3 AS kind
  FROM names WHERE {_byte_sql("key", 0)} % 2 = 0),
spans AS (
  SELECT list, key, start AS valid_from, CASE WHEN kind > 0 THEN start + n END AS valid_to FROM drawn
  UNION ALL SELECT list, key, start + n + m, NULL FROM drawn WHERE kind = 2),
hits AS (
  SELECT k.page_id, s.key FROM (SELECT page_id, day, unnest(ks) AS key FROM keyed) k JOIN spans s
    ON k.key = s.key AND s.valid_from <= k.day AND (s.valid_to IS NULL OR k.day < s.valid_to)),
best AS (
  SELECT page_id, count(*) AS n_entries, arg_min(key, (-length(key), key)) AS entry FROM hits GROUP BY page_id)
SELECT p.page_id, p.day, b.n_entries IS NOT NULL AS blocked, coalesce(b.n_entries, 0) AS n_entries, b.entry
FROM parsed p LEFT JOIN best b ON p.page_id = b.page_id"""


@query(URL_LISTS_SQL)
def op3_url_lists(spark, sf_dir):
    """Pages against dated list entries; the tables give neither fetch days nor lists, so both are drawn by md5."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn(
        "day", F.date_add(F.lit("2024-01-01").cast("date"), _byte(F.col("page_id").cast("string"), 0) * 2))
    return blocked_captures(captures, _list_events(pages)).drop("url")


def _held_out(id_col):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


@query()
def op4_string_kernel(spark, sf_dir):
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = learn(docs, labels.where(~_held_out("doc_id")))
    return toxicity_scores(docs, model).select(
        "doc_id", _held_out("doc_id").alias("held_out"), "score",
        F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


@query()
def op5_pseudonyms(spark, sf_dir):
    """Documents that hold personal values, with pseudonyms in their place."""
    found = pseudonymise(_table(spark, sf_dir, "documents"), key="of-the-corpus")
    kinds = F.array_join(F.transform("pseudonyms", lambda p: F.concat_ws("=", p.kind, p.pseudonym)), ",")
    return found.where(F.size("pseudonyms") > 0).select(
        "doc_id", F.size("pseudonyms").alias("n_values"), kinds.alias("pseudonyms"), "text")


@query()
def op6_warc_salvage(spark, sf_dir):
    path = work_dir(spark, "archives")
    write_archives(_table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path, with_payload=False).where("status = 'valid'").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query()
def op7_bpe_counts(spark, sf_dir):
    return token_counts(_table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


@query()
def op8_packing(spark, sf_dir):
    return pack_documents(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


@query()
def op9_weighted_sampling(spark, sf_dir):
    return compare_with_next(_table(spark, sf_dir, "documents"))


@query()
def op10_secret_scan(spark, sf_dir):
    marked = secret_spans(_table(spark, sf_dir, "documents"))
    spans = F.col("secret_spans")
    count = lambda no: F.size(F.filter(spans, lambda s: s.kind_no == no)).cast("long")
    return marked.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(describe(F.filter(spans, lambda s: s.kind_no < 3)), 256).alias("base_sha256"),
        describe(spans).alias("spans"))

#: CRC-32 bit by bit over the bytes of an ASCII text.
_CRC32_SQL = """
  xor(4294967295, list_reduce(list_transform(string_split({0}, ''), lambda ch: CAST(ord(ch) AS BIGINT)),
    lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0],
      lambda v, unused: xor(v >> 1, (v & 1) * 3988292384)), CAST(4294967295 AS BIGINT)))"""


def _turn_repair_sql():
    """The same repair as one forward fold per conversation; a state is its cheapest, then ASCII-least, way there."""
    best = lambda *ways: f"list_min([{', '.join(ways)}])"
    way = lambda q, cost, edit, line="''": (
        f"{{'c': {q}.c + {cost}, 'a': {q}.a || '{edit}', 't': {q}.t || {line}}}")
    state = lambda s, n: f"{s}[{n + 1}]"
    insert = lambda q, role: way(q, 5, "I", f"chr(10) || '{role}:'")
    user_first = best(state("s", 2), insert(state("s", 0), "user"), insert(state("s", 1), "user"))
    closed = (f"[{state('s', 0)}, {state('s', 1)}, {best(user_first, insert(state('s', 3), 'user'))}, "
              f"{best(state('s', 3), insert(user_first, 'assistant'))}]")
    line = "chr(10) || z.r.role || ':' || z.r.text"
    delete = lambda n: way(state("z.s", n), 2, "D")

    def stay(n, initial, role):
        keep = way(state("z.s", n), "z.r.extra", "K", line)
        if role is None:
            return f"CASE WHEN z.r.first = '{initial}' AND NOT z.r.gone THEN {keep} ELSE {delete(n)} END"
        other = way(state("z.s", n), "z.r.extra + 1", "R", f"chr(10) || '{role}:' || z.r.text")
        return f"CASE WHEN z.r.gone THEN NULL WHEN z.r.first = '{initial}' THEN {keep} ELSE {other} END"

    kept_system = f"CASE WHEN z.r.first = 's' AND NOT z.r.gone THEN {way(state('z.s', 0), 'z.r.extra', 'K', line)} END"
    step = (f"[{delete(0)}, {best(delete(1), kept_system)}, "
            f"{best(delete(2), *(stay(n, 'u', 'user') for n in (0, 1, 3)))}, {best(delete(3), stay(2, 'a', 'assistant'))}]")
    far = "{'c': CAST(1000000000 AS BIGINT), 'a': '', 't': ''}"
    white = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH drawn AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         crc32_of.draw % 20 AS draw
  FROM conversations, LATERAL (SELECT {_CRC32_SQL.format("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} AS draw) crc32_of),
damaged AS (
  SELECT conv_id, turn, CASE WHEN draw = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN draw = 1 THEN '' WHEN draw = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(CASE WHEN draw = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM drawn WHERE draw <> 0),
placed AS (
  SELECT *, right(rtrim(text, {white}), 1) AS ending, substr(role, 1, 1) AS first,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos FROM damaged),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) AS nth,
         lag(first) OVER (PARTITION BY conv_id ORDER BY pos) AS prior FROM placed),
judged AS (
  SELECT *, ending = '' AS blank, ending <> '' AND nth > 1 AS duplicate,
         ending NOT IN ('', '.', '!', '?') AND nth = 1 AS truncated FROM seen),
folded AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
         count(*) FILTER (truncated) AS truncated,
         count(*) FILTER (pos > 1 AND prior || first NOT IN ('su', 'ua', 'au')) AS illegal,
         list({{'first': first, 'role': role, 'text': text, 'gone': blank OR duplicate,
               'extra': CASE WHEN truncated THEN 5 ELSE 0 END}} ORDER BY pos) AS rs
  FROM judged GROUP BY conv_id),
walked AS (
  SELECT *, list_reduce(list_transform(rs, lambda r: {{'r': r, 's': NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR)[]}}),
    lambda x, y: {{'r': y.r, 's': list_transform([{{'r': y.r, 's': list_transform([x.s], lambda s: {closed})[1]}}],
      lambda z: {step})[1]}},
    {{'r': NULL::STRUCT("first" VARCHAR, "role" VARCHAR, "text" VARCHAR, gone BOOLEAN, extra INTEGER),
      's': [{{'c': CAST(0 AS BIGINT), 'a': '', 't': ''}}, {far}, {far}, {far}]}}).s AS s
  FROM folded),
ended AS (SELECT *, list_transform([s], lambda s: list_min([(s)[1], ({closed})[4]]))[1] AS w FROM walked)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(w.c, 0) AS cost,
       coalesce(w.a, '') AS audit, sha256(coalesce(substr(w.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) ids LEFT JOIN ended ON ids.conv_id IS NOT DISTINCT FROM ended.conv_id"""


@query(_turn_repair_sql())
def op11_turn_repair(spark, sf_dir):
    """Damaged conversations, their faults, the cheapest repair and its digest."""
    rows = _table(spark, sf_dir, "conversations")
    report, _, digests = repair_conversations(damage(rows))
    ids = rows.select(F.col("conv_id").cast("long").alias("id")).distinct()
    digests = digests.withColumnRenamed("conv_id", "d")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return (
        ids.join(report, ids.id.eqNullSafe(report.conv_id), "left").drop("conv_id")
        .join(digests, F.col("id").eqNullSafe(digests.d), "left")
        .select(
            F.col("id").alias("conv_id"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts],
            F.coalesce("audit", F.lit("")).alias("audit"),
            F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
    )


@query()
def op12_token_files(spark, sf_dir):
    path = work_dir(spark, "token-files")
    write_token_files(_table(spark, sf_dir, "documents"), path, _tokenizer("word_bpe_49k.json"), end_id=1)
    return read_token_files(spark, path)


COLLOCATIONS_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
listed AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda w: w <> '') AS ws FROM pieces),
starts AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM listed),
grams AS (
  SELECT lang, k AS words, array_to_string(ws[i:i + k - 1], ' ') AS phrase
  FROM starts, (VALUES (1), (2), (3)) AS sizes(k) WHERE i + k - 1 <= len(ws)),
f AS (SELECT lang, words, phrase, count(*) AS f FROM grams GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM f WHERE words = 1 GROUP BY lang),
candidates AS (SELECT lang, words, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE words > 1 AND f >= 10),
cuts AS (SELECT *, unnest(range(1, words)) AS k FROM candidates),
scored AS (
  SELECT c.lang, c.words, c.phrase, c.a, c.k, l.f AS l, r.f AS r,
         CAST(1000000 AS HUGEINT) * c.a * c.a // (CAST(l.f AS HUGEINT) * r.f) AS score
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.ws[:c.k], ' ')
       JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.ws[c.k + 1:], ' ')),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
around AS (
  SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, a, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS phrase
    FROM candidates WHERE words = 3) GROUP BY ALL),
ranked AS (
  SELECT w.*, row_number() OVER (PARTITION BY w.lang ORDER BY score DESC, a DESC, w.phrase) AS rank
  FROM weakest w LEFT JOIN around o ON o.lang = w.lang AND o.phrase = w.phrase
  WHERE w.words = 3 OR o.longer IS NULL OR 100 * o.longer < 50 * w.a)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked JOIN n USING (lang) WHERE rank <= 2000"""


@query(COLLOCATIONS_SQL)
def op13_collocations(spark, sf_dir):
    return collocations(_table(spark, sf_dir, "documents"))
