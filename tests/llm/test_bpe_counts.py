"""Token counts against the sentencepiece library."""

import random

import public_tokenizers
import sentencepiece

from answerloom.llm import bpe_counts
from conftest import SF

MODEL = public_tokenizers.path("piece_bpe_32k.model")
EDGES = [
    None, "", " ", "  ", "a", " a", "a ", "  a   b ", "\t\n x", "▁", "a▁b ▁ c", "a ▁▁ b▁", "日本語 漢字", "🙂 x🙂", "<s> </s> <unk> <0x0A>",
    "\x00\x01", "x" * 20_000, "ab " * 20_000, "é́ ﬁ ①", "                 deep", "▁ â▁",
]


def check(df, rows):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = {i: (len((t or "").encode()), len(library.encode(t or ""))) for i, t in rows}
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in df.collect()}
    assert got == want
    assert df.where("over_limit <> (n_tokens > 4096)").count() == 0


def test_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check(bpe_counts.token_counts(docs, MODEL), [(r.doc_id, r.text) for r in docs.collect()])


def test_edge_texts(spark):
    rng = random.Random(4)
    marks = [" ", "▁", "a", "the", "\n", "é", "語", "🙂", "  ", "1", "ing"]
    rows = list(enumerate(EDGES + ["".join(rng.choices(marks, k=rng.randint(1, 15))) for _ in range(1500)]))
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, id string, n_tokens int")
    check(bpe_counts.token_counts(docs.repartition(3), MODEL), rows)
    assert bpe_counts.token_counts(docs.limit(0), MODEL).count() == 0
    assert bpe_counts.token_counts(docs.where("doc_id < 4").unionAll(docs.where("doc_id < 4")), MODEL).count() == 8
