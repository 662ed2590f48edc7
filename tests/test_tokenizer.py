import pytest
from pyspark.sql import functions as F

from answerloom.functions.text import sample_lines
from answerloom.operators import encode as en, tokenizer as tk
from conftest import SF

TEXTS = [
    "the cat sat on the mat", "  two  spaces ", "it's we'll they've", "==== ==== aaaa aaa aa a",
    "été naïve Straße", "日本語 テキスト", "\U0001f600\U0001f600 ok", "x=1;y=22;z=333", "a b c",
    "", " ", "tab\there", "<bos> not special in training <eos>",
]
HARD = [
    "", "a  <sep>  b", "x(<eos>)", "<bos><pad> <unk>", " <sep>", "é   zz\n\n y", "<<sep>>", "a<se p>  ",
    "it's  '<eos>'s", "tab\t<sep>\t x", "  <sep>", "new\n\nlines  \n", "Ωmega", "aaaaaaa",
]


def _lines(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "text string").select(
        F.explode(sample_lines(F.col("text"))).alias("line")
    )


@pytest.fixture(scope="module")
def corpus(spark):
    conv = [r.text for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    return TEXTS * 3 + conv


@pytest.fixture(scope="module")
def counts(spark, corpus):
    return tk.pretoken_counts(_lines(spark, corpus)).cache()


@pytest.fixture(scope="module")
def model(counts):
    return tk.learn_bpe(counts, 600)


def _library(lines, vocab_size):
    lib = pytest.importorskip("tokenizers")
    tok = lib.Tokenizer(lib.models.BPE(unk_token="<unk>"))
    tok.pre_tokenizer = lib.pre_tokenizers.ByteLevel(add_prefix_space=False)
    trainer = lib.trainers.BpeTrainer(
        vocab_size=vocab_size, special_tokens=list(tk.SPECIALS), show_progress=False
    )
    tok.train_from_iterator(lines, trainer=trainer)
    tok.decoder = lib.decoders.ByteLevel()
    return tok


def test_vocabulary_equals_library(spark, corpus, model):
    lib = _library([r.line for r in _lines(spark, corpus).collect()], 600)
    assert [t for t, _ in sorted(lib.get_vocab().items(), key=lambda kv: kv[1])] == list(model.tokens)


def test_encode_and_decode_equal_library(spark, corpus, model):
    lib = _library([r.line for r in _lines(spark, corpus).collect()], 600)
    encode = en.encoder(spark, model)
    df = spark.createDataFrame([(t,) for t in HARD + corpus], "text string").repartition(3)
    out = df.select("text", encode(F.col("text")).alias("ids")).withColumn("back", en.decode(F.col("ids"), model))
    for text, ids, back in out.collect():
        assert ids == lib.encode(text).ids
        assert back == lib.decode(ids)


def test_exhausted_pairs_stop_learning(spark):
    small = tk.pretoken_counts(_lines(spark, ["ab ab", "b"]))
    assert tk.learn_bpe(small, 500).merges == (("a", "b"), ("Ġ", "ab"))
    assert tk.learn_bpe(small, 500, listed=1).merges == (("a", "b"), ("Ġ", "ab"))


def test_a_short_list_of_pairs_gives_the_same_merges(spark, counts, model):
    short = tk.learn_bpe(counts, 200, listed=25)
    assert short.merges == model.merges[: len(short.merges)]
    assert short.size == 200


def test_byte_alphabet_round_trips_any_text(spark, counts):
    full = tk.learn_bpe(counts, 400, alphabet="bytes")
    encode = en.encoder(spark, full)
    texts = [t for t in HARD if not any(s in t for s in tk.SPECIALS)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    rows = df.select("text", en.decode(encode(F.col("text")), full).alias("back")).collect()
    assert all(r.text == r.back for r in rows)
    assert full.tokens[: 5] == tk.SPECIALS and len(set(full.tokens)) == full.size


def test_rows_have_fixed_length_with_pads_at_the_end(spark, model):
    df = spark.createDataFrame(
        [(1, 10, "T", "B", "tag", "answer " * n) for n in (0, 5, 200)],
        "question_id long, answer_id long, title string, question_body string, tags string, answer_body string",
    )
    for r in en.tokenize_pairs(df, model, 64).collect():
        assert len(r.input_ids) == 64
        body = r.input_ids[: r.n_tokens]
        assert 0 not in body and set(r.input_ids[r.n_tokens:]) <= {0}
        assert r.truncated == (r.n_tokens == 64 and 3 not in body)


def test_model_tables_round_trip(spark, model, tmp_path):
    model.save(spark, str(tmp_path / "tok"))
    assert tk.BpeModel.load(spark, str(tmp_path / "tok")) == model
    assert model.token_id("<sep>") == 4
    with pytest.raises(ValueError):
        model.token_id("no such token")


def test_words_survive_a_full_cache(spark, model, monkeypatch):
    monkeypatch.setattr(en, "CACHED_WORDS", 2)
    words = en._Words(model.tokens, model.merges)
    import pyarrow as pa
    rows = pa.array([["the", " cat"], ["sat", "the"], []], pa.list_(pa.string()))
    once = en._encode_batch(rows, words).to_pylist()
    assert en._encode_batch(rows, words).to_pylist() == once
    assert en._encode_batch(rows.slice(1, 2), words).to_pylist() == once[1:]
