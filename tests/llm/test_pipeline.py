"""The pipeline's stages against plain Python, and its run from end to end."""

import re

import corpus_pipeline
import pytest
from test_decontamination import brute as leaking
from test_packing import check as check_packing
from test_secret_scan import base
from test_superminhash import brute as groups

from conftest import SF


def rows_of(df):
    return {r.doc_id: r for r in df.collect()}


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    """Input and output rows of every stage at the smallest scale."""
    frames = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, frames[-1], SF).write.parquet(path)
        frames.append(spark.read.parquet(path))
    return frames


def test_toxicity_rejects_toxic_and_keeps_clean(spark, staged):
    before, after = (rows_of(f) for f in staged[:2])
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    gone = set(before) - set(after)
    insults = re.compile("pathetic|idiot|loser|scum|moron|worthless|clown|disgusting|trash|stupid", re.I)
    toxic = {i for i in before if labels.get(i) and insults.search(before[i].text)}
    assert len(gone & toxic) >= 0.8 * len(toxic)
    clean = {i for i in before if labels.get(i) == 0}
    assert len(gone & clean) <= 0.02 * len(clean)
    assert all(before[i] == after[i] for i in after)


def test_near_dedup_keeps_one_of_each_group(staged):
    before, after = (rows_of(f) for f in staged[1:3])
    want = groups([(i, r.text) for i, r in before.items()], 5, 80)
    assert set(after) == {i for i, (_, c) in want.items() if i == c} and len(after) < len(before)


def test_decontamination_drops_leaking_documents(spark, staged):
    before, after = (rows_of(f) for f in staged[2:4])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    short = {i: r for i, r in before.items() if len(r.text) < 4000}
    gone = {i for i, _ in leaking([(i, r.text) for i, r in short.items()], items)}
    assert gone and gone == set(short) - set(after)


def test_secrets_are_blotted_out(staged):
    before, after = (rows_of(f) for f in staged[3:5])
    assert set(before) == set(after)
    for i, r in before.items():
        new = after[i]
        assert new.n_chars == (len(new.text) if new.text != r.text else r.n_chars)
        assert not base(new.text) and (new.lang, new.source) == (r.lang, r.source)
        for span in base(r.text):
            a, b = map(int, re.findall(r"\d+", span)[-2:])
            assert r.text[a:b] not in new.text and "[SECRET]" in new.text
        if "[SECRET]" not in new.text:
            assert new.text == r.text


def test_packing_holds_every_remaining_document(staged):
    check_packing(staged[5], [(i, r.text) for i, r in rows_of(staged[4]).items()])


def test_columns_and_the_whole_run(spark, staged):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "secret_scan", "packing"]
    assert all(f.columns == staged[0].columns and f.schema["doc_id"] == staged[0].schema["doc_id"] for f in staged[:5])
    assert corpus_pipeline.run(spark, SF).count() == staged[5].count()
