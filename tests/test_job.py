from dataclasses import replace

import numpy as np
import pyarrow.parquet as pq
import pytest

from answerloom.plans import fixtures as fx
from answerloom.plans.corpus_job import PRESETS, fingerprints, run_job, sampled_preset
from conftest import SF

SMALL = dict(vocab_size=200, max_seq_len=64, rows_per_file=5)


def test_presets_follow_their_knobs():
    assert PRESETS["run_a"].min_answer_chars == 80 and PRESETS["run_a"].drop_short_thanks
    assert PRESETS["run_c"].prompt_style == "grounded_qa"
    assert PRESETS["stream"].policy == "two_way" and PRESETS["stream"].val_fraction == 0.01
    assert PRESETS["fast"] == PRESETS["notebook"]
    # A sample of the train rows is the caller's choice only.
    assert all(c.tokenizer_sample_rows is None for c in PRESETS.values())
    assert sampled_preset("run_a") == replace(PRESETS["run_a"], tokenizer_sample_rows=2_000_000)


@pytest.mark.parametrize("name", ["run_c", "stream"])
def test_job_runs_reuses_and_skips(spark, tmp_path, name):
    out, posts = str(tmp_path / "job"), fx.posts(spark, SF)
    config = replace(PRESETS[name], **SMALL)
    with pytest.raises(FileNotFoundError):
        run_job(spark, posts, out, config, skip=("pairs",))
    at = run_job(spark, posts, out, config)
    rows = {r.split: r["count"] for r in spark.read.parquet(at["tokens"]).groupBy("split").count().collect()}
    stats = spark.read.json(at["manifest"]).first().stats.asDict()
    assert {k: v for k, v in stats.items() if v} == rows
    assert sum(rows.values()) == (17 if name == "run_c" else 34)
    assert run_job(spark, None, out, config, skip=("pairs", "split", "tokenizer")) == at


def test_missing_tokenizer_is_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        run_job(spark, fx.posts(spark, SF), str(tmp_path / "j"), replace(PRESETS["fast"], **SMALL), skip=("tokenizer",))


def test_files_written_anew_under_their_names_are_another_input(spark, tmp_path):
    config, out, shards = replace(PRESETS["stream"], **SMALL), str(tmp_path / "job"), tmp_path / "posts dir"
    shards.mkdir()
    posts = fx.posts(spark, SF).toArrow()

    def write(rows, name="part-0.parquet"):
        pq.write_table(rows, shards / name)
        return spark.read.schema(fx.posts(spark, SF).schema).parquet(str(shards))

    def pairs():
        return spark.read.parquet(f"{out}/pairs").count()

    before = fingerprints(write(posts), config)
    run_job(spark, write(posts), out, config)
    assert pairs() == 34
    # Half the answers go: same folder, same file name, same schema.
    answers = np.flatnonzero(posts["PostTypeId"].to_numpy() == 2)
    changed = write(posts.take(np.setdiff1d(np.arange(len(posts)), answers[::2])))
    assert all(fingerprints(changed, config)[stage] != before[stage] for stage in before)
    with pytest.raises(ValueError, match="other settings or inputs"):
        run_job(spark, changed, out, config, skip=("pairs",))
    at = run_job(spark, changed, out, config)
    assert pairs() == 17 and spark.read.parquet(at["tokens"]).count() == 17
    assert sum(v or 0 for v in spark.read.json(at["manifest"]).first().stats) == 17
    # A new file is another input, too; an unchanged folder is not.
    same = fingerprints(changed, config)
    assert fingerprints(spark.read.schema(changed.schema).parquet(str(shards)), config) == same
    assert fingerprints(write(posts.take(answers[::2]), "part-1.parquet"), config) != same
    run_job(spark, spark.read.schema(changed.schema).parquet(str(shards)), out, config)
    assert pairs() == 34
