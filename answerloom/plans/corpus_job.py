"""The whole preparation as one configurable Spark job with saved stages."""

import json
from dataclasses import asdict, dataclass, replace
from hashlib import sha256

from pyspark.sql import functions as F

from answerloom.functions.splits import two_way
from answerloom.functions.templates import broken_text
from answerloom.operators.curate import curate, split_pairs
from answerloom.operators.encode import tokenize_pairs
from answerloom.operators.pairs import pair_posts
from answerloom.operators.tokenizer import (
    BpeModel, learn_bpe, pretoken_counts, train_sample, two_way_sample,
)
from answerloom.schemas import posts_schema, require_columns
from answerloom.sources.checks import require_valid
from answerloom.sources.sinks import manifest, write_manifest, write_tokens
from answerloom.sources.tables import file_states, must_build, note_stage, read_tokens, saved_stage


@dataclass(frozen=True)
class CorpusConfig:
    """Knobs of the job; the defaults are the three-way preset."""

    policy: str = "three_way"          # or "two_way": no curation, train and val only
    min_question_chars: int = 10
    min_pair_answer_chars: int = 32
    val_fraction: float = 0.10
    test_fraction: float = 0.05
    min_answer_score: int = 1
    min_answer_chars: int = 40
    min_answer_words: int = 8
    drop_short_thanks: bool = False
    best_answer_only: bool = False
    prompt_style: str = "standard"
    max_text_chars: int | None = None  # cut longer texts; cut rows are flagged and counted
    max_seq_len: int = 1_024
    vocab_size: int = 16_000
    alphabet: str = "observed"
    tokenizer_sample_rows: int | None = None  # learn from so many train rows only
    rows_per_file: int = 65_536
    hot_share: int = 1_000_000
    seed: int = 42


_BASE = CorpusConfig()
_RUN_A = replace(
    _BASE, min_answer_chars=80, min_answer_words=12, drop_short_thanks=True,
    vocab_size=32_000,
)

PRESETS = {
    "fast": _BASE,
    "stream": replace(_BASE, policy="two_way", val_fraction=0.01, test_fraction=0.0),
    "run_a": _RUN_A,
    "run_c": replace(_RUN_A, prompt_style="grounded_qa"),
    "notebook": _BASE,
}

#: How many train rows a caller may choose to learn from instead of all.
SAMPLE_ROWS = {"fast": 200_000, "stream": 50_000, "run_a": 2_000_000, "run_c": 2_000_000, "notebook": 200_000}


def sampled_preset(name):
    """A preset whose tokenizer learns from a sample of its usual size."""
    return replace(PRESETS[name], tokenizer_sample_rows=SAMPLE_ROWS[name])


def split_rows(pairs, config):
    """Curated pairs with their split, by the configured policy."""
    if config.policy == "two_way":
        return pairs.withColumn("split", two_way(F.col("question_id"), config.val_fraction))
    kept = curate(
        pairs, config.min_answer_score, config.min_answer_chars, config.min_answer_words,
        config.drop_short_thanks, config.best_answer_only,
    )
    return split_pairs(kept, config.val_fraction, config.test_fraction)


def train_tokenizer(rows, config):
    """Sample lines, count their words on the cluster, learn the merges."""
    if config.policy == "two_way":
        lines = two_way_sample(
            rows, config.tokenizer_sample_rows, config.val_fraction, config.max_text_chars,
            seed=config.seed,
        )
    else:
        lines = train_sample(
            rows.where("split = 'train'"), config.tokenizer_sample_rows, config.max_text_chars,
            config.prompt_style, seed=config.seed,
        )
    return learn_bpe(pretoken_counts(lines), config.vocab_size, config.alphabet)


#: The knobs each stage depends on, besides those of the stages before it.
STAGE_KNOBS = {
    "pairs": ("min_question_chars", "min_pair_answer_chars"),
    "split": ("policy", "val_fraction", "test_fraction", "min_answer_score", "min_answer_chars",
              "min_answer_words", "drop_short_thanks", "best_answer_only"),
    "tokenizer": ("prompt_style", "max_text_chars", "vocab_size", "alphabet", "tokenizer_sample_rows", "seed"),
    "tokens": ("max_seq_len", "rows_per_file"),
}


def fingerprints(posts, config):
    """A hash per stage over its knobs, the stages before it, the input files and the plan over them.

    A file counts with its length and modification time, so one that is written anew under its name is another.
    """
    if posts is None:
        return dict.fromkeys(STAGE_KNOBS)
    upstream = [file_states(posts), posts._jdf.queryExecution().analyzed().canonicalized().toString()]
    knobs, out = asdict(config), {}
    for stage, names in STAGE_KNOBS.items():
        upstream = sha256(json.dumps([upstream, {k: knobs[k] for k in names}], sort_keys=True).encode()).hexdigest()
        out[stage] = upstream
    return out


def run_job(spark, posts, out, config=_BASE, reuse=True, skip=()):
    """Posts to token chunks below ``out``; returns the folders of every stage.

    Stages: ``pairs``, ``split``, ``tokenizer``, ``tokens``. A finished stage is
    reused (``reuse``) if it was made with the same knobs from the same input
    (files and plan), else made anew; one named in ``skip`` must exist already, made that way.
    Without ``posts`` the input is not known, and finished stages are taken as they
    are. The curated rows are scanned once for all splits.
    """
    at = {name: f"{out}/{name}" for name in ("pairs", "split", "tokenizer", "tokens", "manifest")}
    made = fingerprints(posts, config)
    if posts is not None and "pairs" not in skip:
        tags = [posts.schema["Tags"].dataType] if "Tags" in posts.columns else []
        require_columns(posts, posts_schema(*tags), "posts")
    pairs = saved_stage(
        spark, at["pairs"],
        lambda: pair_posts(
            posts, config.min_question_chars, config.min_pair_answer_chars, config.hot_share
        ),
        reuse, "pairs" in skip, made["pairs"],
    )
    split = saved_stage(
        spark, at["split"], lambda: split_rows(pairs, config).withColumn("skipped", broken_text(pairs)),
        reuse, "split" in skip, made["split"],
    )
    rows = split.where("NOT skipped")
    if must_build(spark, at["tokenizer"], reuse, "tokenizer" in skip, made["tokenizer"], "merges/_SUCCESS"):
        model = train_tokenizer(rows, config)
        model.save(spark, at["tokenizer"])
        note_stage(spark, at["tokenizer"], made["tokenizer"])
    else:
        model = BpeModel.load(spark, at["tokenizer"])
    if "tokens" in skip:
        must_build(spark, at["tokens"], reuse, True, made["tokens"])
        return at
    if must_build(spark, at["tokens"], reuse, False, made["tokens"]):
        tokens = tokenize_pairs(
            rows, model, config.max_seq_len, config.max_text_chars, config.prompt_style
        )
        write_tokens(tokens, at["tokens"], config.rows_per_file, rebalance=True)
        note_stage(spark, at["tokens"], made["tokens"])
    written = read_tokens(spark, at["tokens"])
    lost = split.where("skipped").groupBy("split").count().collect()  # at most one number per split
    settings = manifest_settings(config, at["tokens"]) | {
        "skipped": {s: 0 for s in splits(config)} | {r["split"]: r["count"] for r in lost if r["split"]}}
    write_manifest(manifest(written, settings, splits(config)), at["manifest"])
    require_valid(written, spark.read.json(at["manifest"]), model.size, config.max_seq_len)
    return at


def splits(config):
    return ("train", "val") if config.policy == "two_way" else ("train", "val", "test")


def manifest_settings(config, tokens_path):
    knobs = asdict(config)
    return {
        "mode": config.policy,
        **{f"{s}_path": f"{tokens_path}/split={s}" for s in splits(config)},
        "max_seq_len": config.max_seq_len,
        "fractions": {"val": config.val_fraction, "test": config.test_fraction},
        "prompt_style": config.prompt_style,
        "filters": {
            k: knobs[k] for k in (
                "min_answer_score", "min_answer_chars", "min_answer_words", "drop_short_thanks",
                "best_answer_only",
            )
        },
        "rows_per_file": config.rows_per_file,
    }
