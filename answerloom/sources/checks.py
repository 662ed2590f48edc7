"""Validation of token tables against their manifest."""

from pyspark.sql import functions as F


def token_check(tokens, vocab_size):
    """Per split: rows, shortest and longest row, and ids outside the vocabulary."""
    outside = F.size(F.filter("input_ids", lambda i: (i < 0) | (i >= vocab_size)))
    return tokens.groupBy("split").agg(
        F.count("*").alias("rows"),
        F.min(F.size("input_ids")).alias("min_len"),
        F.max(F.size("input_ids")).alias("max_len"),
        F.sum(outside).alias("bad_ids"),
    )


def require_valid(tokens, manifest, vocab_size, max_seq_len):
    """Raise when tokens, manifest and configuration disagree."""
    stated = manifest.first()
    if stated is None:
        raise ValueError("the manifest is empty")
    if stated["max_seq_len"] != max_seq_len:
        raise ValueError(f"manifest has max_seq_len {stated['max_seq_len']}, expected {max_seq_len}")
    found = {r["split"]: r for r in token_check(tokens, vocab_size).collect()}
    if "train" not in found:
        raise ValueError("no training rows")
    for split, expected in stated["stats"].asDict().items():
        row = found.get(split)
        if (row["rows"] if row else 0) != expected:
            raise ValueError(f"{split}: manifest states {expected} rows, found {row['rows'] if row else 0}")
        if row and (row["min_len"] != max_seq_len or row["max_len"] != max_seq_len):
            raise ValueError(f"{split}: rows are not all {max_seq_len} ids long")
        if row and row["bad_ids"]:
            raise ValueError(f"{split}: {row['bad_ids']} ids outside the vocabulary")
