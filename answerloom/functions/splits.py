"""Deterministic train/val/test assignment from the question id."""

from pyspark.sql import functions as F

BUCKETS = 10_000
# 2654435761 modulo BUCKETS (fixed value); the reduced form cannot overflow a BIGINT.
MULTIPLIER = 5761


def thresholds(val_fraction, test_fraction):
    """Bucket counts of the val and test ranges; rejects impossible fractions."""
    if val_fraction <= 0:
        raise ValueError("val_fraction must be positive")
    if test_fraction < 0:
        raise ValueError("test_fraction must not be negative")
    if val_fraction + test_fraction >= 1:
        raise ValueError("val_fraction + test_fraction must stay below 1")
    return int(val_fraction * BUCKETS), int(test_fraction * BUCKETS)


def bucket(question_id):
    """Bucket 0..9999. ``pmod`` keeps a negative id in range as well."""
    last_digits = F.pmod(question_id, F.lit(BUCKETS).cast("long"))
    return F.pmod(last_digits * F.lit(MULTIPLIER), F.lit(BUCKETS).cast("long"))


def three_way(question_id, val_fraction=0.10, test_fraction=0.05):
    """'test' / 'val' / 'train'; NULL for a NULL id, which belongs to no split."""
    val, test = thresholds(val_fraction, test_fraction)
    b = bucket(question_id)
    return (
        F.when(b < test, "test").when(b < test + val, "val").when(b.isNotNull(), "train")
    )


def is_val(question_id, val_fraction):
    """Two-way rule: an id that is NULL or not a number is not val."""
    b = bucket(question_id.try_cast("bigint"))
    return F.coalesce(b < int(val_fraction * BUCKETS), F.lit(False))


def two_way(question_id, val_fraction=0.01):
    return F.when(is_val(question_id, val_fraction), "val").otherwise("train")
