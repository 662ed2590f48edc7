"""Arrays of token ids: padding, context windows, labels, repetition."""

from pyspark.sql import functions as F


def _fill(pad, missing):
    return F.array_repeat(F.lit(pad).cast("int"), F.greatest(missing, F.lit(0)).cast("int"))


def pad_right(ids, length, pad=0):
    """Cut to ``length`` ids, then fill up with ``pad`` at the end."""
    return F.concat(F.slice(ids, 1, length), _fill(pad, F.lit(length) - F.size(ids)))


def context_window(ids, length, pad=0):
    """The last ``length`` ids, filled up with ``pad`` in front."""
    start = F.greatest(F.lit(1), F.size(ids) - F.lit(length - 1))
    return F.concat(_fill(pad, F.lit(length) - F.size(ids)), F.slice(ids, start, F.lit(length)))


def next_token_labels(ids):
    """Labels of a causal model: the ids shifted by one."""
    return F.slice(ids, F.lit(2), F.greatest(F.size(ids) - 1, F.lit(0)))


def label_mask(labels, pad=0):
    return F.transform(labels, lambda x: (x != pad).cast("int"))


def effective_tokens(ids, pad=0):
    """How many shifted labels count in the loss."""
    return F.size(F.filter(next_token_labels(ids), lambda x: x != pad))


def ends_with(ids, token_id):
    return F.coalesce(F.try_element_at(ids, F.lit(-1)) == token_id, F.lit(False))


def repetition_ratio(ids, n=3):
    """1 - distinct/total n-grams of ids; 0 for fewer than ``n`` ids.

    The grams are joined to strings, which Spark deduplicates with a hash set;
    arrays of arrays would be compared pair by pair.
    """
    last = F.size(ids) - (n - 1)
    grams = F.transform(
        F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(ids, i, F.lit(n)), ",")
    )
    return F.when(last < 1, F.lit(0.0)).otherwise(
        F.lit(1.0) - F.size(F.array_distinct(grams)) / F.size(grams)
    )
