"""Reductions over training losses."""

from pyspark.sql import functions as F

from answerloom.functions.ids import effective_tokens


def mean_perplexity(losses, max_batches=None):
    """Mean of batch means over the first batches, and its exponential; (0, 1) if empty."""
    kept = losses if max_batches is None else losses.where(F.col("batch_id") < max_batches)
    mean = F.coalesce(F.avg("loss"), F.lit(0.0))
    return kept.agg(mean.alias("val_loss"), F.exp(mean).alias("val_ppl"))


def masked_means(token_losses, *keys, pad=0):
    """Mean loss over tokens whose label is not the pad id, per key."""
    counted = F.col("label") != pad
    total = F.sum(F.when(counted, F.col("loss")).otherwise(0.0))
    n = F.sum(counted.cast("long"))
    return token_losses.groupBy(*keys).agg(
        (total / F.greatest(n, F.lit(1))).alias("loss"), n.alias("tokens")
    )


def token_totals(rows, *keys, pad=0):
    """Rows and loss-relevant tokens per key."""
    return rows.groupBy(*keys).agg(
        F.count("*").alias("rows"), F.sum(effective_tokens(F.col("input_ids"), pad)).alias("tokens")
    )


def logged_losses(losses, every, run="run_id"):
    """Mean of the last ``every`` losses at each step divisible by ``every``.

    Steps of a run are consecutive, so these losses are exactly one block of
    steps: a plain aggregation with partial sums, no window over a whole run.
    """
    block = F.ceil(F.col("step") / every)
    return (
        losses.groupBy(run, block.alias("_block"))
        .agg(F.max("step").alias("step"), F.avg("loss").alias("train_loss"))
        .where(F.col("step") % every == 0)
        .select(run, "step", "train_loss", F.exp("train_loss").alias("train_ppl"))
    )
