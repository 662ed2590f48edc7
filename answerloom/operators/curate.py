"""Quality rules, best answer per question, and the three-way split."""

from functools import reduce

from pyspark.sql import Window, functions as F

from answerloom.functions.splits import three_way
from answerloom.functions.text import sql_trim

# Fixed value: whole answers that only say thanks or report success.
SHORT_THANKS = r"\A(thanks!?|thank you!?|solved!?|works!?|works now!?|nvm|fixed)\z"
LONGEST_THANKS = 10
# Fixed value: how a missing score ranks when the best answer is chosen.
NO_SCORE_RANK = -1_000_000


def _body():
    return F.coalesce(F.col("answer_body"), F.lit(""))


def min_score(k):
    return F.coalesce(F.col("answer_score"), F.lit(0)) >= k


def min_chars(k):
    return F.length(_body()) >= k


def min_words(k):
    """At least ``k`` runs of ASCII letters, digits, underscores; stops reading at the k-th."""
    return _body().rlike(rf"\A[^A-Za-z0-9_]*+(?:[A-Za-z0-9_]++[^A-Za-z0-9_]*+){{{max(k, 0)}}}")


def is_short_thanks():
    text = sql_trim(_body())
    return (F.length(text) <= LONGEST_THANKS) & F.lower(text).rlike(SHORT_THANKS)


def quality(score=1, chars=40, words=8, drop_short_thanks=False):
    """All quality rules as one predicate."""
    rules = [min_score(score), min_chars(chars), min_words(words)]
    if drop_short_thanks:
        rules.append(~is_short_thanks())
    return reduce(lambda a, b: a & b, rules)


def best_answer(pairs):
    """The top answer per question: score, then length, then smallest answer id.

    ``row_number() = 1`` lets Spark keep one row per question and map task
    before the shuffle, so a hot question does not collect its answers anywhere.
    """
    order = Window.partitionBy("question_id").orderBy(
        F.coalesce("answer_score", F.lit(NO_SCORE_RANK)).desc(),
        F.length(_body()).desc(),
        F.col("answer_id").asc(),
    )
    return pairs.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def curate(pairs, score=1, chars=40, words=8, drop_short_thanks=False, best_only=False):
    """Best answer first, quality second: a question whose top answer fails is gone."""
    source = best_answer(pairs) if best_only else pairs
    return source.where(quality(score, chars, words, drop_short_thanks))


def split_pairs(pairs, val_fraction=0.10, test_fraction=0.05):
    """One ``split`` column in one pass; rows without a question id fall out."""
    split = three_way(F.col("question_id"), val_fraction, test_fraction)
    return pairs.where(F.col("question_id").isNotNull()).withColumn("split", split)


def split_counts(df):
    return df.groupBy("split").agg(F.count("*").alias("rows"))
