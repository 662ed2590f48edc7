"""Answer scores, report figures, arm comparison and training losses."""

from pyspark.sql import functions as F

from answerloom.functions import rubric
from answerloom.operators import evaluation as ev, training_metrics as tm
from answerloom.plans import fixtures as fx
from answerloom.plans.catalog.registry import RECORDS, SCORED, figures_sql, query, scored_sql

GRADES = ", ".join(ev.GRADES)


def _scored(spark, d):
    return ev.score_answers(fx.eval_records(spark, d))


@query(f"""WITH {SCORED} SELECT rec_id, round(overlap, 6) AS overlap_ratio, round(rep, 6) AS repetition_ratio,
has_steps, has_code, CAST(word_count AS INTEGER) AS word_count, template_noise_flag FROM scored""")
def answer_signals(spark, d):
    return _scored(spark, d).select(
        "rec_id", F.round("overlap_ratio", 6).alias("overlap_ratio"),
        F.round("repetition_ratio", 6).alias("repetition_ratio"), "has_steps", "has_code",
        "word_count", "template_noise_flag",
    )


@query(f"WITH {SCORED} SELECT rec_id, {GRADES} FROM scored")
def answer_grades(spark, d):
    return _scored(spark, d).select("rec_id", *ev.GRADES)


@query(f"""WITH {SCORED} SELECT rec_id, array_to_string(list_sort(pk), ' ') AS keywords,
CAST(len(pk) AS INTEGER) AS n_keywords, CAST(len(list_intersect(pk, ak)) AS INTEGER) AS n_shared FROM scored""")
def keyword_sets(spark, d):
    wanted, used = rubric.keywords(F.col("prompt")), rubric.keywords(F.col("answer"))
    return _scored(spark, d).select(
        "rec_id", F.array_join(F.array_sort(wanted), " ").alias("keywords"),
        F.size(wanted).alias("n_keywords"),
        F.size(F.array_intersect(wanted, used)).alias("n_shared"),
    )


@query(f"WITH {SCORED} {figures_sql('scored')}")
def report_figures(spark, d):
    return ev.report_figures(_scored(spark, d))


@query(f"WITH {SCORED} {figures_sql('scored', 'category')}")
def report_by_category(spark, d):
    return ev.report_figures(_scored(spark, d), "category")


_ARMS = SCORED + """, rag_records AS (SELECT rec_id, category, question, prompt,
  question || chr(10) || output AS output, ended_with_eos FROM records), """ + scored_sql(
    "rag_records", "rag"
)


def _arms(spark, d):
    base = fx.eval_records(spark, d)
    question = F.substring_index(F.regexp_replace("prompt", r"\A<bos> Question:\n", ""), "\n<sep> Answer:\n", 1)
    output = F.concat(question, F.lit("\n"), F.col("output"))
    grounded = base.withColumn("output", output).withColumn(
        "out_ids", F.transform(F.split("output", " "), F.length)
    )
    return ev.score_answers(base), ev.score_answers(grounded)


@query(f"""WITH {_ARMS} SELECT rec_id, b.auto_total_0_10 AS base_auto_total_0_10,
r.auto_total_0_10 AS rag_auto_total_0_10, r.auto_total_0_10 - b.auto_total_0_10 AS delta_auto_total_0_10
FROM scored b FULL JOIN rag r USING (rec_id)""")
def arm_comparison(spark, d):
    """Base answers against answers that repeat their question, record by record."""
    base, rag = _arms(spark, d)
    return ev.pair_arms(base, rag, "rec_id")


@query(f"""WITH {_ARMS}, b AS ({figures_sql('scored', 'category')}), r AS ({figures_sql('rag', 'category')})
SELECT category, b.num_prompts AS base_num_prompts, b.avg_auto_total_0_10 AS base_avg_auto_total_0_10,
b.eos_end_rate AS base_eos_end_rate, b.template_noise_rate AS base_template_noise_rate,
r.num_prompts AS rag_num_prompts, r.avg_auto_total_0_10 AS rag_avg_auto_total_0_10,
r.eos_end_rate AS rag_eos_end_rate, r.template_noise_rate AS rag_template_noise_rate,
round_even(r.avg_auto_total_0_10 - b.avg_auto_total_0_10, 4) AS delta_avg_auto
FROM b FULL JOIN r USING (category)""")
def arm_report(spark, d):
    return ev.arm_report(*_arms(spark, d))


_LOSSES = """losses AS (SELECT event_type AS run_id, value / 100 AS loss,
  row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS step FROM events)"""


@query(f"""WITH {_LOSSES}, rolled AS (SELECT run_id, step, avg(loss) OVER (PARTITION BY run_id ORDER BY step
  ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS m FROM losses)
SELECT run_id, CAST(step AS BIGINT) AS step, round(m, 6) AS train_loss, round(exp(m), 6) AS train_ppl
FROM rolled WHERE step % 20 = 0""")
def rolling_loss(spark, d):
    logged = tm.logged_losses(fx.losses(spark, d), 20)
    return logged.select(
        "run_id", "step", F.round("train_loss", 6).alias("train_loss"),
        F.round("train_ppl", 6).alias("train_ppl"),
    )


_BATCH = """batch AS (SELECT l_orderkey AS batch_id,
  sum(CASE WHEN l_linenumber <> 1 THEN l_discount ELSE 0 END)
    / greatest(sum(CAST(l_linenumber <> 1 AS BIGINT)), 1) AS loss,
  CAST(sum(CAST(l_linenumber <> 1 AS BIGINT)) AS BIGINT) AS tokens FROM lineitem GROUP BY l_orderkey)"""


@query(f"WITH {_BATCH} SELECT batch_id, round(loss, 6) AS loss, tokens FROM batch")
def masked_loss(spark, d):
    means = tm.masked_means(fx.token_losses(spark, d), "batch_id", pad=1)
    return means.select("batch_id", F.round("loss", 6).alias("loss"), "tokens")


@query(f"""WITH {_BATCH} SELECT round(coalesce(avg(loss), 0), 6) AS val_loss,
round(exp(coalesce(avg(loss), 0)), 6) AS val_ppl FROM batch WHERE batch_id < 200""")
def mean_perplexity(spark, d):
    """Mean of batch means over the first 200 batches (the evaluation's batch limit)."""
    means = tm.masked_means(fx.token_losses(spark, d), "batch_id", pad=1)
    return tm.mean_perplexity(means, 200).select(
        F.round("val_loss", 6).alias("val_loss"), F.round("val_ppl", 6).alias("val_ppl")
    )
