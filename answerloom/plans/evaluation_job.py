"""Answers to a report: token ids, scores, figures and records in one job."""

from pyspark.sql import functions as F

from answerloom.operators.encode import encoder
from answerloom.operators.evaluation import eval_records, report_figures, score_answers
from answerloom.session import cut_lineage
from answerloom.sources.reports import write_report


def evaluate(records, model, out, settings, eos="<eos>", grounded=True):
    """Score ``(category, prompt, output)`` rows on the model's own token ids and write the report.

    Prompt and generated token counts, trigram repetition and the end flag come
    from the ids; texts are encoded once. Returns the scored rows.
    """
    encode = encoder(records.sparkSession, model)
    ids = records.withColumns({"prompt_ids": encode(F.col("prompt")), "out_ids": encode(F.col("output"))})
    scored = cut_lineage(score_answers(ids), "scored")
    eos_id = model.token_id(eos)
    ended = scored.withColumn("ended_with_eos", F.coalesce(F.try_element_at("out_ids", F.lit(-1)) == eos_id, F.lit(False)))
    write_report(eval_records(ended, grounded=grounded), report_figures(ended), out, settings)
    return ended
