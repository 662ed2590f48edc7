"""From raw documents to packed training sequences: the stages, in order, and one call for all."""

import public_tokenizers

from answerloom.llm.decontamination import drop_leaks
from answerloom.llm.packing import pack_documents
from answerloom.llm.secret_scan import redact_secrets
from answerloom.llm.string_kernel import drop_toxic, learn
from answerloom.llm.superminhash import drop_near_duplicates
from answerloom.session import work_dir


def toxicity(spark, docs, sf_dir):
    """Documents that score 0.7 or more go; the classifier learns from labelled ones of this input."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return drop_toxic(docs, learn(docs, labels))


def near_dedup(spark, docs, sf_dir):
    """One document of each group of near copies (five-word shingles, similarity 0.8) stays."""
    return drop_near_duplicates(docs, k=5, percent=80)


def decontamination(spark, docs, sf_dir):
    """Documents that hold a benchmark passage go."""
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark, docs, sf_dir):
    """All documents stay; their secrets are blotted out, and n_chars is made to fit."""
    return redact_secrets(docs)


def packing(spark, docs, sf_dir):
    """The token pieces of the remaining documents, placed in sequences of 2048."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination),
    ("secret_scan", secret_scan), ("packing", packing),
]

#: The first stage fits a classifier, which SQL cannot express.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The rows of the last stage; every stage is written and the next one reads the files."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = work_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
