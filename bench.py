"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from answerloom.plans.catalog import QUERIES  # noqa: E402
from answerloom.session import build_session  # noqa: E402

HEADLINE = [
    "qa_pairs", "curated_split", "best_answer", "wide_fanout_join", "best_line_per_order",
    "standard_text", "pretoken_counts", "bpe_merges", "encode_texts", "tokenize_split",
    "epoch_batches", "rolling_loss", "masked_loss", "answer_grades", "report_figures",
    "passages", "nearest_vectors", "nearest_in_cells", "nearest_passages", "stream_pairs",
    "corpus_job",
]


def run(spark, name, sf_dir):
    """Seconds to build and fully execute one query (rows are produced, not collected)."""
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(f"local[{cpus}]", "bench", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g",
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    # Compile and load once, outside the timings: every query at the smallest scale.
    warm = str(Path(sf_dir).with_name("sf0.001"))
    for name in names:
        run(spark, name, warm if Path(warm).is_dir() else sf_dir)
    times = {name: round(run(spark, name, sf_dir), 3) for name in names}
    spark.stop()
    print(json.dumps({
        "metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": Path(sf_dir).name.removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
