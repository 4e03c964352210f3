"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from ragspark.plans.queries import QUERIES  # noqa: E402
from ragspark.session import build_session, discard, ship_package  # noqa: E402

HEADLINE = {
    "input_verdict": "validate_documents",
    "pii_masking": "pii_masked_all",
    "top_k": "topk_l2",
    "semantic_chunks": "semantic_chunks_percentile",
    "text_analysis": "text_analysis",
    "rate_limit": "rate_limit",
    "ttl_reuse": "ttl_reuse",
    "toxicity": "toxicity_any",
    "recursive_chunks": "recursive_chunks",
    "document_retrieval": "document_retrieval",
    "retrieval_eval": "retrieval_eval",
    "output_verdict": "validate_output",
    "number_stats": "number_stats",
    "word_frequency": "word_frequency",
}


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    ship_package()
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "ragspark.documents.partitions": str(2 * int(cpus)),
            "spark.driver.memory": "12g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["language_mix"](spark, folder).write.format("noop").mode("overwrite").save()
    took = {}
    for job, name in HEADLINE.items():
        start = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[job] = round(time.time() - start, 3)
        print(job, took[job], file=sys.stderr)
    print(
        json.dumps(
            {
                "metric": "total wall time of headline queries",
                "value": round(sum(took.values()), 3),
                "unit": "sec",
                "queries": took,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    discard(spark)
    spark.stop()


if __name__ == "__main__":
    main()
