"""Times the headline queries; prints one JSON line.

`BENCH_SF_DIR` names the table folder, `BENCH_CPUS` the cores. Each query runs once to warm up the
code paths it uses, then once timed, written to a sink that takes every row.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from paylens.plans.registered import QUERIES
from paylens.session import local_session

HEADLINE = (
    "top_transactions_desc",
    "recurring_payments",
    "duplicate_payments",
    "frequent_small_payments",
    "price_rise",
    "amount_bounds",
    "dataset_period",
    "normalize_documents",
    "blank_text_audit",
    "validate_statement_valid",
    "validate_statement_rejects",
    "statement_load",
    "duplicate_ids",
    "letter_vectors",
    "encoded_texts",
    "vector_upsert",
    "knn_cosine_top20",
    "knn_texts_top20",
    "similar_by_id",
    "similar_by_name",
    "similarity_facts",
    "display_recurring",
    "route_questions",
    "parse_replies",
    "validate_params",
)


def run(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    seconds, cold = {}, {}
    for name in HEADLINE:
        cold[name] = round(run(spark, name, sf_dir), 3)
        seconds[name] = round(run(spark, name, sf_dir), 3)
    print(
        json.dumps(
            {
                "metric": "total_time_of_headline_queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "cold": cold,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
