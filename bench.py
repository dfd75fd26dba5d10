"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from checks.catalog import QUERIES  # noqa: E402
from checks.compare import local_session  # noqa: E402

HEADLINES = (
    "clean_questions",
    "with_prompts",
    "split_questions",
    "parse_answers",
    "pending",
    "response_summary",
    "build_routing_table",
    "letter_bias",
    "stratified_sample",
    "random_split",
    "group_folds",
    "length_router",
    "char_grams",
    "gram_counts",
    "tfidf_router",
    "embedding_router",
    "mean_pool",
    "ranked",
    "ranked_split",
    "accuracy_curve",
    "evaluate_orders",
    "evaluate_by_subject",
    "evaluate_routers",
    "auroc",
    "exact_quantiles",
    "bootstrap_apgr_large",
    "mark_decisions",
    "subject_failures",
    "worst_examples",
    "route_batch",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    QUERIES["subject_counts"](spark, sf).collect()  # start-up is not part of any query
    seconds = {}
    for name in sys.argv[1:] or HEADLINES:
        started = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        spark.catalog.clearCache()
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": Path(sf).name}))
    spark.stop()


if __name__ == "__main__":
    main()
