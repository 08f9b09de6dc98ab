"""Wall time of the headline queries: one warm-up, then the median of three runs each; prints one line of JSON."""

from __future__ import annotations

import json
import os
import statistics
import time

from lodestone.plans import catalog
from lodestone.session import local_session

NAMES = ["hybrid_search", "bm25_topk", "dense_topk", "rrf_fusion", "filing_aware_limit", "rank_metrics", "facts_rank_rows", "metric_summary", "filing_distribution", "eval_panel", "session_counts", "section_tree", "trigram_overlap", "tree_descendants", "html_visible_text"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, int(cores) if cores.isdigit() else 8, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in NAMES:
        runs = []
        for _ in range(4):
            began = time.time()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - began)
        took[name] = round(statistics.median(runs[1:]), 3)
    print(json.dumps({"metric": "total of query medians", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
