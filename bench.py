"""Times the headline queries at ``BENCH_SF_DIR`` on ``local[BENCH_CPUS]`` and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from marlstone.plans.queries import QUERIES
from marlstone.session import local_session

HEADLINE = (
    "lexical_bm25_topk", "dense_topk_exact", "rrf_fusion", "rerank_movement", "final_selection", "gate_decision", "retrieval_metrics",
    "expand_union", "graph_score", "classify_partition", "concept_mentions_topn", "html_sections", "page_spans", "chunk_token_stats",
    "event_fold", "lineage_path_join", "top_lines_per_order", "upsert_latest",
)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
