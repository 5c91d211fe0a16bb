"""Headline queries, timed. Prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from vereda import session
from vereda.plans import catalog

HEADLINE = (
    "vec_cosine_topk", "vec_topk_per_label_then_global", "vec_min_dist_per_key_join", "trgm_name_lookup", "bm25_topk",
    "hybrid_rrf", "rerank_overlap", "chunk_word_window_clean", "chunk_char_window", "html_text", "html_links", "guard_chain",
    "rule_classify", "view_entity_arrays", "view_scalar_subquery", "view_filtered_counts", "two_step_projects",
    "dedup_richest", "duplicate_keys", "reconcile_ids", "ops_summary", "ops_mttr", "cache_exact", "eval_mrr")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = session.local(cpus, memory=os.environ.get("BENCH_MEMORY", "12g"))
    spark.sparkContext.setLogLevel("ERROR")
    # The first job pays for class loading and the Python worker pool.
    catalog.QUERIES["vec_cosine_topk"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    took = {}
    for name in HEADLINE:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
                      "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
