"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, os.environ.get("PYTHONPATH")) if x)  # for the workers

HEADLINE = [
    "dense_cosine_topk", "bm25_topk", "hybrid_fusion", "rerank_topk", "agg_max", "agg_weighted_rank", "ndcg_trec", "metrics_by_k", "chunk_word_window", "chunk_char_window",
    "chunk_recursive", "chunk_character", "table_regions", "region_chunks", "query_classify", "smart_sample", "submission_wide", "rollup_mean", "chunked_hybrid_flow",
]


def probe() -> float:
    """Seconds of a fixed piece of work without Spark, so that rounds on different machines compare."""
    began, x = time.time(), 1
    for _ in range(10_000_000):
        x = (x * 48271) % 2147483647
    return round(time.time() - began, 3)


def main() -> None:
    from ragstone.plans import registry
    from ragstone.session import get_session

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = get_session("bench", f"local[{cpus}]", **{"spark_sql_shuffle_partitions": cpus, "spark_driver_memory": "8g", "spark_ui_enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    took, speed = {}, [probe()]
    for name in HEADLINE:
        began = time.time()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
        print(name, took[name], file=sys.stderr, flush=True)
    speed.append(probe())
    spark.stop()
    print(json.dumps({"probe": speed, "metric": "retrieval queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
