"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose the input and the
cores. Each query is computed in full into a sink that keeps nothing, so the time is Spark's.
Every query runs once to warm up and is then timed.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "vector_topk", "vector_topk_filtered", "vector_topk_lsh", "chunk_tokens", "chunk_sentences", "embed_batched",
    "embed_hashed", "agg_correlation_matrix", "agg_onehot_correlation", "sample_balanced_exact_n",
    "sample_oversample_rare", "split_stratified", "win_row_number", "feat_string_index", "explode_chunks",
    "stream_foreach_batch_append", "rerank_hits", "predict_by_neighbours", "predict_unlabelled_table",
    "ml_centroid_classifier", "ml_text_classifier", "eval_retriever_defaults", "eval_real_vs_synthetic", "clean_text",
]


def run(fn, spark, folder) -> float:
    started = time.perf_counter()
    fn(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    from claimlens.plans.catalog import QUERIES
    from claimlens.session import local_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores=cores, memory="16g", shuffle_partitions=cores)
    times = {}
    for key in HEADLINE:
        run(QUERIES[key], spark, folder)
        times[key] = round(run(QUERIES[key], spark, folder), 3)
        print(f"{key} {times[key]}", file=sys.stderr, flush=True)
    spark.stop()
    total = round(sum(times.values()), 3)
    scale = folder.rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": float(scale) if scale.replace(".", "").isdigit() else scale}))


if __name__ == "__main__":
    main()
