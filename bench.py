"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; one JSON line.

Every query runs to completion into a sink that discards the rows. The number per
query is the faster of two runs, so that JVM warm-up is not counted.
"""

from __future__ import annotations

import json
import os
import sys
import time

from basket_engine.catalog import QUERIES
from basket_engine.session import local_session

HEADLINE = (
    "basket_features", "basket_share", "basket_share_smoothed", "membership_filter", "risk_encoded", "user_softmax",
    "index_lookup", "multi_hot_label", "multi_hot_label_running", "packed_vector", "packed_vector_user", "slot_vector",
    "item_values", "month_axis", "recent_rows_matrix", "subtract_rows", "purge", "top_k_items", "score_items",
    "grouped_table", "tokens", "vocabulary_filter", "text_sequences", "text_masks", "embed_tokens", "balanced_order",
    "minibatch_split", "vector_mean", "examples_round_trip", "fit_softmax", "fit_linear",
)


def run(spark, name: str, sf_dir: str) -> float:
    began = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in names:
        times[name] = round(min(run(spark, name, sf_dir) for _ in range(2)), 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": times, "sf": float(sf)}))
    spark.stop()


if __name__ == "__main__":
    main()
