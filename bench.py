"""Headline queries at one scale: prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [query …]

Each query is run once after a small warm-up of the JVM and Python workers and
its result is written to the ``noop`` sink, so every row is computed.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "t1_tokens",
    "t2_ngrams",
    "t7_tfidf",
    "p1_pattern_counts",
    "x1_x8_structure_documents",
    "n5_transform_vectors",
    "d4_projection",
    "k1_k3_cosine_counts",
    "k2_k3_euclidean_counts",
    "k3_tfidf_cosine",
    "k3_embeddings_cosine",
    "v8_base_classification",
    "v9_a4_a5_enhanced_predictions",
    "b4_smote",
    "e5_stratified_splits",
    "e14_effectiveness_grid",
    "e20_comparison",
    "e13_refit_per_split",
    "e16_sweep_eps",
]


def session(cpus: str):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tremolo-bench")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", str(2 * int(cpus)))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    from tremolo.plans.queries import QUERIES, flagship

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    small = Path(sf_dir).parent / "sf0.001"
    flagship(spark, str(small if small.exists() else sf_dir)).collect()

    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    spark.stop()
    line = {
        "metric": "total_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": Path(sf_dir).name.removeprefix("sf"),
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
