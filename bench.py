"""Times the headline queries on ``$BENCH_SF_DIR`` and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from registry.queries import QUERIES  # noqa: E402

HEADLINE = (
    "knn_topn",            # exact nearest-neighbour join
    "knn_cells",           # the same over many cells and chunks
    "knn_ivf",             # approximate join, clustering included
    "recall_regroup",
    "rank_rounded",        # best candidate over all order lines
    "correct_pick",
    "match_stats",
    "pair_scores",         # two text columns
    "tag17_fields",        # labelled tokens to fields
    "tag_fill_stats",
    "encode_documents",    # text to vectors
    "unvectorized_anti",
    "two_stage_match",     # encode, recall, score, choose
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = tuple(sys.argv[1:]) or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/nation.parquet").count()
    # one untimed run starts the Python workers and compiles the first stages
    QUERIES["encode_text"](spark, folder).count()
    QUERIES["knn_threshold"](spark, folder).count()
    times: dict[str, float] = {}
    for name in chosen:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": Path(folder).name.removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
