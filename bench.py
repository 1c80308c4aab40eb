"""Time the headline queries; prints one JSON line.

Every query runs once to warm up and then ``BENCH_PASSES`` times (default 1) into Spark's
``noop`` sink, so all rows and columns are computed; the median is reported. Alongside the
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from shelfmark.plans.queries import QUERIES

HEADLINE = (
    "chunk_fixed", "chunk_token", "chunk_recursive", "chunk_semantic", "compare_chunking",
    "group_sections", "html_blocks", "chunk_structural",
    "hashing_embedding_query", "knn", "ivf_search_query", "pairwise_distance", "search", "hybrid_search", "bm25_corpus",
    "list_documents", "find_by_content_hash", "dedup_in_batch", "upsert_chunks", "variant_store",
    "select_family", "crawl_bfs", "precision_recall", "event_rates", "window_percentiles",
    "stream_ingest", "stream_sessions",
)
CHUNKERS = ("chunk_fixed", "chunk_token", "chunk_recursive", "chunk_semantic")


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("shelfmark-bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    return spark


def run(spark: SparkSession, name: str, sf_dir: str) -> float:
    started = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    passes = int(os.environ.get("BENCH_PASSES", "1"))
    names = sys.argv[1:] or HEADLINE
    spark = session(cpus)
    times: dict[str, float] = {}
    for name in names:
        run(spark, name, sf_dir)
        times[name] = round(statistics.median(run(spark, name, sf_dir) for _ in range(passes)), 3)
        print(f"{name:26s} {times[name]:8.3f}", file=sys.stderr, flush=True)
    rates = {
        name: round(QUERIES[name](spark, sf_dir).count() / times[name]) for name in CHUNKERS if name in times
    }
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "chunks_per_sec": rates,
        "sf": float(os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")), "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
