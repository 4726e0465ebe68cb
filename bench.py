"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from repoatlas.plans.queries import QUERIES
from repoatlas.sources import corpora

HEADLINE = (
    "content_hash",
    "path_filter",
    "changed_files",
    "status_summary",
    "module_combined_hash",
    "extract_includes",
    "symbol_line_ranges",
    "file_structures",
    "resolve_imports",
    "edges_distinct",
    "dependency_graph",
    "module_prompts",
)


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("repoatlas-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="repoatlas-bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    seconds = {}

    def timed(name, run):
        start = time.perf_counter()
        run()
        seconds[name] = round(time.perf_counter() - start, 3)

    # The rendered source trees are the input of most queries; timed on their own.
    timed("render_corpus", lambda: corpora.star_corpus(spark, sf_dir))
    timed("render_state", lambda: corpora.star_state(spark, sf_dir))
    for name in HEADLINE:
        timed(
            name,
            lambda: QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save(),
        )
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
