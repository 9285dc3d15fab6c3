"""Times the headline queries and prints one JSON line.

A session is warmed up by one untimed run of each query; each figure is the
median of three further runs that read their input and produce every row.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import catalogue
from pageloom.session import local_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
RUNS = int(os.environ.get("BENCH_RUNS", "3"))

# The full run (capture to export table), its parts, and one query per family.
HEADLINE = (
    "markdown_export",
    "markdown",
    "cleaned_html",
    "select_main_text",
    "title",
    "links",
    "normalize_url",
    "slugify_path",
    "same_scope",
    "robots_allowed",
    "last_write_wins",
    "pages_per_domain",
    "distinct_content",
    "diff_status",
    "sitemap_harvest",
    "bfs_depth",
    "drop_number_runs",
    "render_json",
    "domain_partition",
    "export_tree",
    "harvest_routes",
    "crawl_shared",
    "page_number",
    "stream_diff_export",
)


def run(spark, name: str) -> float:
    start = time.perf_counter()
    rows = catalogue.QUERIES[name](spark, SF_DIR)
    rows.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    spark = local_session(CPUS, partitions=CPUS)
    names = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in names:
        run(spark, name)
        seconds[name] = round(statistics.median(run(spark, name) for _ in range(RUNS)), 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet").count()
    result = {
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
        "cpus": CPUS,
        "pages": pages,
        "pages_per_sec": {
            name: round(pages / seconds[name])
            for name in ("markdown_export", "markdown", "normalize_url")
            if name in seconds
        },
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
