"""Benchmark the headline queries.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query is executed end to end into Spark's `noop` sink (the whole plan
runs, nothing is collected on the driver).  Before timing, every headline
query runs once on the sf0.001 tables (JVM and code-generation warm-up);
cached intermediates are dropped before each timed query so no query profits
from another's work.  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from newslens.plans.queries import QUERIES  # noqa: E402
from newslens.session import build_session  # noqa: E402

HEADLINE = [
    "y1_article_keywords",
    "y2_block_keywords",
    "j1_pair_similarity",
    "y4_hotness",
    "y3_related_articles",
    "y5_hot_news_report",
    "a1_word_count",
    "a4_hour_grid",
    "w3_word_history",
    "y8_ingest_pages",
    "j7_link_depth",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    only = sys.argv[1:] or HEADLINE
    spark = build_session("newslens-bench", f"local[{cpus}]", cpus * 4,
                          extra={"spark.driver.memory": "16g",
                                 "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32m"})
    warm_dir = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm_dir):
        for name in only:
            QUERIES[name](spark, warm_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in only:
        spark.catalog.clearCache()
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    spark.stop()
    sf = os.path.basename(os.path.normpath(sf_dir)).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
