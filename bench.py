"""Headline queries on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]``; prints one JSON line.

Each query is warmed up once on the same data, then timed to a full evaluation of
every output column (no-op sink). Queries over a stored queue run on the queue that
``queue_build`` (inspection and search index) and ``queue_by_path`` store, which are timed as entries of their own.
"""

from __future__ import annotations

import json
import os
import time
from pathlib import Path

from folioflow.operators import queue, report, search
from folioflow.plans.queries import NEEDLE, QUERIES
from folioflow.session import local_session, scratch_dir
from folioflow.sources import corpus

HEADLINE = (
    "text_normalize",
    "fingerprints",
    "pii_scan",
    "template_match",
    "extraction_fields",
    "document_intelligence",
    "inspection_routing",
    "duplicates",
    "review_state",
    "report_summary",
    "ocr_rollup",
    "stream_pii",
)


class StoredQueue:
    """Builds a queue, then searches, exports and merges it."""

    def build(self, spark, sf_dir: str) -> None:
        self.root = scratch_dir(spark, "bench-queue")
        search.store(corpus.queue(spark, sf_dir), self.root)

    def by_path(self, spark, sf_dir: str) -> None:
        self.bucketed = queue.by_path(corpus.light_queue(spark, sf_dir, 0, 1))

    def search(self, spark, sf_dir: str):
        return search.search(spark, self.root, NEEDLE).selectExpr("path", "status", "review.status as review_status")

    def csv(self, spark, sf_dir: str):
        return report.csv_lines(spark.read.parquet(f"{self.root}/rows"))

    def merge(self, spark, sf_dir: str):
        return queue.merge(self.bucketed, corpus.light_queue(spark, sf_dir, 0, 2).drop("review"))


def timed(query, spark, sf_dir: str) -> float:
    start = time.perf_counter()
    rows = query(spark, sf_dir)
    if rows is not None:
        rows.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    stored = StoredQueue()
    steps = {name: QUERIES[name] for name in HEADLINE} | {
        "queue_build": stored.build, "queue_search": stored.search, "queue_csv": stored.csv, "queue_by_path": stored.by_path, "queue_merge": stored.merge
    }
    for name, query in steps.items():
        timed(query, spark, sf_dir)
        seconds[name] = round(timed(query, spark, sf_dir), 3)
    result = {
        "metric": "headline queries, total of warm runs",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": Path(sf_dir).name.removeprefix("sf"),
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
