"""Times the headline queries and prints one line of JSON.

Reads BENCH_SF_DIR (default /root/testdata/sf0.1) on local[BENCH_CPUS]. The queries are the workflow of one comparison, in its
order: a round starts without any stage table, and a query finds those that the queries before it in the round have written,
as the workflow's steps do with files. So a stage counts for the first query that needs it, and the sum is the time of the
whole workflow. The first query runs once to warm up; a query's time is its median of BENCH_RUNS rounds (default 3).
"""

import json
import os
import statistics
import time

from weftline.plans import queries as Q
from weftline.session import local_session

HEADLINE = ("contacts", "dist_stats", "link_mark", "remap_groups", "lift_rows", "metric_pbad", "metric_spearman", "hist_percentile", "matrix_log2ratio", "cool_pixels")


def main() -> None:
    sf_dir, cpus, runs = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(cpus, 8)
    make, took = Q.comparison, {name: [] for name in HEADLINE}
    for name in HEADLINE[:1]:
        Q.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    for _ in range(runs):
        kept: dict = {}
        Q.comparison = lambda spark, sf_dir, model="raw": kept.setdefault(model, make(spark, sf_dir, model))  # noqa: B023
        for name in HEADLINE:
            began = time.perf_counter()
            Q.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took[name].append(time.perf_counter() - began)
    times = {name: round(statistics.median(x), 3) for name, x in took.items()}
    print(json.dumps({"metric": "headline_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
