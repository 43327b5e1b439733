"""Headline-query benchmark: prints ONE JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma list, default the registered headline set).
Each query is executed in full with the no-op sink (no driver collect), once
cold and once warm; ``value`` is the sum of the cold runs.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from postlens.plans.catalog import HEADLINE, QUERIES  # noqa: E402
from postlens.session import local_session  # noqa: E402

EXTRA = ["first_disclosure_chunked", "tf_idf", "cluster_extremes", "median_post", "hist2d_users"]


def run(spark, key, sf_dir):
    t = time.time()
    QUERIES[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return round(time.time() - t, 3)


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    keys = [k for k in os.environ.get("BENCH_QUERIES", "").split(",") if k] or (HEADLINE + EXTRA)
    spark = local_session(cores=cpus, shuffle_partitions=cpus * 2, driver_memory="16g")
    cold, warm = {}, {}
    for k in keys:
        cold[k] = run(spark, k, sf_dir)
        warm[k] = run(spark, k, sf_dir)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_total_cold", "value": round(sum(cold.values()), 3), "unit": "sec",
                      "queries": cold, "queries_warm": warm, "sf": sf, "cores": cpus,
                      "shuffle_partitions": cpus * 2}))


if __name__ == "__main__":
    main()
