"""Times the registered queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default: all) set input and cores;
names given as arguments restrict the queries. Each query runs twice and the second, warm run
counts. Every row is produced and dropped by the no-op sink, so nothing is fetched to the driver.
"""

from __future__ import annotations

import json
import os
import sys
import time

from lakesteward.plans.queries import QUERIES
from lakesteward.session import build_session


def timed(spark, query, sf_dir: str) -> float:
    start = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        {
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
            "spark.ui.enabled": "false",
            "spark.log.level": "ERROR",
        },
    )
    chosen = {n: q for n, q in QUERIES.items() if not sys.argv[1:] or any(n.startswith(a) for a in sys.argv[1:])}
    seconds = {}
    for name, query in chosen.items():
        cold = timed(spark, query, sf_dir)
        seconds[name] = round(timed(spark, query, sf_dir), 3)
        print(f"{name}: cold {cold:.2f} s, warm {seconds[name]:.2f} s", file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_warm_query_time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")),
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
