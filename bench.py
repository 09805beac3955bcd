"""Benchmark: runs the headline queries and prints one JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma list, default the headline set).
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["exposure_index_by_group", "area_summary", "adoption_fill", "opportunity_v2", "sector_rollup",
            "sector_top5", "transition_matrix", "job_rank", "recommendations"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [q for q in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if q]
    from workrisk.session import build_session
    scratch = tempfile.mkdtemp(prefix="bench-", dir=os.environ.get("WORKRISK_SCRATCH", "/tmp"))
    spark = build_session(f"local[{cpus}]", int(cpus) * 2,
                          extra={"spark.checkpoint.dir": os.path.join(scratch, "ckpt")})
    from workrisk.plans.catalog import all_queries
    qs = all_queries()
    spark.range(1000).count()  # session warm-up only (JVM start); no query work is done here
    times: dict[str, float] = {}
    rows: dict[str, int] = {}
    for name in names:
        t0 = time.time()
        df = qs[name].build(spark, sf_dir)
        rows[name] = df.count()
        times[name] = round(time.time() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "rows": rows, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
