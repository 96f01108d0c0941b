"""BASELINE protocol: one rollup at 4, 16 and 64 shuffle partitions, with the
facts planned from the star tables, read from the written facts table, and
persisted in memory. The planned runs come first: once a plan is persisted,
Spark serves every equal plan from the cache.

    python scripts/sweep_partitions.py [sf_dir]
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from quotaflow.operators import aggregate_by  # noqa: E402
from quotaflow.plans.catalog import facts, facts_plan  # noqa: E402
from quotaflow.session import local_session  # noqa: E402


def _median(fn, reps=3):
    fn()
    out = []
    for _ in range(reps):
        t0 = time.perf_counter()
        fn()
        out.append(time.perf_counter() - t0)
    return round(statistics.median(out), 3)


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), extra={"spark.ui.showConsoleProgress": "false"})
    base = facts_plan(spark, sf_dir)
    table = facts(spark, sf_dir)
    run = lambda df: aggregate_by(df, "sales_team").write.format("noop").mode("overwrite").save()
    result = {p: {} for p in (4, 16, 64)}
    for source, df in (("from_star_tables", base), ("facts_table", table)):
        for parts in result:
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            result[parts][source] = _median(lambda: run(df))
    cached = base.persist()
    cached.count()
    for parts in result:
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        result[parts]["persisted_facts"] = _median(lambda: run(cached))
    print(json.dumps({"query": "aggregate_by(sales_team)", "sf_dir": sf_dir, "sec": result}))


if __name__ == "__main__":
    main()
