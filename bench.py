"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (tables, default the sf0.1 set) and BENCH_CPUS (local cores).
One query warms up the session on the smallest tables. Each query is then timed to completion with
every row produced and none kept.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "active_value_by_payment_type",
    "latest_state_per_month",
    "every_month_since_start",
    "carry_forward_amounts",
    "retention_by_mandate_age",
    "rolling_24_month_cash",
    "mark_deceased",
    "file_size_actuals",
    "crossed_giving",
    "cash_gift_facts",
    "monthly_metrics",
    "ytd_results",
    "widened_history",
    "active_gift_value_by_group",
    "pack_requests_vs_target",
    "faith_groups_vs_target",
]


def main() -> None:
    from checks.queries import REGISTERED
    from checks.session import local_session
    from givetide.sources.warehouse import release

    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus)
    run = lambda name, where: REGISTERED[name](spark, where).write.format("noop").mode("overwrite").save()
    smallest = str(Path(directory).parent / "sf0.001")
    warm = smallest if Path(smallest).is_dir() else directory
    run("active_value_by_payment_type", warm)
    times = {}
    for name in names:
        started = time.perf_counter()
        run(name, directory)
        times[name] = round(time.perf_counter() - started, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline query seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": Path(directory).name.removeprefix("sf"),
            }
        )
    )
    release(spark)
    spark.stop()


if __name__ == "__main__":
    main()
