"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import time

from tidelog.plans import QUERIES
from tidelog.session import get_session

HEADLINE = [
    "production_balance",   # readings -> deployments -> day/night -> daily balance -> monthly means
    "scan_cp932_logger",    # foreign-encoded files with preambles
    "join_interval_semi",
    "join_full_chain",
    "minute_stats",
    "daily_dose",
    "monthly_se_band",
    "complete_groups",
    "box_stats",
    "subtract_group_min",
    "oxygen_slope",         # smooth every site-depth-day and take its slope
    "seasonal_by_site",
    "seasonal_predict",
    "nested_f_test",
    "contrasts_all_pairs",
    "nls_by_site_f",
    "nls_by_day_safe",
    "robust_pooled_curve",
    "curve_draws",
    "draws_hdi",
    "draws_rhat",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus,
        "spark.ui.enabled": "false",
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "6g"),
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").count().collect()  # start the JVM side
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    found = re.search(r"sf([0-9.]+)$", sf_dir)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": float(found.group(1)) if found else None,
    }))


if __name__ == "__main__":
    main()
