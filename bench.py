"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

HEADLINE = [
    "prom_sum_by_rate", "prom_topk_sum_rate", "prom_count_by", "prom_quantile_over_time", "prom_subquery", "prom_histogram_quantile", "prom_match_group_left", "log_volume_by_level", "log_line_contains", "log_logfmt", "log_parsed_filter", "log_json", "log_unwrap_quantile",
    "trace_search", "trace_rate_by", "trace_child", "trace_quantile", "rollup_minutes", "rollup_hours_increase", "err_issues",
]


def main() -> None:
    where = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    root = str(Path(__file__).resolve().parent)
    sys.path.insert(0, root)
    os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [root, os.environ.get("PYTHONPATH")]))
    from pyspark.sql import SparkSession

    from skein.queries import QUERIES

    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    QUERIES["prom_instant_latest"](spark, where).count()  # starts the session
    took = {}
    for name in HEADLINE:
        runs = []
        for _ in range(2):
            began = time.perf_counter()
            QUERIES[name](spark, where).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        took[name] = round(min(runs), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": where.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
