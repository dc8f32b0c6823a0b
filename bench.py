"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` (default ``/root/testdata/sf0.1``) and ``BENCH_CPUS`` (default 8) choose data and cores.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from checks.registry import all_queries

HEADLINE = (
    "sproc_load_15min", "cpu_load", "db_size_trend", "bgwriter_stats", "weekly_load_report", "blocked_counts",
    "top_sprocs_by_total", "export_top_by_runtime", "release_regressions", "top_statements", "statement_heavy_hitters",
    "top_tables", "table_regressions", "index_series", "duplicate_indexes", "table_bloat", "unused_schemas",
    "prune_locks", "persistent_waits", "blocking_report_daily", "hourly_sproc_summary", "daily_host_summary",
    "sproc_hourly_alerts", "table_daily_alerts_per_host", "shard_differences", "metric_avg_query_runtime_per_db",
    "metric_db_general_info", "metric_sproc_details_per_schema_sproc", "metric_table_io_details", "export_points_db_size",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()

    def run(name: str) -> float:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    run(HEADLINE[0])  # start the JVM's code paths before timing
    times = {name: round(run(name), 3) for name in HEADLINE}
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
