"""Time the headline queries and print one JSON line.

BENCH_SF_DIR   tables to read (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default 4)
BENCH_ONLY     comma-separated names, to time a few

Results are computed in full and thrown away, so no time goes to showing rows.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from catalog import all_queries  # noqa: E402
from tableprobe.session import local_session  # noqa: E402

HEADLINE = (
    "read_parquet",
    "sanitize_tokens",
    "promote_numeric",
    "sanitize",
    "overview",
    "missing_summary",
    "duplicate_summary_wide",
    "outliers_iqr",
    "outliers_zscore",
    "numeric_statistics",
    "categorical_statistics",
    "column_health",
    "flag_outliers",
    "correlation_matrix",
    "target_correlations",
    "group_means",
    "feature_importance",
    "histogram",
    "grouped_box_stats",
    "top_n_values",
    "filter_range",
    "filter_time_range",
    "stack_tables",
    "asof_join",
    "fill_mean",
    "fill_median",
    "fill_ffill",
    "rolling_mean",
    "rolling_std",
    "resample_5min_sum",
    "resample_day_sum",
    "trend_direction",
    "largest_steps",
    "seasonality_lags",
    "findings",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "4")
    only = [n for n in os.environ.get("BENCH_ONLY", "").split(",") if n]
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="tableprobe-bench")
    queries = all_queries()
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("max(l_tax)").collect()  # start the executor
    seconds = {}
    for name in only or HEADLINE:
        started = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
