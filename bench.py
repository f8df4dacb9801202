"""Headline timings, one JSON line.

    BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8)

One short query warms the JVM. Each query then runs on the small tables (BENCH_SMALL_DIR, its
first run, code generation included) and on the large ones.
Results go to Spark's no-op sink, so every row is produced and nothing is collected.
"""

from __future__ import annotations

import json
import os
import time

import check
from limpid.catalog.queries import queries

HEADLINE = (
    "audit_table", "cleaned_table", "clean_types", "convert_dates", "clean_whitespace",
    "drop_duplicates", "fill_missing", "clip_outliers", "profile_missing", "profile_categorical",
    "format_anomalies", "describe_numeric", "profile_outliers", "correlation_matrix",
    "duplicate_count", "row_quality", "kde_grid", "infer_schema", "scan_csv",
)


def timed(query, spark, folder: str) -> float:
    start = time.perf_counter()
    query(spark, folder).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def peak_mb(spark) -> int:
    """Most memory that the JVM's pools held at once, each at its own peak."""
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getMemoryPoolMXBeans()
    return round(sum(b.getPeakUsage().getUsed() for b in beans) / 1e6)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    small = os.environ.get("BENCH_SMALL_DIR", "/root/testdata/sf0.01")
    spark = check.session(os.environ.get("BENCH_CPUS", "8"))
    registered = queries()
    registered["profile_missing"](spark, folder).count()
    cold, warm = {}, {}
    for name in HEADLINE:
        # The first run, on the small tables, pays for code generation; the second does not.
        cold[name] = timed(registered[name], spark, small)
        warm[name] = timed(registered[name], spark, folder)
    orders = spark.read.parquet(f"{folder}/orders.parquet").count()
    print(
        json.dumps(
            {
                "metric": "headline queries, total",
                "value": round(sum(warm.values()), 3),
                "unit": "sec",
                "queries": warm,
                "sf": os.path.basename(folder.rstrip("/")),
                "first_run_small": {"sf": os.path.basename(small.rstrip("/")), "queries": cold},
                "rows_per_sec": {"cleaned_table": round(orders / warm["cleaned_table"])},
                "peak_jvm_mb": peak_mb(spark),
            }
        )
    )


if __name__ == "__main__":
    main()
