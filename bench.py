"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the data folder and ``BENCH_CPUS`` the local cores. One untimed run
of a small query starts the JVM and the code generator before the clock starts.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from stratiform.plans import all_queries
from stratiform.session import get_session

HEADLINE = (
    "gold_payroll_mass",
    "gold_headcount",
    "gold_by_organisation",
    "gold_by_service",
    "gold_category_totals",
    "gold_generic",
    "gold_exact_median",
    "gold_monthly_evolution",
    "panel_summary",
    "quality_null_rate",
    "quality_null_by_year",
    "quality_duplicates",
    "duplicate_keys_top",
    "quality_distribution",
    "quality_outliers",
    "silver_clean",
    "silver_sql",
    "silver_dropna",
    "silver_dedupe_all",
    "silver_dedupe_key",
    "parse_fr_decimal",
    "normalize_category",
    "normalize_label",
    "enrich_codes",
    "match_rates",
    "join_sheets",
    "schema_drift",
    "ingest_workbooks",
    "scan_csv_strings",
    "scan_partitioned",
    "ingest_incremental",
    "version_commit",
    "version_diff",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(
        "bench",
        f"local[{cpus}]",
        spark__driver__memory=os.environ.get("BENCH_DRIVER_MEMORY", "8g"),
        spark__sql__shuffle__partitions=cpus,
        spark__ui__showConsoleProgress="false",
        spark__checkpoint__dir=tempfile.mkdtemp(prefix="bench-"),
        spark__sql__warehouse__dir=tempfile.mkdtemp(prefix="bench-warehouse-"),
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries().QUERIES
    chosen = [name for name in os.environ.get("BENCH_QUERIES", "").split(",") if name] or HEADLINE
    queries["gold_category_totals"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in chosen:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds.values()), 3)
    report = {
        "metric": "headline_queries_total",
        "value": total,
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(report))
    spark.stop()


if __name__ == "__main__":
    main()
