"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores. Every query
runs once on the smallest tables (if they are there) so that the JVM has
compiled its code, then once, timed, on the bench tables with all rows produced.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from tradewind.catalog.queries import registered
from tradewind.plans.session import session

HEADLINE = (
    "sales_summary_history",
    "sales_by_brand_channel",
    "sales_by_brand_channel_history",
    "sales_by_sku_history",
    "marketing_by_segment_history",
    "cac_by_channel_history",
    "customer_mix_history",
    "customer_summary",
    "stock_ledger",
    "inventory_risk_history",
    "detect_sales_decline",
    "all_decisions",
    "threshold_sweep",
    "issue_resolution",
    "top_issues",
    "kpi_trend",
    "executive_summary",
    "snapshot_history",
    "table_invariants",
)


def main() -> None:
    tables = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = sys.argv[1:] or HEADLINE
    spark = session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
            "spark.sql.shuffle.partitions": cpus,
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = registered()

    def run(name: str, path: str) -> float:
        start = time.perf_counter()
        queries[name](spark, path).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    warm = Path(tables).parent / "sf0.001"
    if warm.is_dir():
        for name in chosen:
            run(name, str(warm))
    seconds = {name: round(run(name, tables), 3) for name in chosen}
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(tables).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
