"""Time the headline queries. Prints one JSON line.

Each query starts from a fresh workspace, so fitting a model counts towards the query that
needs it, and its whole result is produced (noop sink).
"""

from __future__ import annotations

import json
import os
import sys
import time

from basketlab.plans.catalog import QUERIES
from basketlab.plans.workspace import Workspace
from basketlab.session import build

HEADLINE = [
    "clean_orders_global",
    "profile_describe",
    "rfm_scaled",
    "segment_stats",
    "user_aisle_counts",
    "cluster_top_sold",
    "cluster_aisle_top_products",
    "order_history",
    "assoc_rules_department",
    "assoc_rules_aisle",
    "cluster_assoc_rules",
    "rule_metrics",
    "ranking_metrics",
    "triggered_rules",
    "mba_recommendations",
    "user_aisle_products",
    "combined_recommendations",
    "svd_metrics_rank10",
    "svd_recommend_aisles",
    "cluster_svd_metrics",
    "tfidf_weights",
    "search_products",
    "document_search",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("OFF")
    spark.read.parquet(f"{folder}/lineitem.parquet").selectExpr("sum(l_orderkey)").collect()
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        space = Workspace(spark, folder)
        QUERIES[name](space).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        space.close()
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
