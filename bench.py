"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["param_count", "topk", "join_group_agg", "join_filter_count", "join_chain3", "group_multi_agg", "group_multi_key", "row_number", "order_multi_key", "union_distinct", "count_distinct", "analyze_stats", "upsert_result", "update_from_result", "delete_using_result", "vector_l2_topk", "vector_cosine_topk", "bm25_rank", "bm25_english", "bm25_postings", "dialect_mysql_limit"]


def main() -> None:
    from pyspark.sql import SparkSession

    from skein.plans.catalogue import QUERIES

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("bench")
    settings = {"spark.driver.memory": "8g", "spark.sql.shuffle.partitions": cpus, "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    taken = {}
    for name in HEADLINE:
        run = lambda: QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()  # noqa: B023, E731
        run()  # compiles the plan's code
        times = []
        for _ in range(2):
            began = time.perf_counter()
            run()
            times.append(time.perf_counter() - began)
        taken[name] = round(min(times), 4)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(taken.values()), 4), "unit": "sec", "queries": taken, "sf": sf_dir.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
