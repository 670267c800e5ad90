"""Times the headline queries: one JSON line. BENCH_SF_DIR names the tables' folder, BENCH_CPUS the number of cores."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from codeloom.plans import QUERIES

HEADLINE = ["hubs_customer_part", "pagerank_nation_trade", "related_nations", "symbol_rank", "token_digest", "find_symbol", "bm25_documents", "bm25_rank_fusion", "content_search", "features", "transitive_dependents", "callers_closure", "route_table", "route_match", "resolve_path", "snapshot_diff"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.sql.autoBroadcastJoinThreshold", "32m").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1 << 20).selectExpr("sum(id)").collect()  # the JVM's first job
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
