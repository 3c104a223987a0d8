"""Times the headline queries at $BENCH_SF_DIR and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from tessera.queries import QUERIES

HEADLINE = ["s1_vector_search", "s6_fulltext", "s9_search", "s17_grep", "s18_fuzzy_grep", "t1_hop", "t3_expand", "t7_hierarchy", "a8_upsert", "a9_upsert_edges", "i4_apply_diff", "i7_needs_embedding", "g2_group_by", "g3_change_statistics", "f9_chunks_fixed", "w6_budget_cut", "v4_turns", "e7_merge_tags", "c1_change_records", "r1_coalesce"]


def main() -> None:
    d, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{d}/orders.parquet").groupBy("o_orderstatus").count().collect()
    took = {}
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, d).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(d.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
