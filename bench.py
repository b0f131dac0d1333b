"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from hazardframe.catalog import all_queries

HEADLINE = [
    "w3_daily_codes", "r9_fire_weather", "r7_idw", "r1_seed_cells", "r3_blocked_zone", "w8_growth_rings", "j22_diff_grids",
    "j3_within_distance", "j10_snap_to_nodes", "j5_cut_edges", "r4_exposure", "r14_reconstruct_arrival", "a8_pooled_metrics",
    "g2_cell_components", "g7_boundary_rings", "r6_evacuate",
    "f27_contract_outcome", "a50_comparison_table", "a29_discordance", "f19_numeric_traceability", "t7_blind",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.time()
        all_queries()[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
