"""Headline queries as one pipeline run: a stage table is written once, inside the timing of the query that first
needs it, and read by the later ones, as the jobs of a real run would."""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from pegwatch.plans import catalog  # noqa: E402
from pegwatch.session import forget_stages  # noqa: E402

HEADLINE = (
    "f4_nearest_sample", "k2_deviation", "e5_episodes", "e7_e8_labels", "d11_sensitivity_grid", "d3_dedupe_trades", "d4_hourly_prices",
    "c9_d6_check", "e9_e12_rolling", "b10_c16_onset_table", "e17_e18_escalation", "c13_c14_candidates", "j22_follow_share",
    "d15_b18_market_snapshots", "h1_edges", "d12_d14_token_measures", "j1_average_precision", "f1_top_share", "j8_bootstrap_ap", "j5_events",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "12g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf}/lineitem.parquet").count()
    catalog.QUERIES["e5_episodes"](spark, sf).write.format("noop").mode("overwrite").save()
    times = {}
    forget_stages()
    for name in HEADLINE:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline queries, total wall clock", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": Path(sf).name}))
    spark.stop()


if __name__ == "__main__":
    main()
