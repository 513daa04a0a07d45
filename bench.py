"""Time headline queries from the raw tables; prints one JSON line.

The run starts from the raw Parquet tables without any stage table. As in a research
run, a stage is built once and its cost falls on the first query that needs it. Set
BENCH_COLD=1 to rebuild the whole chain for every query. BENCH_SF_DIR and BENCH_CPUS
choose the data and the cores.
"""

from __future__ import annotations

import json
import os
import time

from catalog.queries import ALL
from catalog.setup import forget
from pairloom.session import local_session

HEADLINE = (
    "s01_daily_bars",
    "d06_d14_validation_report",
    "u03_u04_tradability",
    "p03_p05_p07_p08_p11_pair_statistics",
    "p12_benjamini_hochberg_by_family",
    "p15_selected_pairs",
    "f01_f13_features",
    "m11_m13_forecast_metrics",
    "g06_signals",
    "b12_daily_pnl",
    "a04_a13_backtest_metrics",
    "r03_r06_robustness_results",
    "e09_e10_regime_performance",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "pairloom-bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count().collect()  # start the JVM
    by_name = {q.name: q for q in ALL}
    times = {}
    forget()
    for name in HEADLINE:
        if os.environ.get("BENCH_COLD") == "1":
            forget()
        start = time.perf_counter()
        by_name[name].spark(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "pairs_research_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")),
                      "cold": os.environ.get("BENCH_COLD") == "1"}))


if __name__ == "__main__":
    main()
