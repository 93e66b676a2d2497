"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line with seconds per query."""
from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from panelspark.queries import QUERIES
from panelspark.session import build_session

HEADLINE = (
    "J2_densify", "W2_roll_mean", "W5_cs_rank_pct", "W7_roll_beta", "W11_cross_asset_features", "W20_regime_exposure", "W21_book_walk_impact",
    "A12_rank_ic", "A15_cross_sectional_median", "T1_liquidity_schedule", "F7_target_weights", "F11_long_short_spread", "D1_verify_panel",
    "V6_pbo_cscv", "V8_bootstrap_ci", "V13_lead_lag_study", "V14_cpcv_report", "S2_read_daily_bars", "ST3_tick_bars",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8,
        **{"spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    noop = lambda df: df.write.format("noop").mode("overwrite").save()
    noop(QUERIES["W2_roll_mean"](spark, sf_dir))  # start-up and code generation stay out of the figures
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        noop(QUERIES[name](spark, sf_dir))
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": sf_dir.rsplit("sf", 1)[-1].strip("/")}))


if __name__ == "__main__":
    main()
