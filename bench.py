"""Headline queries, timed: python bench.py (BENCH_SF_DIR, BENCH_CPUS)."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgerlight import catalog  # noqa: E402
from ledgerlight.session import build_session  # noqa: E402

HEADLINE = [
    "b01_clean_trades", "c10_asof_forward", "c13_nearest_event", "c14_nearest_sector_event", "c16_peer_cluster",
    "c18_nearest_bills", "d05_most_flagged_people", "d12_weekly_clusters", "d14_calibration", "d26_transition_cube",
    "f01_leaderboard", "i01_alpha_calibration", "i07_features_v2", "i09_infer_fund_trades", "i12_forest_fit",
    "i13_forest_score", "j05_daily_digests", "a15_upsert", "h28_trades_from_text", "i08_baseline_features", "i14_dual_score",
    "j01_trade_dossiers", "j03_evidence_packets",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("ledgerlight-bench", **{
        "spark.master": f"local[{cpus}]", "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
    })
    spark.sparkContext.setLogLevel("ERROR")
    catalog.QUERIES["b01_clean_trades"](spark, folder).write.format("noop").mode("overwrite").save()  # untimed: starts the workers
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
