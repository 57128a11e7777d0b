"""Headline query timings: prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
The tables that several queries share are built first and timed as ``build_*``.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "bars_daily", "features", "labels", "fold_assign_purged", "universe_vol", "asof_insider", "conviction",
    "pick_momentum", "momentum_ledger", "pick_threshold", "pick_variants", "pick_sticky", "ledger_base", "ledger_ls",
    "ledger_rank", "brake_ledger", "cost_sweep", "null_books", "trials", "auc_by_fold", "score_compare",
    "stability_monthly", "bootstrap_ci", "deflated_sharpe", "iv_panel", "value_report", "reconcile_picks",
    "grade_picks", "stream_grade", "wide_labels", "wide_momentum_ledger", "wide_ledger_base", "wide_null_books",
    "wide_auc_by_fold", "wide_score_compare",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from panelspark.plans import queries as q
    from panelspark.session import build_session
    from panelspark.sources import fixtures

    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    steps = {
        "build_bars": lambda: [f(spark, sf_dir, p) for f in (fixtures.bars, fixtures.market) for p in ("day", "week")],
        "build_panel": lambda: fixtures.panel(spark, sf_dir),
        "build_scores": lambda: fixtures.scores(spark, sf_dir),
    }
    times: dict[str, float] = {}
    for name, step in steps.items():
        start = time.time()
        step()
        times[name] = round(time.time() - start, 3)
    only = [n for n in os.environ.get("BENCH_ONLY", "").split(",") if n]
    for name in only or HEADLINE:
        start = time.time()
        q.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": Path(sf_dir).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
