"""Headline benchmark: runs the main operators on $BENCH_SF_DIR with
local[$BENCH_CPUS] and prints one JSON line with per-query seconds."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tablight.plans import registry  # noqa: E402
from tablight.session import get_spark  # noqa: E402

HEADLINE = [
    "a01_bar_sum",            # flagship: top-5 group aggregate
    "p01_profile",            # one-pass profile of lineitem
    "a16_box",                # exact grouped quartiles
    "a23_auto_summary",       # all (dimension, metric) top-k in one job
    "a07_trend_year",         # calendar trend with empty periods
    "k05_kpi_trend",          # distributed row index half-split
    "t05_spearman",           # rank correlation matrix
    "t07_kruskal",            # rank test with ties
    "t08_posthoc",            # pairwise rank tests
    "t10_chi_square",         # contingency test
    "f07_backtest",           # monthly series + OLS backtest
    "j01_auto_join",          # name-matched left join
    "r12_retain",             # TTL + newest-k per key
    "c08_davies_bouldin",     # scaled features + centroid quality
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    os.environ["BENCH_CPUS"] = cpus
    spark = get_spark(master=f"local[{cpus}]")
    qs = registry.queries()
    # warm-up: JVM, Python workers and file listing
    qs["a02_count_bar"](spark, sf_dir).collect()
    times = {}
    for name in HEADLINE:
        t0 = time.time()
        qs[name](spark, sf_dir).collect()
        times[name] = round(time.time() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
