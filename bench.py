"""Times the headline queries: one warm-up run (reported as cold) and one measured run each.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Every query runs to the end through the noop sink.  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sparkdemand.operators import models  # noqa: E402
from sparkdemand.plans import catalog, model_queries  # noqa: E402
from sparkdemand.session import build_session  # noqa: E402
from sparkdemand.sources import views  # noqa: E402

HEADLINE = [
    "A1_series_by_date",
    "W2_rolling_means_daily",
    "W3_trend_line",
    "A3_period_summaries",
    "A4_by_weekday",
    "A7_K1_top_stores",
    "A8_order_sales_association",
    "A9_promotion_uplift",
    "R2_R7_R9_column_audit",
    "A14_profile_numbers",
    "A17_outlier_thresholds",
    "O3_top_outliers",
    "C8_whole_cleaner",
    "W4_lags_per_store",
    "W5_shifted_rolling_per_store",
    "E5_E6_feature_matrix",
    "T4_levene_promotion",
    "T6_kruskal_wallis_regions",
    "M1_chronological_split",
    "V2_leaderboard",
    "M5_random_forest",
    "M4_M8_ridge_on_store_panel",
    "H3_naive_forecast_all_stores",
    "H3_ridge_forecast_all_stores",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", cpus)
    spark.conf.set(views.PIECES, cpus)  # the given lineitem is one row group
    warm, cold = {}, {}
    for name in HEADLINE:
        for times in (cold, warm):
            t0 = time.time()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - t0, 3)
            spark.catalog.clearCache()
    # Fits alone (with the two predicts that the training times), at default size, on the series of the whole table.
    fits = model_queries._trained(spark, sf_dir, (models.RIDGE, models.FOREST))[0].times
    print(
        json.dumps(
            {
                "metric": "headline_queries_warm_total",
                "value": round(sum(warm.values()), 3),
                "unit": "sec",
                "queries": warm,
                "cold": cold,
                "fit_seconds": {name: round(float(t), 3) for name, t in fits.items()},
                "sf": os.path.basename(sf_dir.rstrip("/")),
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
