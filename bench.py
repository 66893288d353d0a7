"""Times headline queries; prints one JSON line. Settings: BENCH_SF_DIR, BENCH_CPUS, BENCH_QUERIES (comma-separated)."""

from __future__ import annotations

import json
import os
import pathlib
import re
import sys
import time

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent))

from tallyglass.catalog import QUERIES  # noqa: E402
from tallyglass.session import local_session  # noqa: E402

HEADLINE = """
numeric_profile distinct_stats duplicate_count quality_score iqr_outliers categorical_profile schema_report kpi_cards
histogram value_breakdown box_stats qq_plot histogram_grid treemap sankey value_matrix stacked_area bar_race
resample resample_weekly rolling_average bin_equal_width bin_quantile rank_average rank_whole_table scale_zscore
rolling_mean rolling_whole_table pct_of_group lag_column kmeans pca_project top_n cohort percentile_bands
correlation_matrix linear_regression group_stats anova partial_correlation filter_combined filter_metrics group_agg_mean
semantic_search near_duplicates cluster_representatives standardize similar_rows_cosine isolation_forest
alert_extreme_outliers alert_correlation alert_trend alert_report_rules
""".split()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = local_session(cpus, "tallyglass-bench")
    seconds = {}
    for name in names:
        runs = []
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(min(runs), 4)
    scale = re.search(r"sf([0-9.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "total warm wall time of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
