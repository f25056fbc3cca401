"""Benchmark: every registered query over the test tables.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query is executed to completion with the ``noop`` sink (all rows are
produced, nothing is collected) after one warm-up pass; the reported time
per query is the median of ``BENCH_REPEAT`` runs.  ``catalogue`` times the
production shape: ``CustomerAnalytics`` aggregates each fact table once,
checkpoints the summaries and the profile, then answers the whole
catalogue from them.  Prints ONE JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)


def _run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]

    from custlens.plans.session import build_session
    from custlens.registry import AS_OF, registry

    spark = build_session("custlens-bench", cpus=cpus, shuffle_partitions=cpus * 2,
                          checkpoint_dir=tempfile.mkdtemp(prefix="custlens-bench-"))
    qs = registry()

    for name in sorted(qs):  # warm-up: JIT, file listing caches
        _run(qs[name](spark, sf_dir))

    times: dict[str, float] = {}
    for name in sorted(qs):
        runs = []
        for _ in range(repeat):
            t0 = time.perf_counter()
            _run(qs[name](spark, sf_dir))
            runs.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(runs), 4)

    # production shape: every question from one set of shared, checkpointed
    # per-customer summaries and one checkpointed profile (CustomerAnalytics)
    from custlens.analytics import CustomerAnalytics
    from custlens.sources import testmap

    def catalogue(ca):
        yield from (ca.customer_list(), ca.customers_by_country(), ca.customers_by_channel(),
                    ca.customer_transactions(), ca.revenue_by_category(), ca.revenue_by_payment_method(),
                    ca.monthly_revenue(), ca.customer_engagement(), ca.device_usage(), ca.customer_conversion(),
                    ca.rfm_rules(), ca.churn_by_inactivity(), ca.clv_three_year(), ca.cohort_retention(),
                    ca.segment_performance(), ca.channel_effectiveness(), ca.top_customers(), ca.top_products(),
                    ca.value_comparison(), ca.recently_active(), ca.business_kpis(), ca.customer_growth(),
                    ca.purchase_frequency_by_category(), ca.avg_spend_by_segment(), ca.inactive_customers())
        yield ca.profile
        yield from ca.reports().values()
        yield from (ca.executive_summary(), ca.custom_summary(), ca.key_statistics(), ca.top_by_spend(),
                    ca.at_risk(), ca.segment_engagement())
        for name in ("shape_and_columns", "describe", "spending_categories", "segment_summary",
                     "segment_by_churn_pivot", "top_by_clv", "spend_percentiles", "rfm_quintiles",
                     "health_scores", "churn_signals", "pareto", "top_share", "channel_roi",
                     "retention_by_tenure"):
            yield ca.tutorial(name)
        for name in ("customers_by_segment", "churn_distribution", "value_segment_counts",
                     "spend_frequency_points", "recency_histogram", "engagement_by_segment",
                     "clv_box_stats", "conversion_by_channel", "transaction_histogram", "revenue_by_segment"):
            yield ca.chart(name)

    catalogue_runs, n_outputs = [], 0
    for _ in range(repeat):
        t0 = time.perf_counter()
        C, T, E = testmap.load(spark, sf_dir)
        ca = CustomerAnalytics(C, T, E, AS_OF)
        n_outputs = 0
        for df in catalogue(ca):
            _run(df)
            n_outputs += 1
        ca.close()
        catalogue_runs.append(time.perf_counter() - t0)

    total = round(sum(times.values()), 3)
    print(json.dumps({
        "metric": "sum of median per-query seconds, all registered queries",
        "value": total,
        "unit": "sec",
        "queries": times,
        "catalogue_sec": round(statistics.median(catalogue_runs), 3),
        "catalogue_outputs": n_outputs,
        "n_queries": len(times),
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
