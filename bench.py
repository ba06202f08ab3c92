"""Benchmark: prints ONE JSON line with per-query seconds.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Three groups, all over the whole input tables:
  * ``pipeline_full``: bronze -> silver -> gold -> 28 checks into a fresh
    warehouse (the reference's full-mode run, writes included);
  * layer transforms from the driver tables, executed to a no-op sink
    (full plan, nothing collected);
  * dashboard reports over the materialized gold tables (the reference's
    "dashboard query"), collected.
"""

from __future__ import annotations

import datetime as dt
import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")

    from pyspark.sql import functions as F

    from adpulse.operators import quality, reports
    from adpulse.plans import pipeline
    from adpulse.plans.queries import AS_OF, QUERIES, Layers
    from adpulse.session import local_session, scratch_path
    from adpulse.sources.adapters import driver_sources
    from adpulse.sources.warehouse import Warehouse

    spark = local_session(cores=cpus, shuffle_partitions=int(cpus), app="adpulse-bench", scratch=True)
    times: dict[str, float] = {}

    def timed(name, fn):
        t = time.perf_counter()
        fn()
        times[name] = round(time.perf_counter() - t, 3)

    # Warm-up (JVM, codegen caches) on the smallest tables; not timed.
    Layers(spark, "/root/testdata/sf0.001").gold("gold_channel_daily").collect()

    path = scratch_path(spark, "bench")
    wh = Warehouse(spark, database=os.path.basename(path).replace("-", "_"), location=path, grain="month")
    timed("pipeline_full", lambda: pipeline.run_full(wh, driver_sources(spark, sf_dir), batch_id="bench", as_of=AS_OF))

    def noop(name):
        return lambda: QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()

    for name in ["silver_ads_kpis", "silver_ga_events", "gold_campaign_daily", "gold_channel_daily",
                 "gold_hourly_trends", "gold_funnel_summary"]:
        timed(name, noop(name))

    cd, ch, hr = wh.read("gold_campaign_daily"), wh.read("gold_channel_daily"), wh.read("gold_hourly_trends")
    window = None

    def opening():
        nonlocal window
        window = reports.default_filters(cd)

    timed("report_default_window", opening)
    dash = {
        "headline_kpis": lambda: reports.headline_kpis(cd, window),
        "daily_channel_revenue": lambda: reports.daily_channel_revenue(ch, window),
        "channel_revenue_share": lambda: reports.channel_revenue_share(ch, window),
        "daily_spend_vs_revenue": lambda: reports.daily_spend_vs_revenue(ch, window),
        "top_campaigns": lambda: reports.top_campaigns(cd, window),
        "campaign_channel_revenue": lambda: reports.campaign_channel_revenue(cd, window),
        "campaign_roas_top": lambda: reports.campaign_roas_top(cd, window),
        "campaign_cpa_lowest": lambda: reports.campaign_cpa_lowest(cd, window),
        "best_campaign": lambda: reports.best_campaign(cd, window),
        "funnel_totals": lambda: reports.funnel_totals(cd, window),
        "campaign_drilldown": lambda: reports.campaign_drilldown(cd, window),
        "campaign_scope_kpis": lambda: reports.campaign_scope_kpis(cd, window),
        "channel_scorecard": lambda: reports.channel_scorecard(ch, window),
        "hour_channel_heatmap": lambda: reports.hour_channel_heatmap(hr, reports.Filters()),
        "headline_kpis_all_dates": lambda: reports.headline_kpis(cd),
    }
    for name, build in dash.items():
        timed(f"report_{name}", lambda b=build: b().collect())

    src = driver_sources(spark, sf_dir)
    last = cd.agg(F.max("date")).first()[0]
    timed("incremental_one_day", lambda: pipeline.run_incremental(wh, src, last, batch_id="bench_day", as_of=AS_OF))
    timed("backfill_60_days", lambda: pipeline.backfill(wh, src, last - dt.timedelta(days=59), last, batch_id="bench_fill", as_of=AS_OF))
    timed("dq_suite", lambda: quality.run_checks(pipeline.audited_tables(wh), batch_id="bench2", as_of=AS_OF).collect())

    total = round(sum(times.values()), 3)
    report_total = round(sum(v for k, v in times.items() if k.startswith("report_")), 3)
    print(json.dumps({
        "metric": "total_sec",
        "value": total,
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""),
        "cpus": int(cpus),
        "dashboard_reports_sec": report_total,
        "rows": {"lineitem_ads": wh.row_count("bronze_ads_performance"), "events": wh.row_count("bronze_ga_events")},
    }))


if __name__ == "__main__":
    main()
