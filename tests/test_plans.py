"""Plan-shape regressions: the physical plans keep their scale properties."""

import re
import tempfile

import pytest

from adpulse.operators import reports, silver
from adpulse.plans.queries import QUERIES, Layers
from tests.conftest import SF_SMALL


def _plan(df) -> str:
    """The formatted physical plan (untruncated scan details)."""
    import contextlib
    import io

    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


@pytest.fixture(scope="module")
def layers(spark):
    return Layers(spark, SF_SMALL)


def test_dedup_limits_before_the_shuffle(layers):
    p = _plan(silver.dedup_latest(layers.src["bronze_ads_performance"]))
    tree = p.split("\n\n")[0]                                              # the operator tree, root first
    assert tree.find("WindowGroupLimit") < tree.find("Exchange") < tree.rfind("WindowGroupLimit")
    assert "row_number(), 1, Partial" in p and "row_number(), 1, Final" in p


def test_distinct_campaign_count_has_no_expand(layers):
    assert "Expand" not in _plan(layers.gold("gold_channel_daily"))


def test_no_single_partition_window_or_cross_join(spark):
    for name in ["channel_revenue_share", "dq_zscore", "dq_suite", "headline_kpis", "campaign_drilldown"]:
        p = _plan(QUERIES[name](spark, SF_SMALL))
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name
        windows = re.findall(r"\(\d+\) Window\nInput \[.*?\]\nArguments: (.*)", p)
        assert all("], [], [" not in w for w in windows), name             # no window without partition keys


def test_report_window_reaches_the_scan(spark, layers):
    from adpulse.sources.warehouse import Warehouse
    wh = Warehouse(spark, "plans_t", tempfile.mkdtemp(prefix="adpulse-plans-") + "/wh")
    wh.replace("gold_campaign_daily", layers.gold("gold_campaign_daily"), sort_by=["date", "campaign_id", "channel"])
    cd = wh.read("gold_campaign_daily")
    p = _plan(reports.top_campaigns(cd, reports.default_filters(cd, channels=["Google Ads", "TikTok Ads"])))
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(date", p)
    assert re.search(r"PushedFilters: \[[^\]]*In\(channel", p)
    assert re.search(r"ReadSchema: struct<date:date,campaign_id:string,campaign_name:string,channel:string,"
                     r"total_impressions:bigint,total_clicks:bigint,total_spend:double,total_conversions:bigint,"
                     r"total_revenue:double>", p)                          # avg_* columns are pruned


def test_window_check_sees_windows(spark):
    p = _plan(QUERIES["dq_suite"](spark, SF_SMALL))
    windows = re.findall(r"\(\d+\) Window\nInput \[.*?\]\nArguments: (.*)", p)
    assert windows and all("row_number()" in w for w in windows)          # the dedup window is found and keyed


def test_sessionless_events_skip_the_join(layers):
    p = _plan(layers.silver_ga)
    assert "Union" in p and ("SortMergeJoin" in p or "BroadcastHashJoin" in p)
    assert "partial_count" in p                                            # session sizes combine map-side


def test_building_a_plan_starts_no_job(spark):
    """Beyond reading file schemas, a lazy query runs nothing until it is asked for rows."""
    from pyspark.sql import functions as F
    src = {k: v for k, v in Layers(spark, SF_SMALL).src.items()}
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("build", "plan only")
    silver.transform_ads(src["bronze_ads_performance"], src["bronze_campaigns"], src["bronze_adgroups"]).groupBy("channel").agg(F.sum("spend"))
    silver.transform_events(src["bronze_ga_events"])
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert list(tracker.getJobIdsForGroup("build")) == []


def test_hot_session_is_spread_over_tasks(spark):
    """80 % of the events in one session: the joins still deal its rows out evenly."""
    from pyspark.sql import functions as F
    n = 20000
    ev = spark.range(n).select(
        F.lit("2024-01-01").cast("date").alias("date"), (F.col("id") % 24).cast("int").alias("hour"), F.lit("click").alias("event_name"),
        F.when(F.col("id") % 5 != 0, "HOT").otherwise(F.concat(F.lit("S"), F.col("id").cast("string"))).alias("session_id"),
        F.col("id").cast("string").alias("user_id"), F.lit("/").alias("page"), F.lit(None).cast("string").alias("source"),
        F.lit(None).cast("string").alias("medium"), F.lit(None).cast("string").alias("campaign_id"))
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        out = silver.transform_events(ev)
        sizes = [r[1] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert max(sizes) < 0.3 * n and out.where("is_bounce").count() == n // 5
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
