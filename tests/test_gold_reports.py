import datetime as dt

import pytest
from pyspark.sql import functions as F

from adpulse.operators import gold, reports
from adpulse.plans.queries import Layers
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def layers(spark):
    return Layers(spark, SF_SMALL)


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_gold_from_rollup_equals_gold_from_silver(layers):
    roll = gold.rollup(layers.silver_ads)
    for name, (build, _) in gold.BUILDERS.items():
        direct = build(gold.measures(layers.silver_ads))
        assert _rows(direct) == _rows(build(roll)), name


def test_channel_daily_distinct_campaigns(layers):
    cd = layers.gold("gold_channel_daily")
    expect = (layers.silver_ads.groupBy("date", "channel")
              .agg(F.count_distinct("campaign_id").alias("n")))
    got = cd.join(expect, ["date", "channel"]).where(F.col("n") != F.col("campaign_count"))
    assert got.count() == 0


CD = ("date date, campaign_id string, campaign_name string, channel string, total_impressions long, "
      "total_clicks long, total_spend double, total_conversions long, total_revenue double")
D1, D2, D3 = dt.date(2024, 1, 1), dt.date(2024, 1, 15), dt.date(2024, 2, 1)


@pytest.fixture()
def camp(df):
    return df([
        (D1, "C1", "One", "Google Ads", 1000, 10, 100.0, 2, 300.0),
        (D2, "C1", "One", "Facebook Ads", 1000, 20, 50.0, 0, 50.0),
        (D3, "C2", "Two", "Google Ads", 500, 5, 0.0, 1, 80.0),
        (D3, None, None, "TikTok Ads", 100, 1, 10.0, 1, 1000.0),      # NULL key: dropped by grouping reports
    ], CD)


def test_filters(camp):
    assert reports.Filters(channels=[]).apply(camp).count() == 0
    assert reports.Filters(channels=None).apply(camp).count() == 4
    assert reports.Filters(date_range=(D1, D2)).apply(camp).count() == 2        # inclusive
    assert reports.Filters(date_range=(D1,)).apply(camp).count() == 4           # one bound: ignored
    assert reports.Filters(campaigns=["C2"]).apply(camp).count() == 1
    start, end = reports.default_window(camp)
    assert reports.Filters(date_range=(start, end)).apply(camp).count() == 3    # [2024-01-02, 2024-02-01]


def test_top_campaigns_drop_null_keys_and_tie_break(camp):
    out = reports.top_campaigns(camp, k=15).collect()
    assert [r.campaign_id for r in out] == ["C1", "C2", "C1"]
    assert out[0].roas == 3.0 and out[1].roas == 0.0          # guarded: spend 0 -> 0


def test_roas_top_nulls_last_and_cpa_lowest(camp):
    roas = reports.campaign_roas_top(camp).collect()
    assert [(r.campaign_id, r.roas) for r in roas] == [("C2", None), ("C1", 2.33)]     # returned lowest first
    cpa = reports.campaign_cpa_lowest(camp).collect()
    assert [(r.campaign_id, r.cpa) for r in cpa] == [("C2", 0.0), ("C1", 75.0)]


def test_headline_counts_missing_id(camp):
    r = reports.headline_kpis(camp).first()
    assert r.active_campaigns == 3 and r.total_revenue == 1430.0 and r.roas_status == "HEALTHY"
    s = reports.campaign_scope_kpis(camp).first()
    assert s.num_campaigns == 2


def test_empty_scope_sums_are_zero(camp):
    r = reports.headline_kpis(camp, reports.Filters(channels=[])).first()
    assert (r.total_revenue, r.total_spend, r.total_conversions, r.roas, r.active_campaigns) == (0.0, 0.0, 0, 0.0, 0)


def test_funnel_and_best(camp):
    f = {r.stage: r for r in reports.funnel_totals(camp).collect()}
    assert f["Impressions"].value == 2600 and f["Clicks"].pct_of_previous == 36 / 2600
    assert f["Conversions"].pct_of_previous == 4 / 36
    assert reports.best_campaign(camp).first().campaign_id == "C1"


def test_shares_sum_to_one(camp):
    ch = camp.withColumnRenamed("campaign_id", "cid")
    shares = [r.share for r in reports.channel_revenue_share(ch).collect()]
    assert abs(sum(shares) - 1.0) < 1e-12


def test_money_below_a_cent_counts(df):
    row = (D1, 1, "C1", "A", "Google Ads", 100, 10, 0.004, 1, 0.006, "One", "Traffic")
    s = df([row] * 1000, "date date, hour int, campaign_id string, adgroup_id string, channel string, impressions long, clicks long, "
                         "spend double, conversions long, revenue double, campaign_name string, objective string")
    r = gold.campaign_daily(gold.measures(s)).first()
    assert (r.total_spend, r.total_revenue, r.avg_roas, r.avg_cpc, r.avg_cpa) == (4.0, 6.0, 1.5, 0.0004, 0.004)
    assert gold.channel_daily(gold.rollup(s)).first().total_spend == 4.0
    assert gold.hourly_trends(gold.measures(s)).first().total_spend == 4.0


def test_every_channel_is_reported(df):
    h = df([(D1, 9, c, 0.5) for c in ("Google Ads", "New Channel")], "date date, hour int, channel string, avg_ctr double")
    assert {r.channel for r in reports.hour_channel_heatmap(h).collect()} == {"Google Ads", "New Channel"}


def test_orders(layers):
    ordered = lambda rows, key: [key(r) for r in rows] == sorted(key(r) for r in rows)
    cd = layers.gold("gold_campaign_daily")
    assert ordered(reports.channel_scorecard(layers.gold("gold_channel_daily")).collect(), lambda r: -r.roas)
    assert ordered(reports.campaign_roas_top(cd).collect(), lambda r: r.roas)
    assert ordered(reports.top_campaigns(cd).collect(), lambda r: -r.total_revenue)
    assert ordered(reports.filter_values(cd).collect(), lambda r: (r.filter_name, r.value or ""))


def test_budget_follows_revenue(df):
    from adpulse.operators import insights
    ch = df([("G", 10.0, 90.0), ("F", 30.0, 10.0), ("T", 0.0, 0.0), (None, 5.0, 5.0)], "channel string, total_spend double, total_revenue double")
    got = {r.channel: (r.suggested_spend, r.shift, r.efficiency_rank) for r in insights.budget_reallocation(ch).collect()}
    assert got == {"G": (36.0, 26.0, 1), "F": (4.0, -26.0, 2), "T": (0.0, 0.0, 3)}


def test_heatmap_shape(df):
    h = df([(D1, 9, "Google Ads", 0.5), (D2, 9, "Google Ads", 0.25), (D1, 23, "TikTok Ads", 0.1)],
           "date date, hour int, channel string, avg_ctr double")
    out = {r.channel: r for r in reports.hour_channel_heatmap(h).collect()}
    assert out["Google Ads"].h09 == 0.375 and out["Google Ads"].h23 is None
    assert out["TikTok Ads"].h23 == 0.1
    assert len(reports.hour_channel_heatmap(h).columns) == 25
