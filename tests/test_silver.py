import datetime as dt

from adpulse.operators import silver

ADS = ("date date, hour int, campaign_id string, adgroup_id string, channel string, impressions long, "
       "clicks long, spend double, conversions long, revenue double, _load_seq long")
D = dt.date(2024, 1, 5)


def test_dedup_keeps_latest_and_breaks_ties_on_measures(df):
    rows = [
        (D, 1, "C1", "C1_AG00", "Google Ads", 100, 5, 2.0, 1, 9.0, 1),
        (D, 1, "C1", "C1_AG00", "Google Ads", 200, 6, 3.0, 1, 8.0, 2),   # newest -> kept
        (D, 2, "C1", "C1_AG00", "Google Ads", 50, 1, 1.0, 0, 0.0, 7),    # tie on recency
        (D, 2, "C1", "C1_AG00", "Google Ads", 60, 1, 1.0, 0, 0.0, 7),    # larger measures win
    ]
    out = silver.dedup_latest(df(rows, ADS)).orderBy("hour").collect()
    assert [(r.hour, r.impressions) for r in out] == [(1, 200), (2, 60)]


def test_dedup_null_fills_measures(df):
    rows = [(D, 3, "C1", "C1_AG00", "TikTok Ads", None, None, None, None, None, 1)]
    r = silver.dedup_latest(df(rows, ADS)).first()
    assert (r.impressions, r.clicks, r.spend, r.conversions, r.revenue) == (0, 0, 0.0, 0, 0.0)


def test_kpis_zero_and_negative_denominators(df):
    rows = [
        (D, 1, "C", "A", "G", 0, 0, 0.0, 0, 0.0, 1),
        (D, 2, "C", "A", "G", 1000, 10, -5.0, 0, 20.0, 1),
        (D, 3, "C", "A", "G", 1000, 10, 5.0, 2, 20.0, 1),
    ]
    out = silver.with_kpis(silver.dedup_latest(df(rows, ADS))).orderBy("hour").collect()
    assert [(r.ctr, r.cpc, r.cpa, r.roas, r.conversion_rate) for r in out] == [
        (0.0, 0.0, 0.0, 0.0, 0.0),
        (0.01, -0.5, 0.0, 0.0, 0.0),
        (0.01, 0.5, 2.5, 4.0, 0.2),
    ]


def test_enrich_left_joins_and_orphans(df):
    ads = df([(D, 1, "C1", "C1_AG00", "G", 10, 1, 1.0, 0, 0.0, 1),
              (D, 1, "C9", "C9_AG99", "G", 10, 1, 1.0, 0, 0.0, 1)], ADS)
    camps = df([("C1", "Campaign 1", "Traffic", 100.0)], "campaign_id string, campaign_name string, objective string, budget_daily double")
    ags = df([("C1_AG00", "C1", "AdGroup_00", "Interest", "Manual CPC")],
             "adgroup_id string, campaign_id string, adgroup_name string, targeting_type string, bid_strategy string")
    out = {r.campaign_id: r for r in silver.transform_ads(ads, camps, ags).collect()}
    assert out["C1"].campaign_name == "Campaign 1" and out["C1"].adgroup_name == "AdGroup_00"
    assert out["C9"].campaign_name is None and out["C9"].bid_strategy is None
    assert list(silver.transform_ads(ads, camps, ags).columns) == silver.SILVER_ADS_COLUMNS


def test_duplicate_dimension_key_fans_out(df):
    ads = df([(D, 1, "C1", "C1_AG00", "G", 10, 1, 1.0, 0, 0.0, 1)], ADS)
    camps = df([("C1", "A", "Traffic", 1.0), ("C1", "B", "Traffic", 1.0)],
               "campaign_id string, campaign_name string, objective string, budget_daily double")
    ags = df([], "adgroup_id string, campaign_id string, adgroup_name string, targeting_type string, bid_strategy string")
    assert silver.transform_ads(ads, camps, ags).count() == 2


GA = ("date date, hour int, event_name string, session_id string, user_id string, page string, "
      "source string, medium string, campaign_id string")


def test_events_bounce_and_attribution(df):
    rows = [
        (D, 1, "page_view", "S1", "U1", "/", None, None, None),          # single-event session -> bounce
        (D, 1, "page_view", "S2", "U2", "/", "google", "cpc", "C1"),
        (D, 2, "purchase", "S2", "U2", "/buy", "google", "cpc", "C1"),
        (D, 3, "login", None, "U3", "/", None, None, None),              # no session -> never a bounce
    ]
    out = silver.transform_events(df(rows, GA)).orderBy("hour", "user_id").collect()
    assert [(r.session_id, r.is_bounce) for r in out] == [("S1", True), ("S2", False), ("S2", False), (None, False)]
    assert (out[0].source, out[0].medium) == ("direct", "(none)")
    assert out[3].event_category == "navigation"
