import datetime as dt

from adpulse.operators import insights

D = dt.date(2024, 1, 1)


def test_trailing_average_uses_calendar_days(df):
    # 10 rows on each of days 0..29, then 2 rows on day 30 (a drop), nothing on day 31, 10 on day 45.
    rows = [(D + dt.timedelta(days=i),) for i in range(30) for _ in range(10)]
    rows += [(D + dt.timedelta(days=30),)] * 2 + [(D + dt.timedelta(days=45),)] * 10
    out = {r.date: r for r in insights.volume_vs_trailing_avg(df(rows, "date date"), "t").collect()}
    assert out[D].trailing_avg is None and out[D].is_drop is False
    d30 = out[D + dt.timedelta(days=30)]
    assert (d30.trailing_avg, d30.ratio, d30.is_drop) == (10.0, 0.2, True)
    d45 = out[D + dt.timedelta(days=45)]     # frame = days 15..44: 15 days of 10 and day 30's 2
    assert d45.trailing_avg == (15 * 10 + 2) / 16 and d45.is_drop is False


def test_hourly_spikes(df):
    rows = [(D, h, "G", 10) for h in range(24)] + [(D + dt.timedelta(days=1), h, "G", 10) for h in range(23)]
    rows += [(D + dt.timedelta(days=1), 23, "G", 1000)]
    out = insights.hourly_spikes(df(rows, "date date, hour int, channel string, clicks long")).collect()
    spikes = [(r.date, r.hour) for r in out if r.is_spike]
    assert spikes == [(D + dt.timedelta(days=1), 23)]
    flat = insights.hourly_spikes(df([(D, 1, "T", 5), (D, 2, "T", 5)], "date date, hour int, channel string, clicks long"))
    assert [r.zscore for r in flat.collect()] == [None, None]       # zero spread: no score, no spike


def test_attribution_gap(df):
    rows = [("google", "cpc", "C1"), ("google", "cpc", None), ("direct", "(none)", None), ("tiktok", "cpc", "C2")]
    out = {r.source: r for r in insights.attribution_gap(df(rows, "source string, medium string, campaign_id string")).collect()}
    assert set(out) == {"google", "tiktok"}
    assert (out["google"].paid_events, out["google"].unattributed_events, out["google"].gap_share) == (2, 1, 0.5)


def test_peak_hours(df):
    rows = [(D, 18, "G", 5), (D, 19, "G", 9), (D, 20, "G", 9), (D, 3, "G", 1), (D + dt.timedelta(days=1), 18, "G", 1)]
    out = insights.peak_conversion_hours(df(rows, "date date, hour int, channel string, total_conversions long")).collect()
    assert [(r.hour, r.total_conversions, r.rank) for r in out] == [(19, 9, 1), (20, 9, 2), (18, 6, 3)]


def test_quarantine_split(df):
    rows = [(1, 5, 10.0, 1, 20.0, 0.1, 2.0), (1, 5, -3.0, 1, 20.0, 0.1, 0.0), (1, 50, 1.0, 0, 900.0, 1.5, 900.0),
            (None, None, None, None, None, None, None)]
    d = df(rows, "impressions long, clicks long, spend double, conversions long, revenue double, ctr double, roas double")
    clean, bad = insights.quarantine_split(d)
    assert clean.count() == 2
    assert sorted(r._reasons for r in bad.collect()) == ["ctr_out_of_range,roas_out_of_range", "negative_spend"]


def test_pseudonymize_keeps_sessions(df):
    from adpulse.operators import silver
    rows = [(D, 1, "page_view", "S1", "U1", "/", None, None, None), (D, 2, "click", "S1", "U1", "/", None, None, None),
            (D, 3, "login", "S2", "U2", "/", None, None, None), (D, 4, "login", None, "U3", "/", None, None, None)]
    ga = df(rows, "date date, hour int, event_name string, session_id string, user_id string, page string, "
                  "source string, medium string, campaign_id string")
    hashed = insights.pseudonymize(ga, "pepper")
    got = silver.transform_events(hashed).orderBy("hour").collect()
    assert [r.is_bounce for r in got] == [False, False, True, False]
    assert got[0].user_id != "U1" and len(got[0].user_id) == 64 and got[3].session_id is None
