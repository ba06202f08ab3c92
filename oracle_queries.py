"""DuckDB oracle SQL for every registered query (the driver's correctness gate).

Each statement starts from the adapter views of FIXTURES.md section 2 over
the driver's tables, then restates the operator in plain SQL.  Money is
summed as wide decimals on this side too (see README, "Exact money sums"),
report rounding is ``round_even`` (pandas) and table rounding is ``ROUND``
(scaled, half away from zero).  The checks of the suite are written out here,
not taken from the code under test.
"""

from __future__ import annotations

from typing import NamedTuple

from adpulse.config import CONVERSION_EVENTS, ENGAGEMENT_EVENTS, HEALTHY_ROAS, NAVIGATION_EVENTS, TARGET_ROAS

MAX_NULL_PCT, MAX_STALENESS_HOURS, ROAS_MAX, ZSCORE_THRESHOLD = 0.01, 48, 50.0, 3.0


class Check(NamedTuple):
    kind: str
    table: str
    columns: tuple = ()
    min_val: float | None = None
    max_val: float | None = None
    min_rows: int = 0
    parent_table: str | None = None
    parent_column: str | None = None


SUITE = [
    Check("completeness", "silver_ads_performance", ("date", "campaign_id", "channel", "impressions", "clicks", "spend")),
    Check("non_negative", "silver_ads_performance", ("impressions", "clicks", "spend", "conversions", "revenue")),
    Check("range", "silver_ads_performance", ("ctr",), 0.0, 1.0),
    Check("range", "silver_ads_performance", ("roas",), 0.0, 50.0),
    Check("zscore", "silver_ads_performance", ("spend",)),
    Check("zscore", "silver_ads_performance", ("revenue",)),
    Check("freshness", "silver_ads_performance", ("date",)),
    Check("completeness", "silver_ga_events", ("date", "event_name", "session_id", "user_id")),
    Check("freshness", "silver_ga_events", ("date",)),
    Check("row_count", "gold_campaign_daily", min_rows=100),
    Check("non_negative", "gold_campaign_daily", ("total_impressions", "total_clicks", "total_spend", "total_revenue")),
    Check("freshness", "gold_campaign_daily", ("date",)),
    Check("referential", "silver_ads_performance", ("campaign_id",), parent_table="bronze_campaigns", parent_column="campaign_id"),
]

BATCH_ID = "oracle_batch"
AS_OF = "2024-02-01 00:00:00"

ADS = """ads AS (
SELECT CAST(l_shipdate AS DATE) AS date, l_linenumber AS hour,
 concat('CMP', lpad(CAST(l_suppkey % 10 AS VARCHAR(10)), 3, '0')) AS campaign_id,
 CASE WHEN l_partkey % 331 = 0 THEN 'CMP999_AG99' ELSE concat('CMP', lpad(CAST(l_suppkey % 10 AS VARCHAR(10)), 3, '0'), '_AG0', CAST(l_partkey % 3 AS VARCHAR(10))) END AS adgroup_id,
 CASE l_returnflag WHEN 'A' THEN 'Google Ads' WHEN 'N' THEN 'Facebook Ads' ELSE 'TikTok Ads' END AS channel,
 CAST(l_quantity AS BIGINT) * 100 AS impressions, CAST(l_quantity AS BIGINT) * (l_partkey % 5) AS clicks,
 CASE WHEN l_orderkey % 200 = 0 THEN -l_extendedprice ELSE l_extendedprice END AS spend,
 CAST(l_quantity AS BIGINT) * (l_partkey % 5) * (l_linenumber % 3) AS conversions,
 l_extendedprice * (l_linenumber % 4) AS revenue, l_orderkey AS _load_seq
FROM lineitem)"""

GA = """ga AS (
SELECT CAST(ts AS DATE) AS date, CAST(hour(ts) AS INT) AS hour,
 CASE event_type WHEN 'signup' THEN 'sign_up' WHEN 'view' THEN 'page_view' ELSE event_type END AS event_name,
 CASE WHEN event_id % 97 = 0 THEN NULL ELSE concat('S', CAST(user_id AS VARCHAR(20)), '_', CAST(CAST(ts AS DATE) AS VARCHAR(20))) END AS session_id,
 concat('U', CAST(user_id AS VARCHAR(20))) AS user_id, concat('/p', CAST(event_id % 11 AS VARCHAR(10))) AS page,
 CASE user_id % 4 WHEN 0 THEN 'google' WHEN 1 THEN 'facebook' WHEN 2 THEN 'tiktok' ELSE NULL END AS source,
 CASE user_id % 4 WHEN 3 THEN NULL ELSE 'cpc' END AS medium,
 CASE WHEN user_id % 4 = 3 OR event_id % 20 = 0 THEN NULL ELSE concat('CMP', lpad(CAST(event_id % 10 AS VARCHAR(10)), 3, '0')) END AS campaign_id
FROM events)"""

CAMPAIGNS = """campaigns AS (
SELECT DISTINCT concat('CMP', lpad(CAST(s_suppkey % 10 AS VARCHAR(10)), 3, '0')) AS campaign_id,
 concat('Campaign_', lpad(CAST(s_suppkey % 10 AS VARCHAR(10)), 3, '0')) AS campaign_name,
 CASE s_suppkey % 5 WHEN 0 THEN 'Awareness' WHEN 1 THEN 'Traffic' WHEN 2 THEN 'Conversions' WHEN 3 THEN 'App Install' ELSE 'Lead Gen' END AS objective,
 CAST(50 + 45 * (s_suppkey % 10) AS DOUBLE) AS budget_daily,
 CAST('1995-01-01' AS DATE) AS start_date,
 CASE WHEN s_suppkey % 10 < 3 THEN CAST('2000-01-01' AS DATE) ELSE NULL END AS end_date,
 CASE WHEN s_suppkey % 10 < 3 THEN 'Completed' ELSE 'Active' END AS status
FROM supplier WHERE s_suppkey % 10 <> 9)"""

ADGROUPS = """adgroups AS (
SELECT DISTINCT concat('CMP', lpad(CAST(s_suppkey % 10 AS VARCHAR(10)), 3, '0'), '_AG0', CAST(j AS VARCHAR(10))) AS adgroup_id,
 concat('CMP', lpad(CAST(s_suppkey % 10 AS VARCHAR(10)), 3, '0')) AS campaign_id,
 concat('AdGroup_0', CAST(j AS VARCHAR(10))) AS adgroup_name,
 CASE j WHEN 0 THEN 'Interest' WHEN 1 THEN 'Lookalike' ELSE 'Broad' END AS targeting_type,
 CASE j WHEN 0 THEN 'Manual CPC' WHEN 1 THEN 'Target CPA' ELSE 'Target ROAS' END AS bid_strategy
FROM supplier CROSS JOIN (SELECT DISTINCT p_partkey % 3 AS j FROM part) r)"""


def exact(col: str) -> str:
    """Exact money sum, unrounded."""
    return f"CAST(SUM(CAST({col} AS DECIMAL(28, 10))) AS DOUBLE)"


def ms(col: str) -> str:
    """Exact sum of amounts that have two decimals already (the gold totals)."""
    return f"CAST(CAST(SUM(CAST({col} AS DECIMAL(28, 10))) AS DECIMAL(38, 2)) AS DOUBLE)"


def names(values: list) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def ratio(num: str, den: str, k: int) -> str:
    """Guarded, table-rounded ratio (``CASE WHEN den > 0 THEN ROUND(n/d,k) ELSE 0.0``)."""
    return f"(CASE WHEN ({den}) > 0 THEN ROUND(CAST({num} AS DOUBLE) / CAST({den} AS DOUBLE), {k}) ELSE 0.0 END)"


def gratio(num: str, den: str) -> str:
    return f"(CASE WHEN ({den}) > 0 THEN CAST({num} AS DOUBLE) / CAST({den} AS DOUBLE) ELSE 0.0 END)"


def oratio(num: str, den: str) -> str:
    """Unguarded ratio; NULL when the denominator is 0."""
    return f"(CASE WHEN ({den}) = 0 THEN NULL ELSE CAST({num} AS DOUBLE) / CAST({den} AS DOUBLE) END)"


def bigsum(col: str) -> str:
    return f"CAST(SUM({col}) AS BIGINT)"


SILVER_DEDUP = """silver_dedup AS (
SELECT DISTINCT ON (date, hour, campaign_id, adgroup_id, channel)
 date, hour, campaign_id, adgroup_id, channel,
 COALESCE(impressions, 0) AS impressions, COALESCE(clicks, 0) AS clicks, COALESCE(spend, 0.0) AS spend,
 COALESCE(conversions, 0) AS conversions, COALESCE(revenue, 0.0) AS revenue
FROM ads
ORDER BY date, hour, campaign_id, adgroup_id, channel, _load_seq DESC,
 impressions DESC, clicks DESC, spend DESC, conversions DESC, revenue DESC)"""

SILVER_ADS = f"""silver_ads AS (
SELECT a.date, a.hour, a.campaign_id, a.adgroup_id, a.channel,
 a.impressions, a.clicks, a.spend, a.conversions, a.revenue,
 {ratio('a.clicks', 'a.impressions', 6)} AS ctr,
 {ratio('a.spend', 'a.clicks', 4)} AS cpc,
 {ratio('a.spend', 'a.conversions', 4)} AS cpa,
 {ratio('a.revenue', 'a.spend', 4)} AS roas,
 {ratio('a.conversions', 'a.clicks', 6)} AS conversion_rate,
 c.campaign_name, c.objective, c.budget_daily, ag.adgroup_name, ag.targeting_type, ag.bid_strategy
FROM silver_dedup a
LEFT JOIN campaigns c ON a.campaign_id = c.campaign_id
LEFT JOIN adgroups ag ON a.adgroup_id = ag.adgroup_id)"""

SILVER_GA = f"""session_counts AS (SELECT session_id, COUNT(*) AS event_count FROM ga GROUP BY session_id),
silver_ga AS (
SELECT e.date, e.hour, e.event_name,
 CASE WHEN e.event_name IN {names(CONVERSION_EVENTS)} THEN 'conversion'
      WHEN e.event_name IN {names(ENGAGEMENT_EVENTS)} THEN 'engagement'
      WHEN e.event_name IN {names(NAVIGATION_EVENTS)} THEN 'navigation'
      ELSE 'other' END AS event_category,
 e.session_id, e.user_id, e.page,
 COALESCE(e.source, 'direct') AS source, COALESCE(e.medium, '(none)') AS medium, e.campaign_id,
 CASE WHEN sc.event_count = 1 THEN TRUE ELSE FALSE END AS is_bounce
FROM ga e LEFT JOIN session_counts sc ON e.session_id = sc.session_id)"""

_GOLD_SUMS = f"""{bigsum('impressions')} AS total_impressions, {bigsum('clicks')} AS total_clicks,
 ROUND({exact('spend')}, 2) AS total_spend, {bigsum('conversions')} AS total_conversions, ROUND({exact('revenue')}, 2) AS total_revenue"""

GOLD_CAMPAIGN = f"""gold_campaign_daily AS (
SELECT date, campaign_id, campaign_name, channel, objective, {_GOLD_SUMS},
 {ratio('SUM(clicks)', 'SUM(impressions)', 6)} AS avg_ctr,
 {ratio(exact('spend'), 'SUM(clicks)', 4)} AS avg_cpc,
 {ratio(exact('spend'), 'SUM(conversions)', 4)} AS avg_cpa,
 {ratio(exact('revenue'), exact('spend'), 4)} AS avg_roas,
 {ratio('SUM(conversions)', 'SUM(clicks)', 6)} AS avg_conversion_rate
FROM silver_ads GROUP BY date, campaign_id, campaign_name, channel, objective)"""

GOLD_CHANNEL = f"""gold_channel_daily AS (
SELECT date, channel, {_GOLD_SUMS},
 {ratio('SUM(clicks)', 'SUM(impressions)', 6)} AS avg_ctr,
 {ratio(exact('spend'), 'SUM(clicks)', 4)} AS avg_cpc,
 {ratio(exact('revenue'), exact('spend'), 4)} AS avg_roas,
 COUNT(DISTINCT campaign_id) AS campaign_count
FROM silver_ads GROUP BY date, channel)"""

GOLD_HOURLY = f"""gold_hourly_trends AS (
SELECT date, hour, channel, {_GOLD_SUMS},
 {ratio('SUM(clicks)', 'SUM(impressions)', 6)} AS avg_ctr
FROM silver_ads GROUP BY date, hour, channel)"""

GOLD_FUNNEL = f"""gold_funnel_summary AS (
SELECT date, campaign_id, campaign_name,
 {bigsum('impressions')} AS total_impressions, {bigsum('clicks')} AS total_clicks, {bigsum('conversions')} AS total_conversions,
 {ratio('SUM(clicks)', 'SUM(impressions)', 6)} AS impression_to_click_rate,
 {ratio('SUM(conversions)', 'SUM(clicks)', 6)} AS click_to_conversion_rate,
 {ratio('SUM(conversions)', 'SUM(impressions)', 8)} AS overall_conversion_rate
FROM silver_ads GROUP BY date, campaign_id, campaign_name)"""

_ADS_CHAIN = [ADS, CAMPAIGNS, ADGROUPS, SILVER_DEDUP, SILVER_ADS]


def with_(ctes: list[str], body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


def _gold(*gold: str) -> list[str]:
    return _ADS_CHAIN + list(gold)


# ---------------------------------------------------------------- reports
_NN = "campaign_id IS NOT NULL"


def _reports() -> dict[str, str]:
    q: dict[str, str] = {}
    gc = _gold(GOLD_CAMPAIGN)
    gch = _gold(GOLD_CHANNEL)
    gh = _gold(GOLD_HOURLY)
    q["headline_kpis"] = with_(gc, f"""
SELECT total_revenue, total_spend, total_conversions, total_clicks, total_impressions,
 {gratio('total_revenue', 'total_spend')} AS roas,
 {gratio('total_clicks', 'total_impressions')} AS ctr,
 {gratio('total_spend', 'total_conversions')} AS cpa,
 active_campaigns,
 CASE WHEN {gratio('total_revenue', 'total_spend')} > {HEALTHY_ROAS} THEN 'HEALTHY' ELSE 'REBALANCING NEEDED' END AS roas_status
FROM (SELECT COALESCE({ms('total_revenue')}, 0.0) AS total_revenue, COALESCE({ms('total_spend')}, 0.0) AS total_spend,
 CAST(COALESCE(SUM(total_conversions), 0) AS BIGINT) AS total_conversions,
 CAST(COALESCE(SUM(total_clicks), 0) AS BIGINT) AS total_clicks,
 CAST(COALESCE(SUM(total_impressions), 0) AS BIGINT) AS total_impressions,
 CAST(COALESCE(COUNT(DISTINCT campaign_id) + MAX(CASE WHEN campaign_id IS NULL THEN 1 ELSE 0 END), 0) AS BIGINT) AS active_campaigns
 FROM gold_campaign_daily) s""")
    q["daily_channel_revenue"] = with_(gch, f"""
SELECT date, channel, {ms('total_revenue')} AS total_revenue FROM gold_channel_daily
WHERE date IS NOT NULL AND channel IS NOT NULL GROUP BY date, channel""")
    for name, m in (("channel_revenue_share", "total_revenue"), ("channel_spend_share", "total_spend")):
        q[name] = with_(gch + [f"t AS (SELECT channel, {ms(m)} AS {m} FROM gold_channel_daily WHERE channel IS NOT NULL GROUP BY channel)"], f"""
SELECT channel, {m}, {oratio(m, f'(SELECT {ms(m)} FROM t)')} AS share FROM t""")
    q["daily_spend_vs_revenue"] = with_(gch, f"""
SELECT date, {ms('total_spend')} AS total_spend, {ms('total_revenue')} AS total_revenue FROM gold_channel_daily
WHERE date IS NOT NULL GROUP BY date""")
    q["top_campaigns"] = with_(gc, f"""
SELECT campaign_id, campaign_name, channel, total_revenue, total_spend,
 round_even({gratio('total_revenue', 'total_spend')}, 2) AS roas, total_conversions,
 round_even({gratio('total_clicks', 'total_impressions')}, 4) AS ctr
FROM (SELECT campaign_id, campaign_name, channel, {ms('total_revenue')} AS total_revenue, {ms('total_spend')} AS total_spend,
 {bigsum('total_conversions')} AS total_conversions, {bigsum('total_clicks')} AS total_clicks, {bigsum('total_impressions')} AS total_impressions
 FROM gold_campaign_daily WHERE {_NN} AND campaign_name IS NOT NULL AND channel IS NOT NULL
 GROUP BY campaign_id, campaign_name, channel) t
ORDER BY total_revenue DESC, campaign_id, campaign_name, channel LIMIT 15""")
    q["campaign_channel_revenue"] = with_(gc, f"""
SELECT campaign_id, channel, {ms('total_revenue')} AS total_revenue FROM gold_campaign_daily
WHERE {_NN} AND channel IS NOT NULL GROUP BY campaign_id, channel
ORDER BY total_revenue DESC, campaign_id, channel LIMIT 30""")
    q["campaign_roas_top"] = with_(gc, f"""
SELECT campaign_id, total_revenue, total_spend, round_even({oratio('total_revenue', 'total_spend')}, 2) AS roas
FROM (SELECT campaign_id, {ms('total_revenue')} AS total_revenue, {ms('total_spend')} AS total_spend
 FROM gold_campaign_daily WHERE {_NN} GROUP BY campaign_id) t
ORDER BY roas DESC NULLS LAST, campaign_id LIMIT 10""")
    q["campaign_cpa_lowest"] = with_(gc, f"""
SELECT campaign_id, total_spend, total_conversions, round_even({gratio('total_spend', 'total_conversions')}, 2) AS cpa
FROM (SELECT campaign_id, {ms('total_spend')} AS total_spend, {bigsum('total_conversions')} AS total_conversions
 FROM gold_campaign_daily WHERE {_NN} GROUP BY campaign_id) t
ORDER BY cpa ASC, campaign_id LIMIT 10""")
    q["campaign_scope_kpis"] = with_(gc, f"""
SELECT num_campaigns, total_revenue, total_spend, total_conversions,
 {gratio('total_revenue', 'total_spend')} AS avg_roas, {gratio('total_spend', 'total_conversions')} AS avg_cpa,
 CASE WHEN {gratio('total_revenue', 'total_spend')} > {TARGET_ROAS} THEN 'TARGET MET' ELSE 'SUB-OPTIMAL' END AS roas_status
FROM (SELECT COUNT(DISTINCT campaign_id) AS num_campaigns, COALESCE({ms('total_revenue')}, 0.0) AS total_revenue,
 COALESCE({ms('total_spend')}, 0.0) AS total_spend, CAST(COALESCE(SUM(total_conversions), 0) AS BIGINT) AS total_conversions
 FROM gold_campaign_daily) s""")
    q["best_campaign"] = with_(gc, f"""
SELECT campaign_id, {ms('total_revenue')} AS total_revenue FROM gold_campaign_daily WHERE {_NN}
GROUP BY campaign_id ORDER BY total_revenue DESC, campaign_id LIMIT 1""")
    q["funnel_totals"] = with_(gc + [f"""s AS (SELECT CAST(COALESCE(SUM(total_impressions), 0) AS BIGINT) AS i,
 CAST(COALESCE(SUM(total_clicks), 0) AS BIGINT) AS c, CAST(COALESCE(SUM(total_conversions), 0) AS BIGINT) AS v FROM gold_campaign_daily)"""], f"""
SELECT 1 AS stage_order, 'Impressions' AS stage, i AS value, {oratio('i', 'i')} AS pct_of_initial, {oratio('i', 'i')} AS pct_of_previous FROM s
UNION ALL SELECT 2, 'Clicks', c, {oratio('c', 'i')}, {oratio('c', 'i')} FROM s
UNION ALL SELECT 3, 'Conversions', v, {oratio('v', 'i')}, {oratio('v', 'c')} FROM s""")
    q["campaign_drilldown"] = with_(gc, f"""
SELECT campaign_id, date, {ms('total_revenue')} AS total_revenue, {ms('total_spend')} AS total_spend
FROM gold_campaign_daily WHERE campaign_id = (SELECT MIN(campaign_id) FROM gold_campaign_daily) AND date IS NOT NULL
GROUP BY campaign_id, date""")
    q["channel_scorecard"] = with_(gch, f"""
SELECT channel, total_revenue, total_spend, total_clicks, total_impressions, total_conversions,
 round_even({oratio('total_revenue', 'total_spend')}, 2) AS roas,
 round_even({oratio('total_clicks', 'total_impressions')}, 4) AS ctr,
 round_even({oratio('total_spend', 'total_clicks')}, 2) AS cpc
FROM (SELECT channel, {ms('total_revenue')} AS total_revenue, {ms('total_spend')} AS total_spend,
 {bigsum('total_clicks')} AS total_clicks, {bigsum('total_impressions')} AS total_impressions,
 {bigsum('total_conversions')} AS total_conversions
 FROM gold_channel_daily WHERE channel IS NOT NULL GROUP BY channel) t""")
    mean = "CAST(SUM(CAST(ROUND({v} * 1000000) AS BIGINT)) AS DOUBLE) / (CAST(COUNT({v}) AS DOUBLE) * 1000000.0)"
    q["hour_channel_ctr"] = with_(gh, f"""
SELECT hour, channel, {mean.format(v='avg_ctr')} AS avg_ctr FROM gold_hourly_trends
WHERE channel IS NOT NULL AND hour IS NOT NULL GROUP BY hour, channel""")
    cells = ",\n ".join(
        mean.format(v=f"(CASE WHEN hour = {h} THEN avg_ctr END)") + f" AS h{h:02d}" for h in range(24)
    )
    q["hour_channel_heatmap"] = with_(gh, f"""
SELECT channel,
 {cells}
FROM gold_hourly_trends WHERE channel IS NOT NULL AND hour IS NOT NULL GROUP BY channel""")
    q["filter_values"] = with_(gc, """
SELECT DISTINCT 'channel' AS filter_name, channel AS value FROM gold_campaign_daily
UNION ALL SELECT DISTINCT 'campaign_id', campaign_id FROM gold_campaign_daily""")
    q["date_bounds"] = with_(gc, """
SELECT MIN(date) AS min_date, MAX(date) AS max_date, CAST(MAX(date) - INTERVAL 30 DAY AS DATE) AS default_start
FROM gold_campaign_daily""")
    q["filtered_scope"] = with_(gc, f"""
SELECT * FROM gold_campaign_daily
WHERE date BETWEEN CAST((SELECT MAX(date) FROM gold_campaign_daily) - INTERVAL 30 DAY AS DATE)
                AND (SELECT MAX(date) FROM gold_campaign_daily)""")
    q["campaign_filtered"] = with_(gc, "SELECT * FROM gold_campaign_daily WHERE campaign_id IN ('CMP001', 'CMP004')")
    q["budget_reallocation"] = with_(gch + [f"""t AS (SELECT channel, {ms('total_spend')} AS total_spend, {ms('total_revenue')} AS total_revenue
 FROM gold_channel_daily WHERE channel IS NOT NULL GROUP BY channel)""", f"""r AS (SELECT *, ROUND({oratio('total_revenue', 'total_spend')}, 4) AS roas,
 ROUND((SELECT {ms('total_spend')} FROM t) * {oratio('total_revenue', f"(SELECT {ms('total_revenue')} FROM t)")}, 2) AS suggested_spend FROM t)"""], """
SELECT channel, total_spend, total_revenue, roas, suggested_spend, ROUND(suggested_spend - total_spend, 2) AS shift,
 CAST(ROW_NUMBER() OVER (ORDER BY roas DESC NULLS LAST, channel) AS INTEGER) AS efficiency_rank FROM r""")
    return q


# ---------------------------------------------------------------- quality
_THOUSANDS = "format('{{:,}}', {x})"


def _th(x: str) -> str:
    return _THOUSANDS.format(x=x)


def _fixed(x: str, k: int) -> str:
    return f"printf('%.{k}f', ROUND({x}, {k}))"


def _row_sql(name, ctype, table, column, status, metric, threshold, details, src) -> str:
    key = f"concat_ws('|', '{BATCH_ID}', {name}, '{table}', {column})"
    return (
        f"SELECT substr(sha256({key}), 1, 12) AS check_id, {name} AS check_name, '{ctype}' AS check_type, "
        f"'{table}' AS table_name, {column} AS column_name, {status} AS status, "
        f"CAST({metric} AS DOUBLE) AS metric_value, CAST({threshold} AS DOUBLE) AS threshold, "
        f"{details} AS details, '{BATCH_ID}' AS batch_id FROM {src}"
    )


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_TABLE_CTE = {
    "silver_ads_performance": "silver_ads",
    "silver_ga_events": "silver_ga",
    "gold_campaign_daily": "gold_campaign_daily",
    "bronze_campaigns": "campaigns",
}


def _check_sql(c: Check) -> list[str]:
    t = _TABLE_CTE[c.table]
    out = []
    if c.kind == "completeness":
        # Empty table gives one FAIL row; otherwise one row per column.
        for col in c.columns:
            src = f"(SELECT COUNT(*) AS n, COUNT(*) FILTER (WHERE {col} IS NULL) AS k FROM {t}) x WHERE n > 0"
            pct = "(CAST(k AS DOUBLE) / CAST(n AS DOUBLE))"
            out.append(_row_sql(
                _q(f"null_check_{col}"), "completeness", c.table, _q(col),
                f"CASE WHEN {pct} <= {MAX_NULL_PCT} THEN 'PASS' ELSE 'FAIL' END", f"ROUND({pct}, 4)", MAX_NULL_PCT,
                f"concat('Detected ', {_th('k')}, ' nulls in ', {_th('n')}, ' rows')", src))
        out.append(_row_sql(_q("completeness"), "completeness", c.table, _q("*"), "'FAIL'", "0", 0,
                            _q("Null count impossible: Table is empty"),
                            f"(SELECT COUNT(*) AS n FROM {t}) x WHERE n = 0"))
    elif c.kind == "non_negative":
        for col in c.columns:
            src = f"(SELECT COUNT(*) FILTER (WHERE {col} < 0) AS k FROM {t}) x"
            out.append(_row_sql(
                _q(f"non_negative_{col}"), "validity", c.table, _q(col),
                "CASE WHEN k = 0 THEN 'PASS' ELSE 'FAIL' END", "k", 0,
                f"concat('Illegal negative values detected (', {_th('k')}, ' instances)')", src))
    elif c.kind == "range":
        col = c.columns[0]
        conds = []
        if c.min_val is not None:
            conds.append(f"{col} < {float(c.min_val)}")
        if c.max_val is not None:
            conds.append(f"{col} > {float(c.max_val)}")
        src = f"(SELECT COUNT(*) AS n, COUNT(*) FILTER (WHERE {' OR '.join(conds)}) AS k FROM {t}) x"
        pct = "(CASE WHEN n > 0 THEN CAST(k AS DOUBLE) / CAST(n AS DOUBLE) ELSE 0.0 END)"
        label = f"Target range [{c.min_val}, {c.max_val}] - Violations: "
        out.append(_row_sql(
            _q(f"range_check_{col}"), "validity", c.table, _q(col),
            f"CASE WHEN k = 0 THEN 'PASS' WHEN {pct} < 0.01 THEN 'WARN' ELSE 'FAIL' END", "k", 0,
            f"concat({_q(label)}, {_th('k')})", src))
    elif c.kind == "row_count":
        src = f"(SELECT COUNT(*) AS n FROM {t}) x"
        out.append(_row_sql(
            _q(f"row_count_{c.table}"), "consistency", c.table, _q("*"),
            f"CASE WHEN n >= {c.min_rows} THEN 'PASS' ELSE 'FAIL' END", "n", c.min_rows,
            f"concat('Current volume: ', {_th('n')}, {_q(f' (Baseline: {c.min_rows:,})')})", src))
    elif c.kind == "referential":
        col = c.columns[0]
        p = _TABLE_CTE[c.parent_table]
        src = (f"(SELECT COUNT(DISTINCT ch.{col}) AS k FROM {t} ch LEFT JOIN {p} pa ON ch.{col} = pa.{c.parent_column} "
               f"WHERE pa.{c.parent_column} IS NULL AND ch.{col} IS NOT NULL) x")
        out.append(_row_sql(
            _q(f"ref_integrity_{col}"), "consistency", c.table, _q(col),
            "CASE WHEN k = 0 THEN 'PASS' ELSE 'WARN' END", "k", 0,
            f"concat('Detected ', CAST(k AS VARCHAR), {_q(f' orphaned identifiers in {c.table}')})", src))
    elif c.kind == "zscore":
        col = c.columns[0]
        st = f"(SELECT AVG({col}) AS m, STDDEV_POP({col}) AS s, COUNT({col}) AS n FROM {t})"
        src = (f"(SELECT st.n AS n, st.s AS s, COUNT(*) FILTER (WHERE v.{col} IS NOT NULL AND st.s > 0 "
               f"AND ABS((v.{col} - st.m) / st.s) > {ZSCORE_THRESHOLD}) AS k FROM {t} v, {st} st GROUP BY st.n, st.s) x WHERE n > 0")
        pct = "(CAST(k AS DOUBLE) / CAST(n AS DOUBLE))"
        out.append(_row_sql(
            _q(f"anomaly_{col}"), "anomaly", c.table, _q(col),
            f"CASE WHEN s = 0 THEN 'PASS' WHEN {pct} < 0.02 THEN 'PASS' WHEN {pct} < 0.05 THEN 'WARN' ELSE 'FAIL' END",
            "CASE WHEN s = 0 THEN 0 ELSE k END", ZSCORE_THRESHOLD,
            f"CASE WHEN s = 0 THEN 'Invariance detected (zero variance baseline)' ELSE "
            f"concat('Outlier density: ', {_fixed(pct + ' * 100.0', 2)}, '% (', {_th('k')}, ' rows)') END", src))
    elif c.kind == "freshness":
        col = c.columns[0] if c.columns else "date"
        hours = f"((epoch(TIMESTAMP '{AS_OF}') - epoch(CAST(d AS TIMESTAMP))) / 3600.0)"
        src = f"(SELECT MAX(CAST({col} AS DATE)) AS d FROM {t}) x"
        out.append(_row_sql(
            _q(f"freshness_{c.table}"), "freshness", c.table, _q(col),
            f"CASE WHEN d IS NULL THEN 'FAIL' WHEN {hours} <= {MAX_STALENESS_HOURS} THEN 'PASS' ELSE 'WARN' END",
            f"CASE WHEN d IS NULL THEN 0 ELSE ROUND({hours}, 1) END", MAX_STALENESS_HOURS,
            f"CASE WHEN d IS NULL THEN 'Incomplete batch: No date markers found' ELSE "
            f"concat('Latency: ', {_fixed(hours, 1)}, 'h (SLA Boundary: {MAX_STALENESS_HOURS}h)') END", src))
    return out


_QUALITY_CTES = _ADS_CHAIN + [GA, SILVER_GA, GOLD_CAMPAIGN]


def quality_sql(checks: list[Check]) -> str:
    parts = [s for c in checks for s in _check_sql(c)]
    return with_(_QUALITY_CTES, "\nUNION ALL\n".join(parts))


def _quality() -> dict[str, str]:
    suite = SUITE
    q = {}
    for name, kind in (
        ("dq_completeness", "completeness"), ("dq_non_negative", "non_negative"), ("dq_range", "range"),
        ("dq_row_count", "row_count"), ("dq_referential", "referential"), ("dq_zscore", "zscore"),
        ("dq_freshness", "freshness"),
    ):
        q[name] = quality_sql([c for c in suite if c.kind == kind])
    q["dq_suite"] = quality_sql(suite)
    q["dq_summary"] = f"""WITH r AS ({quality_sql(suite)})
SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE status = 'PASS') AS passed,
 COUNT(*) FILTER (WHERE status = 'WARN') AS warned, COUNT(*) FILTER (WHERE status = 'FAIL') AS failed,
 CASE WHEN COUNT(*) > 0 THEN ROUND(COUNT(*) FILTER (WHERE status = 'PASS') * 100.0 / COUNT(*), 1) ELSE 0.0 END AS pass_rate,
 CASE WHEN (CASE WHEN COUNT(*) > 0 THEN CAST(COUNT(*) FILTER (WHERE status = 'PASS') AS DOUBLE) * 100.0 / COUNT(*) ELSE 0.0 END) >= 90 THEN 'HEALTHY'
      WHEN (CASE WHEN COUNT(*) > 0 THEN CAST(COUNT(*) FILTER (WHERE status = 'PASS') AS DOUBLE) * 100.0 / COUNT(*) ELSE 0.0 END) >= 70 THEN 'AT RISK'
      ELSE 'CRITICAL' END AS score_band
FROM r"""
    q["dq_gate"] = f"""WITH r AS ({quality_sql(suite)})
SELECT table_name, check_name FROM r WHERE status = 'FAIL'"""
    q["dq_audit_log"] = f"""WITH r AS ({quality_sql(suite)})
SELECT * FROM r WHERE check_type = 'validity'"""
    return q


# ---------------------------------------------------------------- all
def oracle_sql() -> dict[str, str]:
    q = {
        "silver_ads_dedup": with_([ADS, SILVER_DEDUP], "SELECT * FROM silver_dedup"),
        "silver_ads_kpis": with_(_ADS_CHAIN, "SELECT * FROM silver_ads"),
        "silver_ga_events": with_([GA, SILVER_GA], "SELECT * FROM silver_ga"),
        "gold_campaign_daily": with_(_gold(GOLD_CAMPAIGN), "SELECT * FROM gold_campaign_daily"),
        "gold_channel_daily": with_(_gold(GOLD_CHANNEL), "SELECT * FROM gold_channel_daily"),
        "gold_hourly_trends": with_(_gold(GOLD_HOURLY), "SELECT * FROM gold_hourly_trends"),
        "gold_funnel_summary": with_(_gold(GOLD_FUNNEL), "SELECT * FROM gold_funnel_summary"),
    }
    q.update(_reports())
    q.update(_quality())
    q["volume_vs_trailing_avg"] = with_(_ADS_CHAIN + ["""daily AS (SELECT date, COUNT(*) AS row_count FROM silver_ads
 WHERE date IS NOT NULL GROUP BY date)""", """w AS (SELECT date, row_count,
 SUM(row_count) OVER (ORDER BY date_diff('day', DATE '1970-01-01', date) RANGE BETWEEN 30 PRECEDING AND 1 PRECEDING) AS s,
 COUNT(row_count) OVER (ORDER BY date_diff('day', DATE '1970-01-01', date) RANGE BETWEEN 30 PRECEDING AND 1 PRECEDING) AS n
 FROM daily)"""], """
SELECT 'silver_ads_performance' AS table_name, date, CAST(row_count AS BIGINT) AS row_count,
 CASE WHEN n = 0 THEN NULL ELSE CAST(s AS DOUBLE) / CAST(n AS DOUBLE) END AS trailing_avg,
 CASE WHEN n = 0 THEN NULL ELSE CAST(row_count AS DOUBLE) / (CAST(s AS DOUBLE) / CAST(n AS DOUBLE)) END AS ratio,
 COALESCE(CASE WHEN n = 0 THEN NULL ELSE CAST(row_count AS DOUBLE) / (CAST(s AS DOUBLE) / CAST(n AS DOUBLE)) END < 0.5, FALSE) AS is_drop
FROM w""")
    q["hourly_spikes"] = with_(_ADS_CHAIN + [
        "h AS (SELECT date, hour, channel, CAST(SUM(clicks) AS BIGINT) AS traffic FROM silver_ads WHERE channel IS NOT NULL GROUP BY date, hour, channel)",
        "st AS (SELECT channel, CAST(COUNT(*) AS HUGEINT) AS n, CAST(SUM(traffic) AS HUGEINT) AS s1, "
        "CAST(SUM(CAST(traffic AS HUGEINT) * traffic) AS HUGEINT) AS s2 FROM h GROUP BY channel)",
        "z AS (SELECT h.date, h.hour, h.channel, h.traffic, "
        "CASE WHEN st.n * st.s2 - st.s1 * st.s1 = 0 THEN NULL ELSE "
        "CAST(st.n * h.traffic - st.s1 AS DOUBLE) / sqrt(CAST(st.n * st.s2 - st.s1 * st.s1 AS DOUBLE)) END AS z "
        "FROM h LEFT JOIN st ON h.channel = st.channel)"], f"""
SELECT date, hour, channel, traffic, ROUND(z, 4) AS zscore, COALESCE(ABS(z) > {ZSCORE_THRESHOLD}, FALSE) AS is_spike FROM z""")
    q["attribution_gap"] = with_([GA, SILVER_GA], """
SELECT source, COUNT(*) AS paid_events, COUNT(*) FILTER (WHERE campaign_id IS NULL) AS unattributed_events,
 CAST(COUNT(*) FILTER (WHERE campaign_id IS NULL) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE) AS gap_share
FROM silver_ga WHERE medium <> '(none)' GROUP BY source""")
    q["peak_conversion_hours"] = with_(_gold(GOLD_HOURLY), """
SELECT channel, hour, total_conversions, rank FROM (
 SELECT channel, hour, total_conversions,
  CAST(ROW_NUMBER() OVER (PARTITION BY channel ORDER BY total_conversions DESC, hour ASC) AS INTEGER) AS rank
 FROM (SELECT channel, hour, CAST(SUM(total_conversions) AS BIGINT) AS total_conversions FROM gold_hourly_trends
  WHERE channel IS NOT NULL AND hour IS NOT NULL GROUP BY channel, hour) t) r
WHERE rank <= 3""")
    reasons = ", ".join([
        "CASE WHEN impressions < 0 THEN 'negative_impressions' END",
        "CASE WHEN clicks < 0 THEN 'negative_clicks' END",
        "CASE WHEN spend < 0 THEN 'negative_spend' END",
        "CASE WHEN conversions < 0 THEN 'negative_conversions' END",
        "CASE WHEN revenue < 0 THEN 'negative_revenue' END",
        "CASE WHEN ctr < 0.0 OR ctr > 1.0 THEN 'ctr_out_of_range' END",
        f"CASE WHEN roas < 0.0 OR roas > {ROAS_MAX} THEN 'roas_out_of_range' END",
    ])
    q["silver_ads_quarantine"] = with_(_ADS_CHAIN, f"""
SELECT * FROM (SELECT *, concat_ws(',', {reasons}) AS _reasons FROM silver_ads) t WHERE _reasons <> ''""")
    bronze_ads = "hour, campaign_id, adgroup_id, channel, impressions, clicks, spend, conversions, revenue FROM ads"
    q["incremental_replace"] = with_([ADS], f"""
SELECT date, {bronze_ads} UNION ALL SELECT CAST(NULL AS DATE), {bronze_ads} WHERE _load_seq % 5000 = 3""")
    q["string_dated_slice"] = with_([ADS], f"SELECT date, {bronze_ads} WHERE date = (SELECT MAX(date) FROM ads)")
    undated = GA.replace("ga AS (", "dated AS (", 1), "ga AS (SELECT * FROM dated UNION ALL SELECT * REPLACE (CAST(NULL AS DATE) AS date) FROM dated WHERE user_id LIKE '%77')"
    q["incremental_events"] = with_([*undated, SILVER_GA], "SELECT * FROM silver_ga")
    q["incremental_checked"] = quality_sql(SUITE)
    q["pseudonymized_events"] = with_([GA], """
SELECT * REPLACE (CASE WHEN session_id IS NULL THEN NULL ELSE sha256(concat('pepper', session_id)) END AS session_id,
 sha256(concat('pepper', user_id)) AS user_id) FROM ga""")
    q["backfill_range"] = with_(_gold(GOLD_CHANNEL), "SELECT * FROM gold_channel_daily")
    q["replace_interrupted"] = with_([ADS], f"SELECT date, {bronze_ads}")
    q["declared_scan"] = q["replace_interrupted"]
    q["session_state_merge"] = with_(list(undated), "SELECT session_id, date, COUNT(*) AS n FROM ga WHERE session_id IS NOT NULL GROUP BY session_id, date")
    q["freshness_from_metadata"] = q["dq_freshness"]
    q["zscore_from_state"] = q["dq_zscore"]
    q["distinct_campaigns_range"] = with_([ADS], """
SELECT days, channel, COUNT(DISTINCT campaign_id) AS campaign_count
FROM ads, (SELECT unnest([0, 1, 2, 31, 365]) AS days) w
WHERE days = 0 OR date > (SELECT MAX(date) FROM ads) - CAST(days AS INTEGER) GROUP BY days, channel""")
    q["backfill_resumed"] = q["backfill_range"]
    q["d_minus_1"] = q["backfill_range"]
    q["retention_applied"] = with_([ADS], f"SELECT date, {bronze_ads} WHERE date >= (SELECT MAX(date) FROM ads) - 89")
    q["bronze_lineage"] = with_([ADS], """
SELECT channel, CAST(1 AS BIGINT) AS channels_in_a_file, COUNT(*) AS rows_loaded, COUNT(*) AS rows_with_time, TRUE AS files_named FROM ads GROUP BY channel""")
    q["script_rebuild"] = with_([ADS], """
SELECT channel, concat(channel, '; all days') AS note, CAST(SUM(clicks) AS BIGINT) AS total_clicks FROM ads GROUP BY channel
UNION ALL SELECT 'all', 'every channel; every day', CAST(SUM(clicks) AS BIGINT) FROM ads""")
    q["source_missing"] = with_([ADS, CAMPAIGNS], """
SELECT 'bronze_ads_performance' AS table_name, 'ads_performance.parquet' AS source_file, TRUE AS loaded, COUNT(*) AS row_count FROM ads
UNION ALL SELECT 'bronze_ga_events', 'ga_events.parquet', FALSE, 0
UNION ALL SELECT 'bronze_campaigns', 'campaigns.parquet', TRUE, COUNT(*) FROM campaigns
UNION ALL SELECT 'bronze_adgroups', 'adgroups.parquet', FALSE, 0""")
    q["results_by_batch"] = f"""WITH r AS ({quality_sql([c for c in SUITE if c.kind == 'row_count'])})
SELECT b AS batch_id, check_name, table_name, status, metric_value FROM r, (SELECT unnest(['b1', 'b2']) AS b) x"""
    q["warehouse_access"] = with_([ADS], """
SELECT 'row_count' AS what, COUNT(*) AS n FROM ads
UNION ALL SELECT 'execute', COUNT(*) FROM ads WHERE channel = 'Google Ads'
UNION ALL SELECT 'absent', 0""")
    q["backfill_arguments"] = with_([ADS], """
SELECT case_name, 'refused' AS outcome, row_count FROM (SELECT COUNT(*) AS row_count FROM ads) n, (SELECT unnest(['no start', 'no end', 'reversed']) AS case_name) c""")
    counts = [
        ("bronze_adgroups", "adgroups"), ("bronze_ads_performance", "ads"), ("bronze_campaigns", "campaigns"),
        ("bronze_ga_events", "ga"), ("gold_campaign_daily", "gold_campaign_daily"),
        ("gold_channel_daily", "gold_channel_daily"), ("gold_funnel_summary", "gold_funnel_summary"),
        ("gold_hourly_trends", "gold_hourly_trends"), ("quality_check_results", "dq"),
        ("silver_ads_performance", "silver_ads"), ("silver_ga_events", "silver_ga"),
    ]
    layer = ("CASE WHEN t LIKE 'bronze%' THEN 'BRONZE' WHEN t LIKE 'silver%' THEN 'SILVER' "
             "WHEN t LIKE 'gold%' THEN 'GOLD' ELSE 'SYSTEM' END")
    union = "\nUNION ALL ".join(f"SELECT '{t}' AS t, COUNT(*) AS n FROM {v}" for t, v in counts)
    q["warehouse_inventory"] = with_(
        _ADS_CHAIN + [GA, SILVER_GA, GOLD_CAMPAIGN, GOLD_CHANNEL, GOLD_FUNNEL, GOLD_HOURLY,
                      f"dq AS ({quality_sql(SUITE)})"],
        f"SELECT t AS table_name, CAST(n AS BIGINT) AS row_count, {layer} AS layer FROM ({union}) c")
    return q
