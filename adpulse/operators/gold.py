"""Gold layer: daily campaign, channel, hourly and funnel aggregates.

Every builder takes a *measure frame*: dimension columns plus
``impressions, clicks, conversions`` (long) and ``spend_exact,
revenue_exact`` (money as wide decimals, so that sums are exact).  Silver rows become one via
``measures(silver)``; ``rollup(silver)`` pre-aggregates silver to
(date, hour, campaign, channel, objective) so the four tables share one
scan and one map-side-combined shuffle of silver.  Because sums of sums are
exact, a builder gives the same table from either input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adpulse.functions.exprs import money, round_half_away, safe_ratio

ROLLUP_KEYS = ["date", "hour", "campaign_id", "campaign_name", "channel", "objective"]


def measures(silver: DataFrame, keys: list[str] = ROLLUP_KEYS) -> DataFrame:
    return silver.select(
        *keys, "impressions", "clicks", "conversions",
        money("spend").alias("spend_exact"), money("revenue").alias("revenue_exact"),
    )


def _sums() -> list:
    return [
        F.sum("impressions").alias("impressions"),
        F.sum("clicks").alias("clicks"),
        F.sum("conversions").alias("conversions"),
        F.sum("spend_exact").alias("spend_exact"),
        F.sum("revenue_exact").alias("revenue_exact"),
    ]


def rollup(silver: DataFrame) -> DataFrame:
    """Shared pre-aggregate of silver at the finest gold grain."""
    return measures(silver).groupBy(*ROLLUP_KEYS).agg(*_sums())


def _totals(g: DataFrame, keys: list[str]) -> DataFrame:
    return g.groupBy(*keys).agg(*_sums())


def campaign_daily(m: DataFrame) -> DataFrame:
    keys = ["date", "campaign_id", "campaign_name", "channel", "objective"]
    t = _totals(m, keys)
    spend, rev = F.col("spend_exact").cast("double"), F.col("revenue_exact").cast("double")
    return t.select(
        *keys,
        F.col("impressions").alias("total_impressions"),
        F.col("clicks").alias("total_clicks"),
        round_half_away(spend, 2).alias("total_spend"),
        F.col("conversions").alias("total_conversions"),
        round_half_away(rev, 2).alias("total_revenue"),
        safe_ratio("clicks", "impressions", 6).alias("avg_ctr"),
        safe_ratio(spend, "clicks", 4).alias("avg_cpc"),
        safe_ratio(spend, "conversions", 4).alias("avg_cpa"),
        safe_ratio(rev, spend, 4).alias("avg_roas"),
        safe_ratio("conversions", "clicks", 6).alias("avg_conversion_rate"),
    )


def channel_daily(m: DataFrame) -> DataFrame:
    """Per (date, channel); exact distinct campaign count.

    The distinct count is two ordinary aggregations, per campaign and then per
    channel: both combine map-side, and the sums ride along.
    """
    per_campaign = _totals(m, ["date", "channel", "campaign_id"])
    t = per_campaign.groupBy("date", "channel").agg(*_sums(), F.count("campaign_id").alias("campaign_count"))
    spend, rev = F.col("spend_exact").cast("double"), F.col("revenue_exact").cast("double")
    return t.select(
        "date", "channel",
        F.col("impressions").alias("total_impressions"),
        F.col("clicks").alias("total_clicks"),
        round_half_away(spend, 2).alias("total_spend"),
        F.col("conversions").alias("total_conversions"),
        round_half_away(rev, 2).alias("total_revenue"),
        safe_ratio("clicks", "impressions", 6).alias("avg_ctr"),
        safe_ratio(spend, "clicks", 4).alias("avg_cpc"),
        safe_ratio(rev, spend, 4).alias("avg_roas"),
        "campaign_count",
    )


def hourly_trends(m: DataFrame) -> DataFrame:
    t = _totals(m, ["date", "hour", "channel"])
    return t.select(
        "date", "hour", "channel",
        F.col("impressions").alias("total_impressions"),
        F.col("clicks").alias("total_clicks"),
        round_half_away("spend_exact", 2).alias("total_spend"),
        F.col("conversions").alias("total_conversions"),
        round_half_away("revenue_exact", 2).alias("total_revenue"),
        safe_ratio("clicks", "impressions", 6).alias("avg_ctr"),
    )


def funnel_summary(m: DataFrame) -> DataFrame:
    t = _totals(m, ["date", "campaign_id", "campaign_name"])
    return t.select(
        "date", "campaign_id", "campaign_name",
        F.col("impressions").alias("total_impressions"),
        F.col("clicks").alias("total_clicks"),
        F.col("conversions").alias("total_conversions"),
        safe_ratio("clicks", "impressions", 6).alias("impression_to_click_rate"),
        safe_ratio("conversions", "clicks", 6).alias("click_to_conversion_rate"),
        safe_ratio("conversions", "impressions", 8).alias("overall_conversion_rate"),
    )


BUILDERS = {
    "gold_campaign_daily": (campaign_daily, ["date", "campaign_id", "channel"]),
    "gold_channel_daily": (channel_daily, ["date", "channel"]),
    "gold_hourly_trends": (hourly_trends, ["date", "hour", "channel"]),
    "gold_funnel_summary": (funnel_summary, ["date", "campaign_id"]),
}
