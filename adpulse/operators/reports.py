"""Dashboard report queries over the gold tables.

Each report is a lazy DataFrame; only its (small) result reaches a caller.
Filters compile to Column predicates, so date, channel and campaign
conditions reach the Parquet scan.  Grand totals for shares and the default
drill-down campaign are scalar subqueries, not ``OVER ()`` windows (which
would pull every row into one task), cross joins or driver round-trips; the
default date window is one fetched value, so it is pushed down as literals.

Semantics follow the pandas dashboard: NULL grouping keys are dropped
(pandas ``groupby``), sums of nothing are 0, guarded ratios give 0, report
rounding is half-even (``Series.round``).  Unguarded ratios give NULL where
pandas would give inf/NaN, and NULLs rank last.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adpulse.config import HEALTHY_ROAS, ROAS_LABELS, TARGET_LABELS, TARGET_ROAS
from adpulse.functions.exprs import exact_mean, guarded_ratio, money_sum, open_ratio, round_half_even

def _lit_date(d) -> Column:
    return d if isinstance(d, Column) else F.lit(str(d)).cast("date")


@dataclass
class Filters:
    """Dashboard filter state.

    ``date_range`` applies only with both bounds (inclusive).  ``channels``
    and ``campaigns`` are IN-lists; ``None`` means no filter and an empty
    list keeps no rows.  The campaign filter is skipped on tables without
    ``campaign_id``.
    """

    date_range: tuple | None = None      # (start, end): dates, ISO strings or Columns
    channels: list[str] | None = None
    campaigns: list[str] | None = None
    extra: list[Column] = field(default_factory=list)

    def apply(self, df: DataFrame, use_dates: bool = True) -> DataFrame:
        out = df
        if use_dates and self.date_range is not None and len(self.date_range) == 2:
            start, end = self.date_range
            out = out.where(F.col("date").between(_lit_date(start), _lit_date(end)))
        if self.channels is not None and "channel" in out.columns:
            out = out.where(F.col("channel").isin(list(self.channels)) if self.channels else F.lit(False))
        if self.campaigns is not None and "campaign_id" in out.columns:
            out = out.where(F.col("campaign_id").isin(list(self.campaigns)) if self.campaigns else F.lit(False))
        for cond in self.extra:
            out = out.where(cond)
        return out


ALL = Filters()


def default_window(df: DataFrame, days: int = 30) -> tuple | None:
    """[max(date) - days, max(date)]: the dashboard's opening date range.

    The bound is one aggregated value fetched once (as the dashboard does
    per page load); as literal dates the range reaches the Parquet scan as
    pushed filters and skips row groups of the date-sorted gold tables.
    ``None`` (no filter) when the table has no dates.
    """
    import datetime as dt

    end = df.agg(F.max("date").alias("d")).first()["d"]
    if end is None:
        return None
    return end - dt.timedelta(days=days), end


def default_filters(df: DataFrame, days: int = 30, channels: list[str] | None = None) -> Filters:
    return Filters(date_range=default_window(df, days), channels=channels)


def date_bounds(campaign_daily: DataFrame, days: int = 30) -> DataFrame:
    """Min and max date and the default window start (sidebar bounds)."""
    return campaign_daily.agg(
        F.min("date").alias("min_date"),
        F.max("date").alias("max_date"),
        F.date_sub(F.max("date"), days).alias("default_start"),
    )


def filter_values(df: DataFrame) -> DataFrame:
    """Distinct sorted values offered by the channel and campaign selectors."""
    parts = [
        df.select(F.lit(c).alias("filter_name"), F.col(c).alias("value")).distinct()
        for c in ("channel", "campaign_id") if c in df.columns
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("filter_name", "value")


def filtered_scope(campaign_daily: DataFrame, f: Filters) -> DataFrame:
    return f.apply(campaign_daily)


def _nz(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


def _nz_money(col: str) -> Column:
    return F.coalesce(money_sum(col), F.lit(0.0))


def headline_kpis(campaign_daily: DataFrame, f: Filters = ALL) -> DataFrame:
    """Executive headline: totals, ROAS, CTR, CPA, campaign count, health label."""
    s = f.apply(campaign_daily).agg(
        _nz_money("total_revenue").alias("total_revenue"),
        _nz_money("total_spend").alias("total_spend"),
        _nz(F.sum("total_conversions")).alias("total_conversions"),
        _nz(F.sum("total_clicks")).alias("total_clicks"),
        _nz(F.sum("total_impressions")).alias("total_impressions"),
        # len(unique()) counts a missing id as one more value
        (F.count_distinct("campaign_id") + F.max(F.when(F.col("campaign_id").isNull(), 1).otherwise(0)))
        .alias("active_campaigns"),
    )
    roas = guarded_ratio("total_revenue", "total_spend")
    return s.select(
        "total_revenue", "total_spend", "total_conversions", "total_clicks", "total_impressions",
        roas.alias("roas"),
        guarded_ratio("total_clicks", "total_impressions").alias("ctr"),
        guarded_ratio("total_spend", "total_conversions").alias("cpa"),
        _nz(F.col("active_campaigns")).cast("long").alias("active_campaigns"),
        F.when(roas > HEALTHY_ROAS, ROAS_LABELS[0]).otherwise(ROAS_LABELS[1]).alias("roas_status"),
    )


def _by(df: DataFrame, keys: list[str], *aggs: Column) -> DataFrame:
    """pandas-style groupby: rows with a NULL key are dropped."""
    kept = df
    for k in keys:
        kept = kept.where(F.col(k).isNotNull())
    return kept.groupBy(*keys).agg(*aggs)


def daily_channel_revenue(channel_daily: DataFrame, f: Filters = ALL) -> DataFrame:
    return _by(f.apply(channel_daily), ["date", "channel"], money_sum("total_revenue").alias("total_revenue"))


def _share(df: DataFrame, measure: str) -> DataFrame:
    totals = _by(df, ["channel"], money_sum(measure).alias(measure))
    grand = totals.select(money_sum(measure)).scalar()
    return totals.select("channel", measure, F.try_divide(F.col(measure), grand).alias("share"))


def channel_revenue_share(channel_daily: DataFrame, f: Filters = ALL) -> DataFrame:
    return _share(f.apply(channel_daily), "total_revenue")


def channel_spend_share(channel_daily: DataFrame, f: Filters = ALL) -> DataFrame:
    return _share(f.apply(channel_daily), "total_spend")


def daily_spend_vs_revenue(channel_daily: DataFrame, f: Filters = ALL) -> DataFrame:
    return _by(
        f.apply(channel_daily), ["date"],
        money_sum("total_spend").alias("total_spend"), money_sum("total_revenue").alias("total_revenue"),
    )


def top_campaigns(campaign_daily: DataFrame, f: Filters = ALL, k: int = 15) -> DataFrame:
    """Top campaigns by revenue per (campaign, name, channel); ties by key."""
    t = _by(
        f.apply(campaign_daily), ["campaign_id", "campaign_name", "channel"],
        money_sum("total_revenue").alias("total_revenue"),
        money_sum("total_spend").alias("total_spend"),
        F.sum("total_conversions").alias("total_conversions"),
        F.sum("total_clicks").alias("total_clicks"),
        F.sum("total_impressions").alias("total_impressions"),
    )
    return (
        t.select(
            "campaign_id", "campaign_name", "channel", "total_revenue", "total_spend",
            round_half_even(guarded_ratio("total_revenue", "total_spend"), 2).alias("roas"),
            "total_conversions",
            round_half_even(guarded_ratio("total_clicks", "total_impressions"), 4).alias("ctr"),
        )
        .orderBy(F.desc("total_revenue"), "campaign_id", "campaign_name", "channel")
        .limit(k)
    )


def campaign_channel_revenue(campaign_daily: DataFrame, f: Filters = ALL, k: int = 30) -> DataFrame:
    t = _by(f.apply(campaign_daily), ["campaign_id", "channel"], money_sum("total_revenue").alias("total_revenue"))
    return t.orderBy(F.desc("total_revenue"), "campaign_id", "channel").limit(k)


def campaign_roas_top(campaign_daily: DataFrame, f: Filters = ALL, k: int = 10) -> DataFrame:
    """Top k campaigns by unguarded ROAS (NULL where spend is 0, ranked last), returned lowest first."""
    t = _by(
        f.apply(campaign_daily), ["campaign_id"],
        money_sum("total_revenue").alias("total_revenue"), money_sum("total_spend").alias("total_spend"),
    )
    r = t.select("*", round_half_even(open_ratio("total_revenue", "total_spend"), 2).alias("roas"))
    top = r.orderBy(F.col("roas").desc_nulls_last(), "campaign_id").limit(k)
    return top.orderBy(F.col("roas").asc_nulls_first(), F.desc("campaign_id"))


def campaign_cpa_lowest(campaign_daily: DataFrame, f: Filters = ALL, k: int = 10) -> DataFrame:
    """Lowest k CPA (0 when there are no conversions, so those rank first)."""
    t = _by(
        f.apply(campaign_daily), ["campaign_id"],
        money_sum("total_spend").alias("total_spend"), F.sum("total_conversions").alias("total_conversions"),
    )
    r = t.select("*", round_half_even(guarded_ratio("total_spend", "total_conversions"), 2).alias("cpa"))
    return r.orderBy(F.asc("cpa"), "campaign_id").limit(k)


def campaign_scope_kpis(campaign_daily: DataFrame, f: Filters = ALL) -> DataFrame:
    s = f.apply(campaign_daily).agg(
        F.count_distinct("campaign_id").alias("num_campaigns"),
        _nz_money("total_revenue").alias("total_revenue"),
        _nz_money("total_spend").alias("total_spend"),
        _nz(F.sum("total_conversions")).alias("total_conversions"),
    )
    roas = guarded_ratio("total_revenue", "total_spend")
    return s.select(
        "num_campaigns", "total_revenue", "total_spend", "total_conversions",
        roas.alias("avg_roas"),
        guarded_ratio("total_spend", "total_conversions").alias("avg_cpa"),
        F.when(roas > TARGET_ROAS, TARGET_LABELS[0]).otherwise(TARGET_LABELS[1]).alias("roas_status"),
    )


def best_campaign(campaign_daily: DataFrame, f: Filters = ALL) -> DataFrame:
    """Campaign with the largest summed revenue; ties go to the lowest id."""
    t = _by(f.apply(campaign_daily), ["campaign_id"], money_sum("total_revenue").alias("total_revenue"))
    return t.orderBy(F.desc("total_revenue"), "campaign_id").limit(1)


def funnel_totals(campaign_daily: DataFrame, f: Filters = ALL) -> DataFrame:
    """Impressions -> clicks -> conversions, with percent of initial and of previous."""
    s = f.apply(campaign_daily).agg(
        _nz(F.sum("total_impressions")).alias("i"),
        _nz(F.sum("total_clicks")).alias("c"),
        _nz(F.sum("total_conversions")).alias("v"),
    )

    def stage(order: int, name: str, value: str, prev: str) -> Column:
        return F.struct(
            F.lit(order).alias("stage_order"), F.lit(name).alias("stage"), F.col(value).alias("value"),
            open_ratio(value, "i").alias("pct_of_initial"), open_ratio(value, prev).alias("pct_of_previous"),
        )

    return s.select(F.inline(F.array(
        stage(1, "Impressions", "i", "i"), stage(2, "Clicks", "c", "i"), stage(3, "Conversions", "v", "c"),
    )))


def campaign_drilldown(campaign_daily: DataFrame, f: Filters = ALL, campaign_id: str | None = None) -> DataFrame:
    """Daily spend and revenue of one campaign (default: first in sorted order)."""
    scoped = f.apply(campaign_daily)
    target = F.lit(campaign_id) if campaign_id is not None else scoped.select(F.min("campaign_id")).scalar()
    return _by(
        scoped.where(F.col("campaign_id") == target), ["campaign_id", "date"],
        money_sum("total_revenue").alias("total_revenue"), money_sum("total_spend").alias("total_spend"),
    )


def channel_scorecard(channel_daily: DataFrame, f: Filters = ALL) -> DataFrame:
    """Per-channel sums, ROAS, CTR, CPC; ordered by ROAS descending."""
    t = _by(
        f.apply(channel_daily), ["channel"],
        money_sum("total_revenue").alias("total_revenue"),
        money_sum("total_spend").alias("total_spend"),
        F.sum("total_clicks").alias("total_clicks"),
        F.sum("total_impressions").alias("total_impressions"),
        F.sum("total_conversions").alias("total_conversions"),
    )
    return t.select(
        "channel", "total_revenue", "total_spend", "total_clicks", "total_impressions", "total_conversions",
        round_half_even(open_ratio("total_revenue", "total_spend"), 2).alias("roas"),
        round_half_even(open_ratio("total_clicks", "total_impressions"), 4).alias("ctr"),
        round_half_even(open_ratio("total_spend", "total_clicks"), 2).alias("cpc"),
    ).orderBy(F.col("roas").desc_nulls_last(), "channel")


def hour_channel_ctr(hourly_trends: DataFrame, f: Filters = ALL) -> DataFrame:
    """Unweighted mean of daily CTR per (hour, channel); only the channel filter applies."""
    return _by(f.apply(hourly_trends, use_dates=False), ["hour", "channel"], exact_mean("avg_ctr", 6).alias("avg_ctr"))


def hour_channel_heatmap(hourly_trends: DataFrame, f: Filters = ALL) -> DataFrame:
    """Channel x hour matrix of mean CTR; a day has the hours 0-23, those without data are NULL."""
    hours = list(range(24))
    kept = f.apply(hourly_trends, use_dates=False).where(F.col("channel").isNotNull() & F.col("hour").isNotNull())
    piv = kept.groupBy("channel").pivot("hour", hours).agg(exact_mean("avg_ctr", 6))
    return piv.select("channel", *[F.col(str(h)).alias(f"h{h:02d}") for h in hours])
