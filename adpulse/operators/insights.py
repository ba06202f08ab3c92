"""Monitoring and insight queries the reference describes in its documentation.

* ``volume_vs_trailing_avg`` -- daily row count against the average of the
  previous 30 days, to catch ingestion drops.
* ``hourly_spikes`` -- hourly traffic per channel scored against the
  channel's own mean and (population) standard deviation; |z| > 3 is a spike.
* ``attribution_gap`` -- share of paid-medium events that lost their campaign id.
* ``peak_conversion_hours`` -- the hours with the most conversions per channel.
* ``budget_reallocation`` -- channels by ROAS, and spend moved in line with revenue.

All five aggregate first, so every window below runs over per-day or
per-hour rows (bounded by the calendar), never over raw events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adpulse.config import ZSCORE_THRESHOLD
from adpulse.functions.exprs import money_sum, open_ratio, round_half_away


def volume_vs_trailing_avg(df: DataFrame, table_name: str, days: int = 30, drop_ratio: float = 0.5) -> DataFrame:
    """Rows per day vs the mean of the ``days`` calendar days before it.

    The frame is a RANGE over the day number, so missing days shrink the
    sample instead of stretching the window.  Days without history get
    NULL average and ratio and are never flagged.
    """
    daily = df.where(F.col("date").isNotNull()).groupBy("date").agg(F.count(F.lit(1)).alias("row_count"))
    w = Window.partitionBy("table_name").orderBy(F.unix_date("date")).rangeBetween(-days, -1)
    t = daily.select(F.lit(table_name).alias("table_name"), "date", "row_count")
    t = t.select(
        "*",
        F.sum("row_count").over(w).alias("_s"),
        F.count("row_count").over(w).alias("_n"),
    )
    avg = F.try_divide(F.col("_s").cast("double"), F.col("_n").cast("double"))
    ratio = F.try_divide(F.col("row_count").cast("double"), avg)
    return t.select(
        "table_name", "date", "row_count", avg.alias("trailing_avg"), ratio.alias("ratio"),
        F.coalesce(ratio < drop_ratio, F.lit(False)).alias("is_drop"),
    )


def hourly_spikes(silver_ads: DataFrame, measure: str = "clicks", threshold: float = ZSCORE_THRESHOLD) -> DataFrame:
    """Per (date, hour, channel) traffic with its z-score within the channel.

    z = (n*x - S1) / sqrt(n*S2 - S1^2) with n, S1 = sum x, S2 = sum x^2 taken
    exactly (decimal), which is the population z-score; one sqrt and one
    division remain, so the score does not depend on summation order.
    """
    hourly = (
        silver_ads.where(F.col("channel").isNotNull())
        .groupBy("date", "hour", "channel").agg(F.sum(measure).alias("traffic"))
    )
    big = "decimal(38,0)"
    stats = hourly.groupBy("channel").agg(
        F.count(F.lit(1)).cast(big).alias("_n"),
        F.sum(F.col("traffic").cast(big)).alias("_s1"),
        F.sum(F.col("traffic").cast(big) * F.col("traffic").cast(big)).alias("_s2"),
    )
    j = hourly.join(stats, "channel", "left")
    spread = F.sqrt((F.col("_n") * F.col("_s2") - F.col("_s1") * F.col("_s1")).cast("double"))
    z = F.try_divide((F.col("_n") * F.col("traffic").cast(big) - F.col("_s1")).cast("double"), spread)
    return j.select(
        "date", "hour", "channel", "traffic",
        round_half_away(z, 4).alias("zscore"),
        F.coalesce(F.abs(z) > threshold, F.lit(False)).alias("is_spike"),
    )


def attribution_gap(silver_ga: DataFrame) -> DataFrame:
    """Per source: paid-medium events, how many lack a campaign id, and that share."""
    paid = silver_ga.where(F.col("medium") != "(none)")
    t = paid.groupBy("source").agg(
        F.count(F.lit(1)).alias("paid_events"),
        F.count_if(F.col("campaign_id").isNull()).alias("unattributed_events"),
    )
    return t.select("*", (F.col("unattributed_events") / F.col("paid_events").cast("double")).alias("gap_share"))


def peak_conversion_hours(hourly_trends: DataFrame, k: int = 3) -> DataFrame:
    """Top ``k`` hours by total conversions within each channel (ties: earlier hour)."""
    t = (
        hourly_trends.where(F.col("channel").isNotNull() & F.col("hour").isNotNull())
        .groupBy("channel", "hour").agg(F.sum("total_conversions").alias("total_conversions"))
    )
    w = Window.partitionBy("channel").orderBy(F.desc("total_conversions"), F.asc("hour"))
    return t.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def budget_reallocation(channel_daily: DataFrame) -> DataFrame:
    """Channels by efficiency, and the spend each would have if the same budget followed revenue.

    ``suggested_spend`` is the total spend times the channel's share of revenue,
    ``shift`` its difference from what was spent; the shifts sum to zero but for
    rounding.  A channel without revenue gets nothing, one without spend has no
    ROAS and ranks last; without any revenue there is no suggestion (NULL).
    """
    t = (
        channel_daily.where(F.col("channel").isNotNull()).groupBy("channel")
        .agg(money_sum("total_spend").alias("total_spend"), money_sum("total_revenue").alias("total_revenue"))
    )
    all_spend, all_revenue = t.select(money_sum("total_spend")).scalar(), t.select(money_sum("total_revenue")).scalar()
    suggested = round_half_away(all_spend * F.try_divide(F.col("total_revenue"), all_revenue), 2)
    roas = round_half_away(open_ratio("total_revenue", "total_spend"), 4)
    # One row for each channel by now, so ranking them is small.
    order = Window.partitionBy(F.lit(1)).orderBy(F.col("roas").desc_nulls_last(), "channel")
    return (
        t.select("channel", "total_spend", "total_revenue", roas.alias("roas"), suggested.alias("suggested_spend"))
        .withColumn("shift", round_half_away(F.col("suggested_spend") - F.col("total_spend"), 2))
        .withColumn("efficiency_rank", F.row_number().over(order))
    )


# ------------------------------------------------------------------ governance
# Row-level validation rules of the silver ads table (the same bounds the
# check suite audits).  Each rule is (reason, predicate that marks a bad row).
def _ads_rules() -> list[tuple[str, F.Column]]:
    from adpulse.config import ROAS_MAX
    return [
        ("negative_impressions", F.col("impressions") < 0),
        ("negative_clicks", F.col("clicks") < 0),
        ("negative_spend", F.col("spend") < 0),
        ("negative_conversions", F.col("conversions") < 0),
        ("negative_revenue", F.col("revenue") < 0),
        ("ctr_out_of_range", (F.col("ctr") < 0.0) | (F.col("ctr") > 1.0)),
        ("roas_out_of_range", (F.col("roas") < 0.0) | (F.col("roas") > ROAS_MAX)),
    ]


def quarantine_split(silver_ads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(clean rows, quarantined rows + ``_reasons``) of silver ads.

    A row is quarantined when any rule marks it; ``_reasons`` lists every
    rule it breaks, comma-separated, in rule order.  NULL never breaks a rule.
    """
    flags = [F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in _ads_rules()]
    reasons = F.concat_ws(",", *flags)
    tagged = silver_ads.withColumn("_reasons", reasons)
    return (
        tagged.where(F.col("_reasons") == "").drop("_reasons"),
        tagged.where(F.col("_reasons") != ""),
    )


def pseudonymize(df: DataFrame, salt: str, columns: tuple[str, ...] = ("user_id", "session_id")) -> DataFrame:
    """Replace identifier columns by salted SHA-256 (NULL stays NULL).

    Equal ids map to equal digests, so sessions, bounces and joins are unchanged.
    """
    out = df
    for c in columns:
        if c in df.columns:
            out = out.withColumn(c, F.when(F.col(c).isNotNull(), F.sha2(F.concat(F.lit(salt), F.col(c)), 256)))
    return out
