"""Silver layer: latest-record dedup, KPIs, dimension enrichment, event enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adpulse.config import ADS_KEYS
from adpulse.functions.exprs import event_category, safe_ratio

# Recency columns, newest first; whichever are present decide the survivor.
RECENCY = ["_loaded_at", "_load_seq"]
MEASURES = ["impressions", "clicks", "spend", "conversions", "revenue"]


def dedup_latest(ads: DataFrame, keys: list[str] = ADS_KEYS, recency: list[str] = RECENCY) -> DataFrame:
    """Keep the most recently loaded row per key (``DISTINCT ON ... ORDER BY recency DESC``).

    Ties on recency are broken on the measures, descending, so the survivor
    is deterministic.  ``row_number() == 1`` is planned with a partial
    WindowGroupLimit before the shuffle, so a hot key is cut to one row per
    map task before it moves.  Measures are NULL-filled with 0.
    """
    order = [F.col(c).desc_nulls_last() for c in recency if c in ads.columns]
    order += [F.col(m).desc_nulls_last() for m in MEASURES]
    w = Window.partitionBy(*keys).orderBy(*order)
    latest = ads.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1)
    return latest.select(
        *keys,
        *[F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in ["impressions", "clicks"]],
        F.coalesce(F.col("spend"), F.lit(0.0)).alias("spend"),
        F.coalesce(F.col("conversions"), F.lit(0).cast("long")).alias("conversions"),
        F.coalesce(F.col("revenue"), F.lit(0.0)).alias("revenue"),
    )


def with_kpis(ads: DataFrame) -> DataFrame:
    """CTR, CPC, CPA, ROAS and conversion rate with the ``> 0`` guard."""
    return ads.select(
        "*",
        safe_ratio("clicks", "impressions", 6).alias("ctr"),
        safe_ratio("spend", "clicks", 4).alias("cpc"),
        safe_ratio("spend", "conversions", 4).alias("cpa"),
        safe_ratio("revenue", "spend", 4).alias("roas"),
        safe_ratio("conversions", "clicks", 6).alias("conversion_rate"),
    )


SILVER_ADS_COLUMNS = [
    *ADS_KEYS, "impressions", "clicks", "spend", "conversions", "revenue",
    "ctr", "cpc", "cpa", "roas", "conversion_rate",
    "campaign_name", "objective", "budget_daily", "adgroup_name", "targeting_type", "bid_strategy",
]


def enrich(ads: DataFrame, campaigns: DataFrame, adgroups: DataFrame) -> DataFrame:
    """LEFT joins to the campaign and ad-group dimensions (orphans keep NULL dims).

    The ad-group join is on ``adgroup_id`` alone, as in the reference.  No
    hint is given: the adaptive plan broadcasts a dimension by its size in
    bytes, and joins by shuffle otherwise.
    """
    c = campaigns.select("campaign_id", "campaign_name", "objective", "budget_daily")
    g = adgroups.select("adgroup_id", "adgroup_name", "targeting_type", "bid_strategy")
    out = ads.join(c, "campaign_id", "left").join(g, "adgroup_id", "left")
    return out.select(*SILVER_ADS_COLUMNS)


def transform_ads(bronze_ads: DataFrame, campaigns: DataFrame, adgroups: DataFrame) -> DataFrame:
    """bronze_ads_performance -> silver_ads_performance (without audit columns)."""
    return enrich(with_kpis(dedup_latest(bronze_ads)), campaigns, adgroups)


def session_days(bronze_ga: DataFrame) -> DataFrame:
    """(session_id, date, n): events of each session on each date; no row without a session."""
    return (bronze_ga.where(F.col("session_id").isNotNull())
            .groupBy("session_id", "date").agg(F.count(F.lit(1)).alias("n")))


def session_bucket(buckets: int) -> Column:
    """Which of the state's buckets a session's counts lie in."""
    return F.pmod(F.xxhash64("session_id"), F.lit(buckets)).cast("int").alias("bucket")


def added_up(counts: DataFrame) -> DataFrame:
    """The counts per session and day that rows of partial, possibly negative, counts add up to."""
    return counts.groupBy("session_id", "date").agg(F.sum("n").alias("n")).where(F.col("n") != 0)


def transform_events(bronze_ga: DataFrame, days: DataFrame | None = None) -> DataFrame:
    """bronze_ga_events -> silver_ga_events (without audit columns).

    A session of exactly one event is a bounce, so only such sessions need to
    be found: a count (combined map-side) that also carries the hash of the
    session's event.  Events meet them on session *and* event hash, so the
    events of a hot session are spread over all tasks by their hashes and
    never need one task.  Events without a session are never bounces and skip
    the shuffle.

    ``days`` holds (session_id, date, n) of every session in ``bronze_ga`` when
    that is only a slice: a session must then also have one event over all days.
    """
    keyed = bronze_ga.where(F.col("session_id").isNotNull()).withColumn("_event", F.xxhash64(*bronze_ga.columns))
    single = (keyed.groupBy("session_id").agg(F.count(F.lit(1)).alias("_n"), F.min("_event").alias("_event"))
              .where(F.col("_n") == 1).select("session_id", "_event"))
    if days is not None:
        whole = days.groupBy("session_id").agg(F.sum("n").alias("_n")).where(F.col("_n") == 1)
        single = single.join(whole, "session_id", "left_semi")
    bounced = (keyed.join(single.withColumn("is_bounce", F.lit(True)), ["session_id", "_event"], "left")
               .withColumn("is_bounce", F.coalesce("is_bounce", F.lit(False))))
    orphan = bronze_ga.where(F.col("session_id").isNull()).withColumn("is_bounce", F.lit(False))

    def shape(df: DataFrame) -> DataFrame:
        return df.select(
            "date", "hour", "event_name",
            event_category(F.col("event_name")).alias("event_category"),
            "session_id", "user_id", "page",
            F.coalesce(F.col("source"), F.lit("direct")).alias("source"),
            F.coalesce(F.col("medium"), F.lit("(none)")).alias("medium"),
            "campaign_id", "is_bounce",
        )

    return shape(bounced).unionByName(shape(orphan))
