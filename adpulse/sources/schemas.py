"""Explicit table schemas (declared, never inferred)."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _I, _D = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType()
_DATE, _TS, _B = T.DateType(), T.TimestampType(), T.BooleanType()


def _schema(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


ADS_PERFORMANCE = _schema(
    ("date", _DATE), ("hour", _I), ("campaign_id", _S), ("adgroup_id", _S), ("channel", _S),
    ("impressions", _L), ("clicks", _L), ("spend", _D), ("conversions", _L), ("revenue", _D),
)

GA_EVENTS = _schema(
    ("date", _DATE), ("hour", _I), ("event_name", _S), ("session_id", _S), ("user_id", _S),
    ("page", _S), ("source", _S), ("medium", _S), ("campaign_id", _S),
)

CAMPAIGNS = _schema(
    ("campaign_id", _S), ("campaign_name", _S), ("objective", _S), ("budget_daily", _D),
    ("start_date", _DATE), ("end_date", _DATE), ("status", _S),
)

ADGROUPS = _schema(
    ("adgroup_id", _S), ("campaign_id", _S), ("adgroup_name", _S),
    ("targeting_type", _S), ("bid_strategy", _S),
)

QUALITY_RESULTS = _schema(
    ("check_id", _S), ("check_name", _S), ("check_type", _S), ("table_name", _S),
    ("column_name", _S), ("status", _S), ("metric_value", _D), ("threshold", _D),
    ("details", _S), ("checked_at", _TS), ("batch_id", _S),
)

_LOADED, _BATCH = ("_loaded_at", _TS), ("_batch_id", _S)
_BRONZE_AUDIT = (_LOADED, ("_source_file", _S), ("_source_modified", _TS), _BATCH)
_MONEY = T.DecimalType(38, 10)


def _fields(schema: T.StructType) -> list[tuple]:
    return [(f.name, f.dataType) for f in schema.fields]


SILVER_ADS = _schema(
    *_fields(ADS_PERFORMANCE), ("ctr", _D), ("cpc", _D), ("cpa", _D), ("roas", _D), ("conversion_rate", _D),
    ("campaign_name", _S), ("objective", _S), ("budget_daily", _D), ("adgroup_name", _S), ("targeting_type", _S),
    ("bid_strategy", _S), _LOADED, _BATCH,
)

SILVER_GA = _schema(
    ("date", _DATE), ("hour", _I), ("event_name", _S), ("event_category", _S), ("session_id", _S), ("user_id", _S),
    ("page", _S), ("source", _S), ("medium", _S), ("campaign_id", _S), ("is_bounce", _B), _LOADED, _BATCH,
)

GOLD_CAMPAIGN_DAILY = _schema(
    ("date", _DATE), ("campaign_id", _S), ("campaign_name", _S), ("channel", _S), ("objective", _S),
    ("total_impressions", _L), ("total_clicks", _L), ("total_spend", _D), ("total_conversions", _L), ("total_revenue", _D),
    ("avg_ctr", _D), ("avg_cpc", _D), ("avg_cpa", _D), ("avg_roas", _D), ("avg_conversion_rate", _D), _LOADED,
)

GOLD_CHANNEL_DAILY = _schema(
    ("date", _DATE), ("channel", _S), ("total_impressions", _L), ("total_clicks", _L), ("total_spend", _D),
    ("total_conversions", _L), ("total_revenue", _D), ("avg_ctr", _D), ("avg_cpc", _D), ("avg_roas", _D),
    ("campaign_count", _L), _LOADED,
)

GOLD_HOURLY_TRENDS = _schema(
    ("date", _DATE), ("hour", _I), ("channel", _S), ("total_impressions", _L), ("total_clicks", _L),
    ("total_spend", _D), ("total_conversions", _L), ("total_revenue", _D), ("avg_ctr", _D), _LOADED,
)

GOLD_FUNNEL_SUMMARY = _schema(
    ("date", _DATE), ("campaign_id", _S), ("campaign_name", _S), ("total_impressions", _L), ("total_clicks", _L),
    ("total_conversions", _L), ("impression_to_click_rate", _D), ("click_to_conversion_rate", _D),
    ("overall_conversion_rate", _D), _LOADED,
)

STAGE_ADS_HOURLY = _schema(
    ("date", _DATE), ("hour", _I), ("campaign_id", _S), ("campaign_name", _S), ("channel", _S), ("objective", _S),
    ("impressions", _L), ("clicks", _L), ("conversions", _L), ("spend_exact", _MONEY), ("revenue_exact", _MONEY),
)

# Kept state: rows add up, so a slice is taken back by negative ones.
STAGE_SESSION_DAYS = _schema(("session_id", _S), ("date", _DATE), ("n", _L), ("bucket", _I))
_SQUARES = T.DecimalType(38, 12)
STAGE_ADS_MOMENTS = _schema(("column_name", _S), ("date", _DATE), ("n", _L), ("s1", _SQUARES), ("s2", _SQUARES))
STAGE_CAMPAIGN_IDS = _schema(("campaign_id", _S), ("id", _L))
STAGE_CAMPAIGN_BITMAPS = _schema(("date", _DATE), ("channel", _S), ("bucket", _L), ("bitmap", T.BinaryType()))
STAGE_JOB_LEDGER = _schema(("batch_id", _S), ("slice", _S), ("run", _I), ("stage", _S), ("at", _TS))

SOURCES = {
    "bronze_ads_performance": ADS_PERFORMANCE,
    "bronze_ga_events": GA_EVENTS,
    "bronze_campaigns": CAMPAIGNS,
    "bronze_adgroups": ADGROUPS,
}

# Every table of a warehouse and the column it is partitioned by.
TABLES = {
    "bronze_ads_performance": (_schema(*_fields(ADS_PERFORMANCE), *_BRONZE_AUDIT), "date"),
    "bronze_ga_events": (_schema(*_fields(GA_EVENTS), *_BRONZE_AUDIT), "date"),
    "bronze_campaigns": (_schema(*_fields(CAMPAIGNS), *_BRONZE_AUDIT), None),
    "bronze_adgroups": (_schema(*_fields(ADGROUPS), *_BRONZE_AUDIT), None),
    "silver_ads_performance": (SILVER_ADS, "date"),
    "silver_ga_events": (SILVER_GA, "date"),
    "gold_campaign_daily": (GOLD_CAMPAIGN_DAILY, "date"),
    "gold_channel_daily": (GOLD_CHANNEL_DAILY, "date"),
    "gold_hourly_trends": (GOLD_HOURLY_TRENDS, "date"),
    "gold_funnel_summary": (GOLD_FUNNEL_SUMMARY, "date"),
    "quality_check_results": (QUALITY_RESULTS, "batch_id"),
    "stage_ads_hourly": (STAGE_ADS_HOURLY, "date"),
    "stage_session_days": (STAGE_SESSION_DAYS, "bucket"),
    "stage_ads_moments": (STAGE_ADS_MOMENTS, None),
    "stage_campaign_ids": (STAGE_CAMPAIGN_IDS, None),
    "stage_campaign_bitmaps": (STAGE_CAMPAIGN_BITMAPS, "date"),
    "stage_job_ledger": (STAGE_JOB_LEDGER, None),
}

# Columns that an insert may leave out, with the SQL of their defaults.
DEFAULTS = {t: {"_loaded_at": "CURRENT_TIMESTAMP()"} for t, (schema, _) in TABLES.items() if "_loaded_at" in schema.names}
