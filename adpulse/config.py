"""Contract constants: thresholds, batch-id format, table names.

The values under "fixed values" must equal the reference's for results to
match; they are stated here once, in natural order.
"""

from __future__ import annotations

# --- fixed values (must equal the reference) -------------------------------
BATCH_ID_FORMAT = "%Y%m%d_%H%M%S"
MAX_NULL_PCT = 0.01          # completeness: null share allowed per column
ROAS_MAX = 50.0              # range check upper bound on silver roas
ZSCORE_THRESHOLD = 3.0       # anomaly: |z| strictly above this is an outlier
MIN_DAILY_ROWS = 100         # row-count consistency floor (table total)
MAX_STALENESS_HOURS = 48     # freshness SLA
CONVERSION_EVENTS = ["purchase", "add_to_cart", "begin_checkout", "sign_up"]
ENGAGEMENT_EVENTS = ["page_view", "scroll", "click", "video_start", "video_complete", "file_download"]
NAVIGATION_EVENTS = ["session_start", "login"]
HEALTHY_ROAS = 2.5           # executive headline label threshold
TARGET_ROAS = 2.0            # campaign page label threshold
OUTLIER_PASS, OUTLIER_WARN = 0.02, 0.05    # anomaly: share of outliers below which it passes / warns
RANGE_WARN = 0.01            # range check: share of violations below which it warns
SCORE_HEALTHY, SCORE_AT_RISK = 90, 70      # governance index bands on the pass rate, percent
ADS_KEYS = ["date", "hour", "campaign_id", "adgroup_id", "channel"]   # grain of the silver ads table
ROAS_LABELS = ("HEALTHY", "REBALANCING NEEDED")       # executive headline: above the threshold, and not
TARGET_LABELS = ("TARGET MET", "SUB-OPTIMAL")         # campaign page
MESSAGES = {                 # texts of check results; {} stands for a figure or a name
    "completeness": "Detected {} nulls in {} rows",
    "completeness_empty": "Null count impossible: Table is empty",
    "non_negative": "Illegal negative values detected ({} instances)",
    "range": "Target range [{}, {}] - Violations: {}",
    "row_count": "Current volume: {} (Baseline: {})",
    "freshness": "Latency: {}h (SLA Boundary: {}h)",
    "freshness_empty": "Incomplete batch: No date markers found",
    "zscore": "Outlier density: {}% ({} rows)",
    "zscore_flat": "Invariance detected (zero variance baseline)",
    "referential": "Detected {} orphaned identifiers in {}",
}
SOURCE_MAP = {               # source extract per bronze table
    "bronze_ads_performance": "ads_performance.parquet",
    "bronze_ga_events": "ga_events.parquet",
    "bronze_campaigns": "campaigns.parquet",
    "bronze_adgroups": "adgroups.parquet",
}
FACT_TABLES = ["bronze_ads_performance", "bronze_ga_events"]
RESULTS_TABLE = "quality_check_results"
# --- end fixed values --------------------------------------------------------

# Sums of money are exact: values become decimals of this type before they are
# added, and only the total is rounded.
MONEY_TYPE = "decimal(28,10)"

# Tables that only the jobs use; the inventory leaves them out.
STAGE_PREFIX = "stage_"
