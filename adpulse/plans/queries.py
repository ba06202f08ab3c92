"""Registered queries: one lazy DataFrame per operator, over the driver tables.

Every query starts from the adapters over the whole input tables and runs
the library's own operators; nothing is filtered, sampled or capped except
where the limit is the feature (top-k reports).
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adpulse.config import SOURCE_MAP
from adpulse.operators import gold, insights, quality, reports, silver
from adpulse.operators.common import drop_audit
from adpulse.plans import pipeline
from adpulse.session import scratch_path
from adpulse.sources import schemas
from adpulse.sources.adapters import driver_sources
from adpulse.sources.extracts import read_extract, read_extract_dates, read_extracts, write_extract
from adpulse.sources.warehouse import Warehouse

BATCH_ID = "oracle_batch"
AS_OF = "2024-02-01 00:00:00"


class Layers:
    """Lazily built silver and gold frames for one ``sf_dir``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.src = driver_sources(spark, sf_dir)
        self._silver_ads: DataFrame | None = None

    @property
    def silver_ads(self) -> DataFrame:
        if self._silver_ads is None:
            s = self.src
            self._silver_ads = silver.transform_ads(
                s["bronze_ads_performance"], s["bronze_campaigns"], s["bronze_adgroups"]
            )
        return self._silver_ads

    @property
    def silver_ga(self) -> DataFrame:
        return silver.transform_events(self.src["bronze_ga_events"])

    def gold(self, name: str) -> DataFrame:
        build, _ = gold.BUILDERS[name]
        return build(gold.measures(self.silver_ads))

    def tables(self) -> dict[str, DataFrame]:
        return {
            "silver_ads_performance": self.silver_ads,
            "silver_ga_events": self.silver_ga,
            "gold_campaign_daily": self.gold("gold_campaign_daily"),
            "bronze_campaigns": self.src["bronze_campaigns"],
        }


Query = Callable[[SparkSession, str], DataFrame]


def _on(fn: Callable[[Layers], DataFrame]) -> Query:
    return lambda spark, sf_dir: fn(Layers(spark, sf_dir))


def _report(fn, table: str, **kw) -> Query:
    return _on(lambda L: fn(L.gold(table), reports.ALL, **kw))


def _checks(kind: str | None) -> Query:
    def run(L: Layers) -> DataFrame:
        suite = [c for c in quality.standard_suite() if kind is None or c.kind == kind]
        return quality.run_checks(L.tables(), suite, batch_id=BATCH_ID, as_of=AS_OF).drop("checked_at")
    return _on(run)


def _audit_log(L: Layers) -> DataFrame:
    res = quality.run_checks(L.tables(), batch_id=BATCH_ID, as_of=AS_OF)
    return quality.audit_log(res, "validity").drop("checked_at")


def _summary(L: Layers) -> DataFrame:
    return quality.summary(quality.run_checks(L.tables(), batch_id=BATCH_ID, as_of=AS_OF))


def _filtered_scope(L: Layers) -> DataFrame:
    cd = L.gold("gold_campaign_daily")
    return reports.filtered_scope(cd, reports.default_filters(cd))


def _campaign_filtered(L: Layers) -> DataFrame:
    return reports.filtered_scope(L.gold("gold_campaign_daily"), reports.Filters(campaigns=["CMP001", "CMP004"]))


def _gate(L: Layers) -> DataFrame:
    return quality.gate(quality.run_checks(L.tables(), batch_id=BATCH_ID, as_of=AS_OF))


def _fresh_warehouse(spark: SparkSession, label: str, pii_salt: str | None = None):
    """A new warehouse in the shared folder; monthly partitions, for the driver's few rows a day."""
    name = f"{label}_{uuid.uuid4().hex[:10]}"
    return Warehouse(spark, database=name, location=scratch_path(spark, name), grain="month", pii_salt=pii_salt)


def _date_span(df: DataFrame) -> tuple:
    """(min, max) date of a source: two scalars, the job's parameters."""
    r = df.agg(F.min("date").alias("lo"), F.max("date").alias("hi")).first()
    return r["lo"], r["hi"]


def _undated(df: DataFrame, pick) -> DataFrame:
    """The source and, once more without a date, the rows that ``pick`` chooses."""
    return df.unionByName(df.where(pick).withColumn("date", F.lit(None).cast("date")))


def _spoiled(df: DataFrame, lo, hi, pick, change: dict) -> DataFrame:
    """The source as an earlier run might have loaded it: between two dates some
    rows are missing, some are there twice under another campaign, the rest differ."""
    inside = F.coalesce(F.col("date").between(F.lit(lo), F.lit(hi)), F.lit(False))
    wrong = df.where(inside & ~pick).withColumns(change)
    extra = df.where(inside & ~pick).withColumn("campaign_id", F.lit("CMP_WRONG"))
    return df.where(~inside).unionByName(wrong).unionByName(extra)


def _incremental_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bronze ads after a wrong first load (last date changed, rows missing and extra) and a
    replace of that date from the true source.  Rows without a date must survive it."""
    src = driver_sources(spark, sf_dir)
    ads = _undated(src["bronze_ads_performance"], F.col("_load_seq") % 5000 == 3)
    _, hi = _date_span(ads)
    wrong = _spoiled(ads, hi, hi, F.col("_load_seq") % 3 == 0, {"impressions": F.col("impressions") + 7})
    wh = _fresh_warehouse(spark, "incremental")
    pipeline.ingest_bronze(wh, {"bronze_ads_performance": wrong}, "b1")
    pipeline.ingest_bronze_dates(wh, {"bronze_ads_performance": ads}, [hi], "b2")
    return drop_audit(wh.read("bronze_ads_performance"))


def _incremental_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silver events after the same: wrong on the last date, then that date run again."""
    src = driver_sources(spark, sf_dir)
    ga = _undated(src["bronze_ga_events"], F.col("user_id").endswith("77"))
    _, hi = _date_span(ga)
    wrong = _spoiled(ga, hi, hi, F.col("page") == "/p3", {"source": F.lit("wrong")})
    wh = _fresh_warehouse(spark, "events")
    pipeline.ingest_bronze(wh, {"bronze_ga_events": wrong}, "b1")
    pipeline.build_silver(wh, "b1")
    pipeline.ingest_bronze_dates(wh, {"bronze_ga_events": ga}, [hi], "b2")
    pipeline.build_silver(wh, "b2", [hi])
    return drop_audit(wh.read("silver_ga_events"))


def _backfill_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold channels after a pipeline over a source that is wrong in its last 60 days, and a backfill of these."""
    src = driver_sources(spark, sf_dir)
    ads = src["bronze_ads_performance"]
    _, hi = _date_span(ads)
    lo = hi - dt.timedelta(days=60)
    wrong = dict(src, bronze_ads_performance=_spoiled(ads, lo, hi, F.col("_load_seq") % 3 == 0, {"spend": F.col("spend") * 3}))
    wh = _fresh_warehouse(spark, "backfill")
    pipeline.ingest_bronze(wh, wrong, "b1")
    pipeline.build_silver(wh, "b1")
    pipeline.build_gold(wh)
    pipeline.backfill(wh, src, lo, hi, "b2", as_of=AS_OF)
    return wh.read("gold_channel_daily").drop("_loaded_at")


def _incremental_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checks stored by an incremental run over a warehouse that had none."""
    src = driver_sources(spark, sf_dir)
    wh = _fresh_warehouse(spark, "checked")
    pipeline.run_incremental(wh, src, _date_span(src["bronze_ads_performance"])[1], batch_id=BATCH_ID, as_of=AS_OF)
    return wh.read("quality_check_results").drop("checked_at")


def _pseudonymized_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bronze events of a salted warehouse after a full load and a date run: no raw id is left."""
    ga = driver_sources(spark, sf_dir)["bronze_ga_events"]
    wh = _fresh_warehouse(spark, "salted", pii_salt="pepper")
    pipeline.ingest_bronze(wh, {"bronze_ga_events": ga}, "b1")
    pipeline.ingest_bronze_dates(wh, {"bronze_ga_events": ga}, [_date_span(ga)[1]], "b2")
    return drop_audit(wh.read("bronze_ga_events"))


def _string_dated_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One day of an extract whose dates are text, as the reference writes them."""
    ads = driver_sources(spark, sf_dir)["bronze_ads_performance"]
    path = f"{scratch_path(spark, 'extract')}/ads_performance.parquet"
    write_extract(ads.withColumn("date", F.col("date").cast("string")), path)
    return drop_audit(read_extract_dates(spark, path, schemas.ADS_PERFORMANCE, [_date_span(ads)[1]]))


def _warehouse_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    wh = _fresh_warehouse(spark, "inventory")
    pipeline.run_full(wh, driver_sources(spark, sf_dir), batch_id=BATCH_ID, as_of=AS_OF)
    return wh.inventory()


class _Breaking(Warehouse):
    """A warehouse whose next write of one table fails, as when a cluster is lost."""

    breaks_at: str | None = None

    def replace_dates(self, table, *args, **kw):
        if table == self.breaks_at:
            self.breaks_at = None
            raise RuntimeError(f"broken off before {table}")
        super().replace_dates(table, *args, **kw)


def _replace_interrupted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bronze ads after a load, and a second load whose tasks fail on some of its rows."""
    ads = driver_sources(spark, sf_dir)["bronze_ads_performance"]
    wh = _fresh_warehouse(spark, "interrupted")
    pipeline.ingest_bronze(wh, {"bronze_ads_performance": ads}, "b1")
    broken = ads.withColumn("clicks", F.when(F.col("_load_seq") % 1000 == 1, F.raise_error(F.lit("the write is broken off")).cast("long")).otherwise(F.lit(-1).cast("long")))
    try:
        pipeline.ingest_bronze(wh, {"bronze_ads_performance": broken}, "b2")
    except Exception as e:
        if "the write is broken off" not in str(e):
            raise
    else:
        raise AssertionError("the second load did not fail")
    return drop_audit(wh.read("bronze_ads_performance"))


def _session_state_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept counts per session and day after a wrong load and a run of its last date."""
    ga = _undated(driver_sources(spark, sf_dir)["bronze_ga_events"], F.col("user_id").endswith("77"))
    _, hi = _date_span(ga)
    wrong = _spoiled(ga, hi, hi, F.col("page") == "/p3", {"session_id": F.lit("S_WRONG")})
    wh = _fresh_warehouse(spark, "sessions")
    pipeline.ingest_bronze(wh, {"bronze_ga_events": wrong}, "b1")
    pipeline.build_silver(wh, "b1")
    pipeline.ingest_bronze_dates(wh, {"bronze_ga_events": ga}, [hi], "b2")
    pipeline.build_silver(wh, "b2", [hi])
    return silver.added_up(wh.read(pipeline.SESSIONS_TABLE))


def _corrected(spark: SparkSession, sf_dir: str, label: str, days: int, gold_too: bool) -> Warehouse:
    """A warehouse of ads loaded wrong in its last days, and these run again from the true source."""
    src = driver_sources(spark, sf_dir)
    del src["bronze_ga_events"]
    ads = src["bronze_ads_performance"]
    _, hi = _date_span(ads)
    lo = hi - dt.timedelta(days=days)
    wrong = dict(src, bronze_ads_performance=_spoiled(ads, lo, hi, F.col("_load_seq") % 3 == 0, {"spend": F.col("spend") * 3, "campaign_id": F.lit("CMP_OTHER")}))
    wh = _fresh_warehouse(spark, label)
    dates = [lo + dt.timedelta(days=i) for i in range(days + 1)]
    pipeline.ingest_bronze(wh, wrong, "b1")
    pipeline.build_silver(wh, "b1")
    if gold_too:
        pipeline.build_gold(wh)
    pipeline.ingest_bronze_dates(wh, src, dates, "b2")
    pipeline.build_silver(wh, "b2", dates)
    if gold_too:
        pipeline.build_gold(wh, dates)
    return wh


def _distinct_campaigns_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct campaigns of each channel over several windows, from the kept bitmaps."""
    wh = _corrected(spark, sf_dir, "distinct", 40, True)
    _, hi = wh.bounds("gold_campaign_daily")
    parts = [pipeline.distinct_campaigns(wh).select(F.lit(0).alias("days"), "channel", "campaign_count")]
    for days in (1, 2, 31, 365):
        found = pipeline.distinct_campaigns(wh, hi - dt.timedelta(days=days - 1), hi)
        parts.append(found.select(F.lit(days).alias("days"), "channel", "campaign_count"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _zscore_from_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The anomaly checks with mean and deviation from the state kept, after a slice of it was replaced."""
    wh = _corrected(spark, sf_dir, "moments", 40, False)
    suite = [c for c in quality.standard_suite() if c.kind == "zscore"]
    stats = pipeline.scored_stats(wh)
    return quality.run_checks({"silver_ads_performance": wh.read("silver_ads_performance")}, suite, batch_id=BATCH_ID, as_of=AS_OF, stats=stats).drop("checked_at")


def _freshness_from_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The freshness checks of a built warehouse, answered from its metadata."""
    wh = _fresh_warehouse(spark, "metadata")
    pipeline.ingest_bronze(wh, driver_sources(spark, sf_dir), "b1")
    pipeline.build_silver(wh, "b1")
    pipeline.build_gold(wh)
    return pipeline.check_freshness(wh, BATCH_ID, AS_OF).drop("checked_at")


def _backfill_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold channels after a backfill broken off once bronze was committed, and the same job again.

    The second call's source holds no ads at all: bronze is not read from it again.
    """
    src = driver_sources(spark, sf_dir)
    ads = src["bronze_ads_performance"]
    _, hi = _date_span(ads)
    lo = hi - dt.timedelta(days=60)
    name = f"resumed_{uuid.uuid4().hex[:10]}"
    wh = _Breaking(spark, database=name, location=scratch_path(spark, name), grain="month")
    wrong = dict(src, bronze_ads_performance=_spoiled(ads, lo, hi, F.col("_load_seq") % 3 == 0, {"spend": F.col("spend") * 3}))
    pipeline.ingest_bronze(wh, wrong, "b1")
    pipeline.build_silver(wh, "b1")
    pipeline.build_gold(wh)
    wh.breaks_at = "silver_ads_performance"
    try:
        pipeline.backfill(wh, src, lo, hi, "job", as_of=AS_OF)
    except RuntimeError as e:
        if "broken off" not in str(e):
            raise
    pipeline.backfill(wh, dict(src, bronze_ads_performance=ads.limit(0)), lo, hi, "job", as_of=AS_OF)
    return wh.read("gold_channel_daily").drop("_loaded_at")


def _retention_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bronze ads after 90 days' retention, the day after their last date."""
    ads = driver_sources(spark, sf_dir)["bronze_ads_performance"]
    wh = _fresh_warehouse(spark, "retention")
    pipeline.ingest_bronze(wh, {"bronze_ads_performance": ads}, "b1")
    _, hi = wh.bounds("bronze_ads_performance")
    pipeline.apply_retention(wh, "bronze_ads_performance", hi + dt.timedelta(days=1), days=90)
    return drop_audit(wh.read("bronze_ads_performance"))


def _bronze_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extract of several files, one channel in each: what the lineage of bronze says of every file, by channel."""
    ads = driver_sources(spark, sf_dir)["bronze_ads_performance"]
    folder = scratch_path(spark, "extract")
    for channel in ("Google Ads", "Facebook Ads", "TikTok Ads"):
        ads.where(F.col("channel") == channel).write.mode("append").parquet(f"{folder}/ads_performance.parquet")
    wh = _fresh_warehouse(spark, "lineage")
    pipeline.ingest_bronze(wh, read_extracts(spark, folder), "b1")
    file = F.col("_source_file")
    by_file = (wh.read("bronze_ads_performance").groupBy("_source_file")
               .agg(F.min("channel").alias("channel"), F.count_distinct("channel").alias("channels"), F.count(F.lit(1)).alias("n"), F.count("_source_modified").alias("timed")))
    named = file.startswith("ads_performance.parquet/") & file.endswith(".parquet")
    return by_file.groupBy("channel").agg(F.max("channels").alias("channels_in_a_file"), F.sum("n").alias("rows_loaded"), F.sum("timed").alias("rows_with_time"),
                                          F.bool_and(named).alias("files_named"))


SCRIPT = """BEGIN
  DECLARE mark STRING DEFAULT '; all days';
  DECLARE EXIT HANDLER FOR SQLEXCEPTION BEGIN DROP TABLE IF EXISTS gold_channel_notes; END;
  DROP TABLE IF EXISTS gold_channel_notes;
  CREATE TABLE gold_channel_notes (channel STRING, note STRING, total_clicks BIGINT) USING parquet;  -- a comment; with a semicolon
  INSERT INTO gold_channel_notes
    SELECT channel, concat(channel, mark), SUM(clicks) FROM bronze_ads_performance GROUP BY channel;
  IF (SELECT COUNT(*) FROM gold_channel_notes) > 1 THEN
    INSERT INTO gold_channel_notes SELECT 'all', 'every channel; every day', SUM(total_clicks) FROM gold_channel_notes;
  END IF;
END"""


def _script_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gold table built by one script: a local variable, a handler, a condition, and semicolons in literals."""
    wh = _fresh_warehouse(spark, "script")
    pipeline.ingest_bronze(wh, {"bronze_ads_performance": driver_sources(spark, sf_dir)["bronze_ads_performance"]}, "b1")
    wh.execute_script(SCRIPT)
    return wh.read("gold_channel_notes")


def _declared_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extract of narrower types than declared, read by the declared ones after a look at its footers."""
    ads = driver_sources(spark, sf_dir)["bronze_ads_performance"]
    path = f"{scratch_path(spark, 'declared')}/ads_performance.parquet"
    write_extract(ads.withColumns({"hour": F.col("hour").cast("short"), "impressions": F.col("impressions").cast("int")}), path)
    return drop_audit(read_extract(spark, path, schemas.ADS_PERFORMANCE))


def _source_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A load from a folder that lacks two of the four extracts: what bronze holds of each source."""
    src = driver_sources(spark, sf_dir)
    folder = scratch_path(spark, "missing")
    for table in ("bronze_ads_performance", "bronze_campaigns"):
        write_extract(src[table], f"{folder}/{SOURCE_MAP[table]}")
    wh = _fresh_warehouse(spark, "missing")
    pipeline.ingest_bronze(wh, read_extracts(spark, folder), "b1")
    out = None
    for table, file in SOURCE_MAP.items():
        n = wh.read_or_empty(table).agg(F.count(F.lit(1)).alias("row_count"))
        row = n.select(F.lit(table).alias("table_name"), F.lit(file).alias("source_file"), F.lit(wh.exists(table)).alias("loaded"), "row_count")
        out = row if out is None else out.unionByName(row)
    return out


def _results_by_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored results after one batch was saved twice, and another once."""
    tables = {"gold_campaign_daily": Layers(spark, sf_dir).gold("gold_campaign_daily")}
    suite = [c for c in quality.standard_suite() if c.kind == "row_count"]
    wh = _fresh_warehouse(spark, "batches")
    for batch in ("b1", "b1", "b2"):
        wh.replace_where("quality_check_results", quality.run_checks(tables, suite, batch_id=batch, as_of=AS_OF), "batch_id", schema=schemas.QUALITY_RESULTS)
    return wh.read("quality_check_results").select("batch_id", "check_name", "table_name", "status", "metric_value")


def _warehouse_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row count, a query with a bound parameter, and a table that is not there."""
    wh = _fresh_warehouse(spark, "access")
    pipeline.ingest_bronze(wh, {"bronze_ads_performance": driver_sources(spark, sf_dir)["bronze_ads_performance"]}, "b1")
    counted = spark.range(1).select(F.lit("row_count").alias("what"), F.lit(wh.row_count("bronze_ads_performance")).cast("long").alias("n"))
    asked = wh.execute("SELECT 'execute' AS what, COUNT(*) AS n FROM bronze_ads_performance WHERE channel = :channel", {"channel": "Google Ads"})
    absent = wh.read_or_empty("gold_channel_daily").agg(F.count("campaign_count").alias("n")).select(F.lit("absent").alias("what"), "n")
    return counted.unionByName(asked).unionByName(absent)


def _d_minus_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold channels after a load that is wrong on its last date, and the run of yesterday on the day after."""
    src = driver_sources(spark, sf_dir)
    ads = src["bronze_ads_performance"]
    _, hi = _date_span(ads)
    wrong = dict(src, bronze_ads_performance=_spoiled(ads, hi, hi, F.col("_load_seq") % 3 == 0, {"clicks": F.col("clicks") + 1}))
    wh = _fresh_warehouse(spark, "yesterday")
    pipeline.ingest_bronze(wh, wrong, "b1")
    pipeline.build_silver(wh, "b1")
    pipeline.build_gold(wh)
    pipeline.run_d_minus_1(wh, src, as_of=dt.datetime.combine(hi + dt.timedelta(days=1), dt.time(6)))
    return wh.read("gold_channel_daily").drop("_loaded_at")


def _backfill_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What backfills without a date, or with the dates the wrong way round, say, and the rows they leave."""
    src = {"bronze_ads_performance": driver_sources(spark, sf_dir)["bronze_ads_performance"]}
    wh = _fresh_warehouse(spark, "arguments")
    pipeline.ingest_bronze(wh, src, "b1")
    lo, hi = wh.bounds("bronze_ads_performance")
    out = None
    for case, dates in (("no start", (None, hi)), ("no end", (lo, None)), ("reversed", (hi, lo))):
        try:
            pipeline.backfill(wh, src, *dates)
            said = "accepted"
        except ValueError:
            said = "refused"
        row = wh.read("bronze_ads_performance").agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(case).alias("case_name"), F.lit(said).alias("outcome"), "row_count")
        out = row if out is None else out.unionByName(row)
    return out


CD, CH = "gold_campaign_daily", "gold_channel_daily"

QUERIES: dict[str, Query] = {
    "silver_ads_dedup": _on(lambda L: silver.dedup_latest(L.src["bronze_ads_performance"])),
    "silver_ads_kpis": _on(lambda L: L.silver_ads),
    "silver_ga_events": _on(lambda L: L.silver_ga),
    "gold_campaign_daily": _on(lambda L: L.gold("gold_campaign_daily")),
    "gold_channel_daily": _on(lambda L: L.gold("gold_channel_daily")),
    "gold_hourly_trends": _on(lambda L: L.gold("gold_hourly_trends")),
    "gold_funnel_summary": _on(lambda L: L.gold("gold_funnel_summary")),
    "headline_kpis": _report(reports.headline_kpis, CD),
    "daily_channel_revenue": _report(reports.daily_channel_revenue, CH),
    "channel_revenue_share": _report(reports.channel_revenue_share, CH),
    "channel_spend_share": _report(reports.channel_spend_share, CH),
    "daily_spend_vs_revenue": _report(reports.daily_spend_vs_revenue, CH),
    "top_campaigns": _report(reports.top_campaigns, CD),
    "campaign_channel_revenue": _report(reports.campaign_channel_revenue, CD),
    "campaign_roas_top": _report(reports.campaign_roas_top, CD),
    "campaign_cpa_lowest": _report(reports.campaign_cpa_lowest, CD),
    "campaign_scope_kpis": _report(reports.campaign_scope_kpis, CD),
    "best_campaign": _report(reports.best_campaign, CD),
    "funnel_totals": _report(reports.funnel_totals, CD),
    "campaign_drilldown": _report(reports.campaign_drilldown, CD),
    "channel_scorecard": _report(reports.channel_scorecard, CH),
    "hour_channel_ctr": _report(reports.hour_channel_ctr, "gold_hourly_trends"),
    "hour_channel_heatmap": _report(reports.hour_channel_heatmap, "gold_hourly_trends"),
    "filter_values": _on(lambda L: reports.filter_values(L.gold(CD))),
    "date_bounds": _on(lambda L: reports.date_bounds(L.gold(CD))),
    "filtered_scope": _on(_filtered_scope),
    "campaign_filtered": _on(_campaign_filtered),
    "dq_completeness": _checks("completeness"),
    "dq_non_negative": _checks("non_negative"),
    "dq_range": _checks("range"),
    "dq_row_count": _checks("row_count"),
    "dq_referential": _checks("referential"),
    "dq_zscore": _checks("zscore"),
    "dq_freshness": _checks("freshness"),
    "dq_suite": _checks(None),
    "dq_summary": _on(_summary),
    "dq_audit_log": _on(_audit_log),
    "dq_gate": _on(_gate),
    "volume_vs_trailing_avg": _on(lambda L: insights.volume_vs_trailing_avg(L.silver_ads, "silver_ads_performance")),
    "hourly_spikes": _on(lambda L: insights.hourly_spikes(L.silver_ads)),
    "attribution_gap": _on(lambda L: insights.attribution_gap(L.silver_ga)),
    "peak_conversion_hours": _on(lambda L: insights.peak_conversion_hours(L.gold("gold_hourly_trends"))),
    "budget_reallocation": _on(lambda L: insights.budget_reallocation(L.gold(CH))),
    "silver_ads_quarantine": _on(lambda L: insights.quarantine_split(L.silver_ads)[1]),
    "incremental_replace": _incremental_replace,
    "incremental_events": _incremental_events,
    "incremental_checked": _incremental_checked,
    "backfill_range": _backfill_range,
    "pseudonymized_events": _pseudonymized_events,
    "string_dated_slice": _string_dated_slice,
    "warehouse_inventory": _warehouse_inventory,
    "replace_interrupted": _replace_interrupted,
    "session_state_merge": _session_state_merge,
    "freshness_from_metadata": _freshness_from_metadata,
    "distinct_campaigns_range": _distinct_campaigns_range,
    "zscore_from_state": _zscore_from_state,
    "backfill_resumed": _backfill_resumed,
    "retention_applied": _retention_applied,
    "bronze_lineage": _bronze_lineage,
    "script_rebuild": _script_rebuild,
    "declared_scan": _declared_scan,
    "source_missing": _source_missing,
    "results_by_batch": _results_by_batch,
    "warehouse_access": _warehouse_access,
    "d_minus_1": _d_minus_1,
    "backfill_arguments": _backfill_arguments,
}
