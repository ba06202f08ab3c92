"""Jobs over a real warehouse at sf0.001: layers, audit columns, idempotence."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from adpulse.operators.common import drop_audit
from adpulse.plans import pipeline
from adpulse.session import scratch_path
from adpulse.sources.adapters import driver_sources
from adpulse.sources.extracts import read_extracts, write_extract
from adpulse.sources.warehouse import Warehouse
from tests.conftest import SF_SMALL


def _wh(spark, label, grain="month", **options):
    path = scratch_path(spark, label)
    return Warehouse(spark, database=os.path.basename(path).replace("-", "_"), location=path, grain=grain, **options)


def _rows(df):
    """Rows in a canonical column order (a daily-grain table keeps ``date`` last)."""
    rows = [tuple(r) for r in df.select(*sorted(df.columns)).collect()]
    return sorted(rows, key=lambda t: tuple((x is None, str(x)) for x in t))


def _sources(spark, days=75):
    """The driver's sources, the facts over their last days (a warehouse of whole history has thousands of partitions)."""
    src = driver_sources(spark, SF_SMALL)
    for t in ("bronze_ads_performance", "bronze_ga_events"):
        hi = src[t].agg(F.max("date")).first()[0]
        src[t] = src[t].where(F.col("date") > F.lit(hi - dt.timedelta(days=days)))
    return src


@pytest.fixture(scope="module")
def full(spark):
    wh = _wh(spark, "full")
    src = _sources(spark)
    res = pipeline.run_full(wh, src, batch_id="test_batch", as_of="2024-02-01 00:00:00")
    return wh, src, res


def test_layers_and_audit_columns(full):
    wh, _, res = full
    tables = set(wh.tables())
    for t in ["bronze_ads_performance", "bronze_ga_events", "bronze_campaigns", "bronze_adgroups",
              "silver_ads_performance", "silver_ga_events", "gold_campaign_daily", "gold_channel_daily",
              "gold_hourly_trends", "gold_funnel_summary", "quality_check_results"]:
        assert t in tables
    assert {"_loaded_at", "_source_file", "_batch_id"} <= set(wh.read("bronze_ads_performance").columns)
    assert {"ctr", "cpc", "cpa", "roas", "conversion_rate", "campaign_name", "objective"} <= set(
        wh.read("silver_ads_performance").columns)
    assert {"event_category", "is_bounce"} <= set(wh.read("silver_ga_events").columns)
    assert {"date", "campaign_id", "channel", "total_impressions", "total_clicks", "total_spend",
            "total_revenue", "avg_roas"} <= set(wh.read("gold_campaign_daily").columns)
    assert wh.read("gold_channel_daily").select("channel").distinct().count() == 3
    assert res.summary["total"] == 28 and set(res.summary) == {"total", "passed", "warned", "failed", "pass_rate"}
    assert wh.read("quality_check_results").where(F.col("batch_id") == "test_batch").count() == 28


def test_rerunning_checks_replaces_the_batch(full):
    wh, _, _ = full
    pipeline.run_quality(wh, "test_batch", as_of="2024-02-01 00:00:00")
    pipeline.run_quality(wh, "other_batch", as_of="2024-02-01 00:00:00")
    counts = {r.batch_id: r["count"] for r in wh.read("quality_check_results").groupBy("batch_id").count().collect()}
    assert counts == {"test_batch": 28, "other_batch": 28}


def test_gate_raises_on_fail(full):
    from adpulse.operators.quality import QualityGateError
    wh, _, _ = full
    with pytest.raises(QualityGateError):      # negative spend is present in the fixture
        pipeline.run_quality(wh, "gate_batch", as_of="2024-02-01 00:00:00", gate=True)


def test_inventory(full):
    wh, _, _ = full
    inv = {r.table_name: (r.row_count, r.layer) for r in wh.inventory().collect()}
    assert inv["bronze_ads_performance"][1] == "BRONZE" and inv["gold_channel_daily"][1] == "GOLD"
    assert inv["silver_ads_performance"][0] == wh.row_count("silver_ads_performance")


@pytest.mark.parametrize("grain", ["day", "month"])
def test_slice_replace_is_idempotent_and_drops_empty_dates(spark, grain):
    wh = _wh(spark, "slice", grain)
    src = _sources(spark)
    pipeline.ingest_bronze(wh, src, "b1")
    before = _rows(drop_audit(wh.read("bronze_ads_performance")))
    hi = src["bronze_ads_performance"].agg(F.max("date")).first()[0]
    pipeline.ingest_bronze_dates(wh, src, [hi], "b2")
    pipeline.ingest_bronze_dates(wh, src, [hi], "b3")
    assert _rows(drop_audit(wh.read("bronze_ads_performance"))) == before
    # The source loses that date entirely: the slice must end empty (DELETE semantics).
    gone = {k: (v.where(F.col("date") != F.lit(hi)) if k in ("bronze_ads_performance", "bronze_ga_events") else v)
            for k, v in src.items()}
    pipeline.ingest_bronze_dates(wh, gone, [hi], "b4")
    assert wh.read("bronze_ads_performance").where(F.col("date") == F.lit(hi)).count() == 0
    assert hi not in wh.partition_dates("bronze_ads_performance")
    assert wh.grain_of("bronze_ads_performance") == grain


@pytest.mark.parametrize("grain", ["day", "month"])
def test_backfill_equals_full_build(spark, full, grain):
    wh_full, src, _ = full
    wh = _wh(spark, "backfill", grain)
    pipeline.ingest_bronze(wh, src, "b1")
    pipeline.build_silver(wh, "b1")
    pipeline.build_gold(wh)
    days = sorted(pipeline._date(r[0]) for r in src["bronze_ads_performance"].select("date").distinct().collect())
    pipeline.backfill(wh, src, days[-20], days[-1])          # crosses month boundaries
    pipeline.run_incremental(wh, src, days[-1])
    for t in ["silver_ads_performance", "gold_campaign_daily", "gold_channel_daily", "gold_hourly_trends", "stage_ads_hourly"]:
        assert _rows(drop_audit(wh.read(t))) == _rows(drop_audit(wh_full.read(t))), t


def test_first_incremental_falls_back_to_full(spark):
    wh = _wh(spark, "first")
    src = _sources(spark)
    pipeline.run_incremental(wh, src, "1998-01-01", "b1")
    assert wh.exists("gold_channel_daily")
    assert wh.row_count("bronze_ads_performance") == src["bronze_ads_performance"].count()


def test_backfill_validation(spark, full):
    wh, src, _ = full
    with pytest.raises(ValueError):
        pipeline.backfill(wh, src, None, "2024-01-01")
    with pytest.raises(ValueError):
        pipeline.backfill(wh, src, "2024-01-02", "2024-01-01")


def test_extracts_roundtrip_and_missing_source(spark):
    d = scratch_path(spark, "extracts")
    src = _sources(spark)
    write_extract(src["bronze_campaigns"], f"{d}/campaigns.parquet")
    got = read_extracts(spark, d)
    assert list(got) == ["bronze_campaigns"]                    # the three missing files are skipped
    assert _rows(drop_audit(got["bronze_campaigns"])) == _rows(src["bronze_campaigns"])


def test_d_minus_1_uses_as_of(spark, full):
    wh, src, _ = full
    before = _rows(drop_audit(wh.read("gold_channel_daily")))
    pipeline.run_d_minus_1(wh, src, as_of=dt.datetime(1998, 8, 3, 6, 0))
    assert _rows(drop_audit(wh.read("gold_channel_daily"))) == before


def test_execute_with_parameters(full):
    wh, _, _ = full
    n = wh.execute("SELECT COUNT(*) AS n FROM gold_channel_daily WHERE channel = :ch", {"ch": "Google Ads"}).first().n
    assert n == wh.read("gold_channel_daily").where(F.col("channel") == "Google Ads").count()
    wh.execute_script("CREATE TABLE IF NOT EXISTS scratch_t (x INT, y STRING) USING parquet; INSERT INTO scratch_t VALUES (1, 'a;b'), (2, NULL) -- ;")
    assert sorted((r.x, r.y) for r in wh.read("scratch_t").collect()) == [(1, "a;b"), (2, None)]


def test_retention_daily_drops_partitions(spark):
    wh = _wh(spark, "retention_day", "day")
    src = _sources(spark)
    pipeline.ingest_bronze(wh, {"bronze_ads_performance": src["bronze_ads_performance"]}, "b1")
    dates = sorted(wh.partition_dates("bronze_ads_performance"))
    removed = pipeline.apply_retention(wh, "bronze_ads_performance", dates[-1] + dt.timedelta(days=90), days=90)
    assert removed == dates[:-1] and wh.partition_dates("bronze_ads_performance") == [dates[-1]]


def test_retention_and_quarantine(spark):
    wh = _wh(spark, "retention", "month", pii_salt="pepper")
    src = _sources(spark, days=500)                            # negative spend is rare
    pipeline.ingest_bronze(wh, src, "b1")
    assert wh.read("bronze_ga_events").where(F.length("user_id") != 64).count() == 0
    dates = sorted(pipeline._date(r[0]) for r in src["bronze_ads_performance"].select("date").distinct().collect())
    as_of = dates[-1] + dt.timedelta(days=30)
    removed = pipeline.apply_retention(wh, "bronze_ads_performance", as_of, days=45)
    left = wh.read("bronze_ads_performance").agg(F.min("date")).first()[0]
    cutoff = dates[-1] - dt.timedelta(days=15)
    assert removed and max(removed) < cutoff <= left
    pipeline.ingest_bronze(wh, src, "b2")
    pipeline.build_silver(wh, "b2")
    before = wh.row_count("silver_ads_performance")
    n_bad = pipeline.quarantine_silver(wh, "b2")
    assert n_bad > 0 and wh.row_count("silver_ads_performance") == before - n_bad
    assert wh.read("silver_ads_performance").where(F.col("spend") < 0).count() == 0
    bad_date = wh.read("silver_ads_quarantine").agg(F.max("date")).first()[0]
    pipeline.ingest_bronze_dates(wh, src, [bad_date], "b3")
    pipeline.build_silver(wh, "b3", [bad_date])             # the rules hold for later date runs
    assert wh.read("silver_ads_performance").where(F.col("spend") < 0).count() == 0
    assert wh.row_count("silver_ads_quarantine") == n_bad
    assert wh.read("bronze_ga_events").where(F.length("user_id") != 64).count() == 0


@pytest.mark.parametrize("grain", ["day", "month"])
def test_scoped_event_rebuild_handles_sessions_across_days(spark, grain):
    """A session spanning two days loses its day-2 event: its day-1 event becomes a bounce."""
    d1, d2, d3 = dt.date(2024, 1, 31), dt.date(2024, 2, 1), dt.date(2024, 2, 2)
    schema = ("date date, hour int, event_name string, session_id string, user_id string, page string, "
              "source string, medium string, campaign_id string")
    rows = [(d1, 23, "page_view", "S1", "U1", "/", None, None, None),
            (d2, 0, "click", "S1", "U1", "/", None, None, None),
            (d2, 5, "login", "S2", "U2", "/", None, None, None),
            (d3, 1, "page_view", "S3", "U3", "/", None, None, None),
            (d3, 2, "click", "S3", "U3", "/", None, None, None),
            (d2, 6, "login", None, "U4", "/", None, None, None),
            (None, 7, "login", "S4", "U5", "/", None, None, None),     # a session with one undated event
            (d2, 8, "login", "S4", "U5", "/", None, None, None)]
    v1 = spark.createDataFrame(rows, schema)
    v2 = spark.createDataFrame([r for r in rows if not (r[3] in ("S1", "S4") and r[0] == d2)], schema)
    wh = _wh(spark, "events_scope", grain)
    pipeline.ingest_bronze(wh, {"bronze_ga_events": v1}, "b1")
    pipeline.build_silver(wh, "b1")
    assert not wh.read("silver_ga_events").where(F.col("session_id") == "S1").first().is_bounce
    pipeline.ingest_bronze_dates(wh, {"bronze_ga_events": v2}, [d2], "b2")
    rebuilt = pipeline.rebuild_events_for(wh, "b2", [d2])
    assert rebuilt == [d1, d2, None]                           # d3 untouched; the undated event is now a bounce
    from adpulse.operators import silver
    expect = silver.transform_events(v2)
    assert _rows(drop_audit(wh.read("silver_ga_events"))) == _rows(expect)


def test_gate_before_gold_and_dimension_refresh(spark):
    from adpulse.operators.quality import QualityGateError
    wh = _wh(spark, "gate_first")
    src = _sources(spark)
    with pytest.raises(QualityGateError):                    # negative spend in silver stops the run
        pipeline.run_full(wh, src, batch_id="g1", as_of="2024-02-01 00:00:00", gate_before_gold=True)
    assert wh.exists("silver_ads_performance") and not wh.exists("gold_campaign_daily")
    pipeline.build_gold(wh)
    renamed = dict(src)
    renamed["bronze_campaigns"] = src["bronze_campaigns"].withColumn("campaign_name", F.upper("campaign_name"))
    hi = src["bronze_ads_performance"].agg(F.max("date")).first()[0]
    pipeline.run_incremental(wh, renamed, hi, "g2")                               # default: dimensions kept
    assert wh.read("gold_campaign_daily").where(F.col("campaign_name").startswith("CAMPAIGN_")).count() == 0
    pipeline.run_incremental(wh, renamed, hi, "g3", refresh_dimensions=True)
    names = {r[0] for r in wh.read("gold_campaign_daily").select("campaign_name").distinct().collect()}
    assert names and all(n is None or n.startswith("CAMPAIGN_") for n in names)


def test_undated_rows_survive_and_can_be_replaced(spark):
    d1, d2 = dt.date(2024, 1, 1), dt.date(2024, 1, 2)
    schema = "date date, hour int, campaign_id string, adgroup_id string, channel string, impressions long, clicks long, spend double, conversions long, revenue double"
    row = lambda d, n: (d, 1, "C", f"A{n}", "Google Ads", n, 1, 1.0, 1, 2.0)
    for grain in ("day", "month"):
        wh = _wh(spark, f"undated_{grain}", grain)
        pipeline.ingest_bronze(wh, {"bronze_ads_performance": spark.createDataFrame([row(d1, 1), row(d2, 2), row(None, 3)], schema)}, "b1")
        assert set(wh.partition_dates("bronze_ads_performance")) == {d1, d2, None}
        new = spark.createDataFrame([row(d2, 20)], schema)
        pipeline.ingest_bronze_dates(wh, {"bronze_ads_performance": new}, [d2], "b2")
        assert sorted(r.impressions for r in wh.read("bronze_ads_performance").collect()) == [1, 3, 20]
        pipeline.ingest_bronze_dates(wh, {"bronze_ads_performance": new}, [None, d1], "b3")      # both slices end empty
        assert [r.impressions for r in wh.read("bronze_ads_performance").collect()] == [20]


SECOND = """
import sys
from pyspark.sql import functions as F
from adpulse.plans import pipeline
from adpulse.session import local_session
from adpulse.sources import schemas
from adpulse.sources.adapters import driver_sources
from adpulse.sources.warehouse import Warehouse

spark = local_session(cores=2, scratch=True)
wh = Warehouse(spark, "second", sys.argv[1], grain="day")
assert wh.grain_of("silver_ads_performance") == "month" and len(wh.tables()) == 4, wh.tables()
assert wh.read("silver_ads_performance").schema["date"].dataType == schemas.SILVER_ADS["date"].dataType
src = {"bronze_ads_performance": driver_sources(spark, sys.argv[2])["bronze_ads_performance"]}
day = src["bronze_ads_performance"].agg(F.max("date")).first()[0]
pipeline.ingest_bronze_dates(wh, src, [day], "b2")
pipeline.build_silver(wh, "b2", [day])
print("ROWS", wh.row_count("silver_ads_performance"), wh.read("bronze_ads_performance").where("_batch_id = 'b2'").count())
"""


def test_tables_outlive_the_session(spark):
    """One process loads, a second one runs the increment."""
    import subprocess
    import sys
    wh = _wh(spark, "first_process")
    src = _sources(spark)
    pipeline.ingest_bronze(wh, {k: v for k, v in src.items() if k != "bronze_ga_events"}, "b1")
    pipeline.build_silver(wh, "b1")
    day = src["bronze_ads_performance"].agg(F.max("date")).first()[0]
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", SECOND, wh.location, SF_SMALL], capture_output=True, text=True, timeout=300,
                         env={**os.environ, "PYTHONPATH": root})
    n = src["bronze_ads_performance"].where(F.col("date") == F.lit(day)).count()
    wh.refresh()                                              # the other process wrote here meanwhile
    assert f"ROWS {wh.row_count('silver_ads_performance')} {n}" in out.stdout, out.stderr[-2000:]


def test_daily_run_touches_only_its_gold_partitions(spark, full):
    """After a one-day run, only that month of gold has new files."""
    _, src, _ = full
    wh = _wh(spark, "sliced")
    pipeline.ingest_bronze(wh, src, "b1")
    pipeline.build_silver(wh, "b1")
    pipeline.build_gold(wh)
    files = lambda: {r[0] for r in wh._raw("gold_channel_daily").select(F.input_file_name()).distinct().collect()}
    before = files()
    day = pipeline._date(src["bronze_ads_performance"].agg(F.max("date")).first()[0])
    pipeline.build_gold(wh, [day])
    assert {f.split("/")[-2] for f in files() - before} == {f"date_month={day.replace(day=1)}"}


def test_missing_table_is_an_empty_frame_of_its_schema(spark):
    wh = _wh(spark, "empty")
    df = wh.read_or_empty("gold_channel_daily")
    assert df.count() == 0 and "avg_roas" in df.columns and wh.tables() == []
