"""Published versions, kept state, metadata bounds, the job ledger, lineage, contracts."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from adpulse.operators import distinct, moments, quality, reports, silver
from adpulse.operators.common import drop_audit
from adpulse.plans import pipeline
from adpulse.plans.queries import _Breaking
from adpulse.session import scratch_path
from adpulse.sources import schemas
from adpulse.sources.extracts import ExtractTypeError, read_extract, write_extract
from adpulse.sources.warehouse import Warehouse
from tests.test_pipeline import _rows, _sources, _wh

AS_OF = "2024-02-01 00:00:00"
ADS = "date date, hour int, campaign_id string, adgroup_id string, channel string, impressions long, clicks long, spend double, conversions long, revenue double"


def _ads(spark, rows):
    """(date, campaign, channel, spend) rows of ads."""
    return spark.createDataFrame([(d, i, c, f"{c}_{i}", ch, 100, 10, s, 1, 2 * s) for i, (d, c, ch, s) in enumerate(rows)], ADS)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _jobs(spark, work):
    """How many Spark jobs ``work`` starts."""
    sc = spark.sparkContext
    group = f"counted-{id(work)}"
    sc.setJobGroup(group, group)
    try:
        work()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    return len(sc.statusTracker().getJobIdsForGroup(group))


# ---------------------------------------------------------------- publishing
def test_a_broken_replace_leaves_the_table_and_the_session_as_they_were(spark):
    wh = _wh(spark, "broken", "day")
    good = _ads(spark, [(dt.date(2024, 1, d), "C", "Google Ads", 1.0) for d in (1, 2, 3)])
    wh.replace("bronze_ads_performance", good, partition_by="date")
    mode = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    bad = good.withColumn("clicks", F.when(F.col("date") == "2024-01-03", F.raise_error(F.lit("lost")).cast("long")).otherwise(F.lit(7)))
    with pytest.raises(Exception, match="lost"):
        wh.replace("bronze_ads_performance", bad, partition_by="date")
    assert _rows(wh.read("bronze_ads_performance")) == _rows(good)
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == mode
    again = Warehouse(spark, wh.database + "_again", wh.location)                  # another session finds the published version
    assert _rows(again.read("bronze_ads_performance").select(*good.columns)) == _rows(good)
    wh.replace("bronze_ads_performance", good.limit(1), partition_by="date")
    assert wh.row_count("bronze_ads_performance") == 1


def test_versions_before_the_last_go(spark):
    wh = _wh(spark, "versions", "day")
    for n in range(1, 5):
        wh.replace("bronze_campaigns", spark.range(n).select(F.col("id").cast("string").alias("campaign_id")))
        assert wh.row_count("bronze_campaigns") == n
    published, folders = wh._versions("bronze_campaigns")
    assert published == folders == [3, 4] and wh.tables() == ["bronze_campaigns"]


def test_two_jobs_cannot_publish_one_version(spark):
    wh = _wh(spark, "race", "day")
    wh.replace("bronze_campaigns", spark.range(1).select(F.lit("C").alias("campaign_id")))
    with pytest.raises(RuntimeError, match="published by another job"):
        wh._publish("bronze_campaigns", 1, [], None)


def test_inserts_overwrite_their_partitions_whatever_the_session_says(spark):
    wh = _wh(spark, "static", "day")
    wh.replace("bronze_ads_performance", _ads(spark, [(dt.date(2024, 1, d), "C", "Google Ads", 1.0) for d in (1, 2)]), partition_by="date")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "static")
    try:
        wh.replace_dates("bronze_ads_performance", _ads(spark, [(dt.date(2024, 1, 2), "D", "Google Ads", 5.0)]), [dt.date(2024, 1, 2)])
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    assert sorted(r.campaign_id for r in wh.read("bronze_ads_performance").collect()) == ["C", "D"]


def test_dropped_partitions_stay_away_in_another_session(spark):
    wh = _wh(spark, "dropped", "day")
    days = [dt.date(2024, 1, d) for d in (1, 2)]
    pipeline.ingest_bronze(wh, {"bronze_ads_performance": _ads(spark, [(d, "C", "Google Ads", 1.0) for d in days])}, "b1")
    wh.replace_dates("bronze_ads_performance", wh.read("bronze_ads_performance").limit(0), days[:1])
    again = Warehouse(spark, wh.database + "_again", wh.location)
    assert again.partition_dates("bronze_ads_performance") == days[1:]


def test_a_column_left_out_of_an_insert_gets_its_default(spark):
    wh = _wh(spark, "defaults", "day")
    pipeline.ingest_bronze(wh, {"bronze_campaigns": spark.createDataFrame([], schemas.CAMPAIGNS)}, "b1")
    wh.execute("INSERT INTO bronze_campaigns (campaign_id, campaign_name) VALUES ('C1', 'One')")
    row = wh.read("bronze_campaigns").first()
    assert row.campaign_id == "C1" and row.status is None and abs((dt.datetime.now() - row._loaded_at).total_seconds()) < 3 * 86400


# ---------------------------------------------------------------- sessions
GA = "date date, hour int, event_name string, session_id string, user_id string, page string, source string, medium string, campaign_id string"


def _ga(spark, rows):
    return spark.createDataFrame([(d, i % 24, "click", s, "U", "/", None, None, None) for i, (d, s) in enumerate(rows)], GA)


def test_a_one_day_run_reads_only_touched_sessions(spark):
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(10)]
    rows = [(d, f"S{d.day}_{i}") for d in days for i in range(40)] + [(days[3], "S_long"), (days[9], "S_long")]
    wh = _wh(spark, "touched", "day")
    pipeline.ingest_bronze(wh, {"bronze_ga_events": _ga(spark, rows)}, "b1")
    pipeline.build_silver(wh, "b1")
    one = spark.createDataFrame([("S_long",)], "session_id string").withColumn("bucket", silver.session_bucket(wh.session_buckets))
    looked_up = pipeline.session_counts(wh, one)
    bucket = one.first().bucket
    plan = _plan(looked_up)
    assert "PartitionFilters: [isnotnull(bucket" in plan and f"= {bucket})" in plan
    assert plan.index("LeftSemi") < plan.rindex("Scan") and "LeftSemi" in plan                    # the join filter is below the sums
    assert sorted((r.session_id, r.date, r.n) for r in looked_up.collect()) == [("S_long", days[3], 1), ("S_long", days[9], 1)]
    # The last day loses the long session: only its other day is rebuilt beside the slice.
    new = _ga(spark, [r for r in rows if r != (days[9], "S_long")])
    pipeline.ingest_bronze_dates(wh, {"bronze_ga_events": new}, [days[9]], "b2")
    assert pipeline.rebuild_events_for(wh, "b2", [days[9]]) == [days[3], days[9]]
    assert _rows(drop_audit(wh.read("silver_ga_events"))) == _rows(silver.transform_events(new))
    batches = {(r.date, r._batch_id) for r in wh.read("silver_ga_events").where(F.col("date") == days[3]).collect()}
    assert batches == {(days[3], "b1"), (days[3], "b2")}                                           # rows of other sessions were carried over


def test_merging_sessions_twice_adds_nothing(spark):
    d1, d2 = dt.date(2024, 1, 1), dt.date(2024, 1, 2)
    wh = _wh(spark, "twice", "day")
    pipeline.ingest_bronze(wh, {"bronze_ga_events": _ga(spark, [(d1, "A"), (d2, "A"), (d2, "B"), (None, "A"), (d2, None)])}, "b1")
    pipeline.build_silver(wh, "b1")
    sliced = _ga(spark, [(d2, "B"), (d2, "B"), (d2, "C")])
    want = [("A", d1, 1), ("A", None, 1), ("B", d2, 2), ("C", d2, 1)]
    for _ in range(2):
        pipeline.merge_sessions(wh, sliced, [d2])
        got = silver.added_up(wh.read(pipeline.SESSIONS_TABLE)).collect()
        assert sorted(((r.session_id, r.date, r.n) for r in got), key=str) == sorted(want, key=str)
    assert wh.read(pipeline.SESSIONS_TABLE).where("n < 0").count() == 1                            # A's second day, taken back


# ---------------------------------------------------------------- moments and bitmaps
def test_moments_add_up_and_are_taken_back(spark):
    d1, d2 = dt.date(2024, 1, 1), None
    rows = [(d1, 0.1), (d1, 0.2), (d2, -3.5), (d1, None), (d2, 1e9), (d1, 0.3)]
    df = spark.createDataFrame(rows, "date date, spend double")
    state = moments.slice_moments(df, ["spend"])
    mean, dev = moments.mean_and_deviation(state)["spend"]
    want = df.agg(F.avg("spend"), F.stddev_pop("spend")).first()
    assert mean == pytest.approx(want[0], rel=1e-12) and dev == pytest.approx(want[1], rel=1e-12)
    without = moments.added_up(state.unionByName(moments.negated(moments.slice_moments(df.where("date IS NULL"), ["spend"]))))
    left = moments.added_up(moments.slice_moments(df.where("date IS NOT NULL"), ["spend"]))
    assert [tuple(r) for r in without.collect()] == [tuple(r) for r in left.collect()]
    assert moments.mean_and_deviation(moments.slice_moments(df.limit(0), ["spend"])) == {}


def test_scores_from_state_equal_scores_from_rows_after_a_slice_replace(spark):
    wh, src = _wh(spark, "scores"), _sources(spark, 200)
    del src["bronze_ga_events"]
    hi = src["bronze_ads_performance"].agg(F.max("date")).first()[0]
    wrong = dict(src, bronze_ads_performance=src["bronze_ads_performance"].withColumn("spend", F.when(F.col("date") == hi, 1e7).otherwise(F.col("spend"))))
    pipeline.ingest_bronze(wh, wrong, "b1")
    pipeline.build_silver(wh, "b1")
    pipeline.ingest_bronze_dates(wh, src, [hi], "b2")
    pipeline.build_silver(wh, "b2", [hi])
    suite = [c for c in quality.standard_suite() if c.kind == "zscore"]
    tables = {"silver_ads_performance": wh.read("silver_ads_performance")}
    kept = quality.run_checks(tables, suite, batch_id="b", as_of=AS_OF, stats=pipeline.scored_stats(wh))
    fresh = quality.run_checks(tables, suite, batch_id="b", as_of=AS_OF)
    assert _rows(kept.drop("checked_at")) == _rows(fresh.drop("checked_at"))
    assert _plan(kept).count("Scan parquet") < _plan(fresh).count("Scan parquet") or "Subquery" not in _plan(kept)


def test_bitmaps_count_exactly_over_any_days(spark):
    ids = spark.range(100_000).select(F.col("id").cast("string").alias("k")).repartition(5)
    path = scratch_path(spark, "placed")
    distinct.placed(ids.unionByName(ids), "k").write.parquet(path)
    numbered = distinct.numbered(spark.read.parquet(path), "k", 7)
    got = numbered.agg(F.min("id"), F.max("id"), F.count_distinct("id"), F.count("id")).first()
    assert tuple(got) == (7, 100_006, 100_000, 100_000)
    assert [r.k for r in numbered.orderBy("id").limit(3).collect()] == ["0", "1", "10"]
    rows = numbered.select((F.col("id") % 6).alias("day"), "id").unionByName(numbered.where("id < 50000").select(F.lit(1).alias("day"), "id"))
    state = distinct.bitmaps(rows, ["day"])
    for cond in ("day = 1", "day IN (0, 1, 5)", "day >= 0", "day > 9"):
        want = rows.where(cond).select("id").distinct().count()
        assert (distinct.distinct_count(state.where(cond), []).first()[0] or 0) == want


def test_campaigns_keep_their_numbers(spark):
    d1, d2 = dt.date(2024, 1, 1), dt.date(2024, 1, 2)
    src = _sources(spark)
    src = {k: src[k] for k in ("bronze_campaigns", "bronze_adgroups")}
    wh = _wh(spark, "numbers", "day")
    first = dict(src, bronze_ads_performance=_ads(spark, [(d1, "B", "Google Ads", 1.0), (d2, "D", "Google Ads", 1.0), (d1, None, "Google Ads", 1.0)]))
    pipeline.run_full(wh, first, "b1", as_of=AS_OF)
    before = {r.campaign_id: r.id for r in wh.read(pipeline.IDS_TABLE).collect()}
    second = dict(src, bronze_ads_performance=_ads(spark, [(d2, "A", "Google Ads", 1.0), (d2, "B", "TikTok Ads", 1.0)]))
    pipeline.run_incremental(wh, second, d2, "b2", as_of=AS_OF)
    after = {r.campaign_id: r.id for r in wh.read(pipeline.IDS_TABLE).collect()}
    assert before == {"B": 0, "D": 1} and after == {"B": 0, "D": 1, "A": 2}
    count = lambda *w: {r.channel: r.campaign_count for r in pipeline.distinct_campaigns(wh, *w).collect()}
    assert count() == {"Google Ads": 2, "TikTok Ads": 1} and count(d2, d2) == {"Google Ads": 1, "TikTok Ads": 1} and count(d1, d1) == {"Google Ads": 1}


# ---------------------------------------------------------------- metadata
@pytest.mark.parametrize("grain", ["day", "month"])
def test_bounds_come_from_metadata(spark, grain):
    wh = _wh(spark, "bounds", grain)
    days = [dt.date(2024, 1, 30), dt.date(2024, 2, 3), dt.date(2024, 2, 7), None]
    pipeline.ingest_bronze(wh, {"bronze_ads_performance": _ads(spark, [(d, f"C{i}", "Google Ads", 1.5 * i) for i, d in enumerate(days)])}, "b1")
    assert wh.bounds("bronze_ads_performance") == (days[0], days[2])
    assert wh.bounds("bronze_ads_performance", "impressions") == (100, 100)
    assert wh.bounds("bronze_ads_performance", "campaign_id") == ("C0", "C3")                     # text: by a scan
    plan = _plan(wh.footer_bounds("bronze_ads_performance", "impressions"))
    assert "PushedAggregation: [MIN(impressions), MAX(impressions), COUNT(*)]" in plan and "ReadSchema: struct<min(impressions)" in plan
    filters = pipeline.dashboard_filters(wh, "bronze_ads_performance")
    assert filters.date_range == reports.default_window(wh.read("bronze_ads_performance"))
    wh.replace_dates("bronze_ads_performance", wh.read("bronze_ads_performance").limit(0), [days[2]])
    assert wh.bounds("bronze_ads_performance") == (days[0], days[1])
    wh.replace("bronze_ads_performance", _ads(spark, [(None, "C", "Google Ads", 1.0)]), partition_by="date")
    assert wh.bounds("bronze_ads_performance") == (None, None)


def test_freshness_needs_no_scan(spark):
    wh, src = _wh(spark, "fresh"), _sources(spark)
    pipeline.ingest_bronze(wh, src, "b1")
    pipeline.build_silver(wh, "b1")
    pipeline.build_gold(wh)
    got = pipeline.check_freshness(wh, "b", AS_OF)
    assert "Scan parquet" not in _plan(got) and got.count() == 3
    suite = [c for c in quality.standard_suite() if c.kind == "freshness"]
    want = quality.run_checks(pipeline.audited_tables(wh), suite, batch_id="b", as_of=AS_OF)
    assert _rows(got.drop("checked_at")) == _rows(want.drop("checked_at"))


def test_retention_at_day_grain_starts_no_job(spark):
    wh = _wh(spark, "no_job", "day")
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(6)]
    pipeline.ingest_bronze(wh, {"bronze_ads_performance": _ads(spark, [(d, "C", "Google Ads", 1.0) for d in [*days, None]])}, "b1")
    removed = []
    assert _jobs(spark, lambda: removed.extend(pipeline.apply_retention(wh, "bronze_ads_performance", days[4], days=0))) == 0
    assert removed == days[:4] and set(wh.partition_dates("bronze_ads_performance")) == {*days[4:], None}


# ---------------------------------------------------------------- ledger
def test_a_broken_backfill_goes_on_where_it_stopped(spark):
    src = _sources(spark)
    path = scratch_path(spark, "ledger")
    wh = _Breaking(spark, path.rsplit("/", 1)[-1].replace("-", "_"), path, grain="month")
    pipeline.run_full(wh, src, "b0", as_of=AS_OF)
    hi = src["bronze_ads_performance"].agg(F.max("date")).first()[0]
    lo = hi - dt.timedelta(days=3)
    want = _rows(drop_audit(wh.read("gold_channel_daily")))
    wh.breaks_at = "gold_channel_daily"
    with pytest.raises(RuntimeError, match="broken off"):
        pipeline.backfill(wh, src, lo, hi, "job", as_of=AS_OF)
    stages = lambda: [(r.run, r.stage) for r in wh.read(pipeline.LEDGER_TABLE).orderBy("at").collect()]
    assert stages() == [(1, "bronze"), (1, "silver")]
    empty = {k: v.limit(0) for k, v in src.items()}
    pipeline.backfill(wh, empty, lo, hi, "job", as_of=AS_OF)                       # neither bronze nor silver is done again
    assert stages() == [(1, "bronze"), (1, "silver"), (1, "gold"), (1, "quality")]
    assert _rows(drop_audit(wh.read("gold_channel_daily"))) == want
    pipeline.backfill(wh, src, lo, hi, "job", as_of=AS_OF)                         # over: the same job is a new run
    assert [s for s in stages() if s[0] == 2] == [(2, s) for s in ("bronze", "silver", "gold", "quality")]


# ---------------------------------------------------------------- sources
def test_a_file_of_a_wrong_type_fails_by_name(spark):
    folder = scratch_path(spark, "types")
    good = _ads(spark, [(dt.date(2024, 1, 1), "C", "Google Ads", 1.0)])
    path = f"{folder}/ads_performance.parquet"
    write_extract(good, path)
    good.withColumn("spend", F.lit("a lot")).coalesce(1).write.mode("append").parquet(path)
    with pytest.raises(ExtractTypeError, match=r"ads_performance.parquet/part-.*: spend is string, declared double"):
        read_extract(spark, path, schemas.ADS_PERFORMANCE)
    write_extract(good.drop("channel"), path)
    with pytest.raises(ExtractTypeError, match="channel is missing"):
        read_extract(spark, path, schemas.ADS_PERFORMANCE)
    write_extract(good.withColumn("date", F.col("date").cast("string")).withColumn("hour", F.col("hour").cast("byte")), path)
    got = read_extract(spark, path, schemas.ADS_PERFORMANCE)
    assert drop_audit(got).schema == schemas.ADS_PERFORMANCE and _rows(drop_audit(got)) == _rows(good)
    assert read_extract(spark, f"{folder}/none.parquet", schemas.ADS_PERFORMANCE) is None


def test_declared_scans_push_their_filters(spark):
    path = f"{scratch_path(spark, 'pushed')}/ads_performance.parquet"
    write_extract(_ads(spark, [(dt.date(2024, 1, d), "C", "Google Ads", 1.0) for d in (1, 2)]), path)
    plan = _plan(read_extract(spark, path, schemas.ADS_PERFORMANCE).where(F.col("date") == dt.date(2024, 1, 2)).select("clicks"))
    assert "PushedFilters: [IsNotNull(date), EqualTo(date,2024-01-02)]" in plan and "ReadSchema: struct<date:date,clicks:bigint" in plan and "spend" not in plan


def test_lineage_names_each_file(spark):
    path = f"{scratch_path(spark, 'files')}/ads_performance.parquet"
    for d in (1, 2):
        _ads(spark, [(dt.date(2024, 1, d), "C", "Google Ads", 1.0)] * d).coalesce(1).write.mode("append").parquet(path)
    wh = _wh(spark, "files", "day")
    pipeline.ingest_bronze(wh, {"bronze_ads_performance": read_extract(spark, path, schemas.ADS_PERFORMANCE)}, "b1")
    by_file = wh.read("bronze_ads_performance").groupBy("_source_file").agg(F.count_distinct("date").alias("days"), F.count("_source_modified").alias("n")).collect()
    assert sorted((r.days, r.n) for r in by_file) == [(1, 1), (1, 2)] and all(r._source_file.startswith("ads_performance.parquet/part-") for r in by_file)
    pipeline.ingest_bronze_dates(wh, {"bronze_ads_performance": _ads(spark, [(dt.date(2024, 1, 2), "C", "Google Ads", 1.0)])}, [dt.date(2024, 1, 2)], "b2")
    row = wh.read("bronze_ads_performance").where("_batch_id = 'b2'").first()
    assert row._source_file == "ads_performance.parquet" and row._source_modified is None           # a source without files


def test_scripts_run_whole(spark):
    wh = _wh(spark, "scripts", "day")
    wh.execute_script("CREATE TABLE t (x INT, y STRING) USING parquet; INSERT INTO t VALUES (1, 'a;b')")
    got = wh.execute_script("""BEGIN
      DECLARE n INT DEFAULT 0;
      DECLARE EXIT HANDLER FOR SQLEXCEPTION BEGIN SELECT 'handled; gone on' AS said; END;
      WHILE n < 3 DO INSERT INTO t VALUES (n, ';'); SET n = n + 1; END WHILE;
      SELECT raise_error('stop');
    END""")
    assert got.first().said == "handled; gone on" and wh.row_count("t") == 4
