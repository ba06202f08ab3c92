"""Jobs: full run, single-date incremental, D-1 and backfill, quality run.

The jobs only sequence table writes; every transform is a DataFrame plan
from ``adpulse.operators``.  Incremental runs replace the date slice in the
two bronze facts, rebuild silver ads, the hourly rollup and the gold tables for
those dates only (their grains contain ``date``), and rebuild silver events for
the dates of every session the slice touches (a session may span dates, so a
bounce flag can depend on other days).  Checks follow every run.
"""

from __future__ import annotations

import datetime as dt
import logging
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import partial

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adpulse.config import BATCH_ID_FORMAT, FACT_TABLES, RESULTS_TABLE, SOURCE_MAP
from adpulse.operators import distinct, gold, insights, moments, quality, reports, silver
from adpulse.operators.common import with_audit
from adpulse.sources.extracts import in_dates, slice_dates
from adpulse.sources.schemas import QUALITY_RESULTS, STAGE_JOB_LEDGER
from adpulse.sources.warehouse import Warehouse

log = logging.getLogger(__name__)

ROLLUP_TABLE = "stage_ads_hourly"
SESSIONS_TABLE = "stage_session_days"
MOMENTS_TABLE = "stage_ads_moments"
IDS_TABLE, BITMAPS_TABLE = "stage_campaign_ids", "stage_campaign_bitmaps"
NEW_IDS_TABLE = "stage_new_ids"
LEDGER_TABLE = "stage_job_ledger"
TOUCHED_TABLE = "stage_touched_sessions"
MAX_JOBS = 5                         # tables written at the same time
SCORED = ["spend", "revenue"]        # columns with a z-score check
QUARANTINE_TABLE = "silver_ads_quarantine"


def _side_by_side(wh: Warehouse, works: list) -> None:
    """Runs jobs that write different tables at the same time; the first failure is raised when all have ended.

    A table's write seldom fills a cluster from its first to its last task, and
    nothing in a session is changed by one, so they may overlap.
    """
    if len(works) < 2:
        for work in works:
            work()
        return
    with ThreadPoolExecutor(max_workers=min(len(works), MAX_JOBS)) as pool:
        running = [pool.submit(inheritable_thread_target(wh.spark)(work)) for work in works]
    for r in running:
        r.result()


def new_batch_id(now: dt.datetime | None = None) -> str:
    return (now or dt.datetime.now()).strftime(BATCH_ID_FORMAT)


# ---------------------------------------------------------------- bronze
def _prepared(wh: Warehouse, table: str, df: DataFrame) -> DataFrame:
    """Source rows as they enter bronze: identifiers hashed if the warehouse has a salt."""
    if wh.pii_salt and table == "bronze_ga_events":
        return insights.pseudonymize(df, wh.pii_salt)
    return df


def ingest_bronze(wh: Warehouse, sources: dict[str, DataFrame], batch_id: str) -> None:
    """Full load of every available source into bronze, with audit columns."""
    def load(table: str, df: DataFrame) -> None:
        part = "date" if table in FACT_TABLES else None
        wh.replace(table, with_audit(_prepared(wh, table, df), batch_id, SOURCE_MAP[table]), partition_by=part)
        log.info("bronze %s loaded", table)

    _side_by_side(wh, [partial(load, t, df) for t, df in sources.items()])


def ingest_bronze_dates(wh: Warehouse, sources: dict[str, DataFrame], dates: list, batch_id: str) -> bool:
    """Replace the ``dates`` slice of the bronze facts; dimensions are left as loaded.

    Returns False when bronze did not exist yet and a full load ran instead.
    """
    facts = [t for t in FACT_TABLES if t in sources]
    for table in set(FACT_TABLES) - set(facts):
        log.warning("source for %s not available -- skipping", table)
    for table in facts:
        if not wh.exists(table):
            log.info("%s does not exist -- running a full load", table)
            ingest_bronze(wh, sources, batch_id)
            return False

    def load(table: str) -> None:
        new = with_audit(slice_dates(_prepared(wh, table, sources[table]), dates), batch_id, SOURCE_MAP[table])
        wh.replace_dates(table, new, dates)

    _side_by_side(wh, [partial(load, t) for t in facts])
    return True


# ---------------------------------------------------------------- silver
def build_silver(wh: Warehouse, batch_id: str, dates: list | None = None) -> None:
    """silver_ads_performance (whole or for ``dates``) and silver_ga_events (whole)."""
    works = []
    if wh.exists("bronze_ads_performance"):
        works.append(lambda: _build_silver_ads(wh, batch_id, dates))
    if wh.exists("bronze_ga_events"):
        works.append(lambda: _build_silver_events(wh, batch_id, dates))
    _side_by_side(wh, works)
    if dates is not None and wh.exists(QUARANTINE_TABLE):
        quarantine_silver(wh, batch_id, dates)


def _build_silver_ads(wh: Warehouse, batch_id: str, dates: list | None) -> None:
    bronze = wh.read("bronze_ads_performance") if dates is None else wh.read_dates("bronze_ads_performance", dates)
    ads = silver.transform_ads(bronze, wh.read("bronze_campaigns"), wh.read("bronze_adgroups"))
    ads = with_audit(ads, batch_id)
    if dates is None or not wh.exists("silver_ads_performance"):
        wh.replace("silver_ads_performance", ads, partition_by="date",
                   grain=wh.grain_of("bronze_ads_performance"))
    else:
        # Dedup keeps a row per key and the joins are LEFT joins, so the
        # silver slice has exactly the dates of its bronze slice.
        wh.replace_dates("silver_ads_performance", ads, dates, dates_from=bronze)
    keep_moments(wh, dates)


def _build_silver_events(wh: Warehouse, batch_id: str, dates: list | None) -> None:
    if dates is not None and wh.exists("silver_ga_events"):
        rebuild_events_for(wh, batch_id, dates)
        return
    events, grain = wh.read("bronze_ga_events"), wh.grain_of("bronze_ga_events")
    state = silver.session_days(events).withColumn("bucket", silver.session_bucket(wh.session_buckets))
    wh.replace(SESSIONS_TABLE, state, partition_by="bucket")
    wh.replace("silver_ga_events", with_audit(silver.transform_events(events), batch_id), partition_by="date", grain=grain)


def rebuild_events_for(wh: Warehouse, batch_id: str, dates: list) -> list:
    """Rebuild silver events touched by a replaced bronze slice, exactly.

    A bounce flag depends on the size of its session, and a session may span
    days.  The sessions touched are those in the slice before or after the
    replace.  The kept counts per session and day are merged with the slice's, and
    then looked up for these sessions only: their buckets are read, and their rows
    go on.  Every date on which such a session has an event is rebuilt; the other
    rows of those dates are carried over as they are.  Returns the rebuilt dates
    (None for events without a date).
    """
    days = sorted({_date(d) for d in dates}, key=str)
    sliced = wh.read_dates("bronze_ga_events", days)
    before = wh.read_dates("silver_ga_events", days).select("session_id")
    touched = before.unionByName(sliced.select("session_id")).where(F.col("session_id").isNotNull()).distinct()
    wh.replace(TOUCHED_TABLE, touched.withColumn("bucket", silver.session_bucket(wh.session_buckets)))
    merge_sessions(wh, sliced, days)
    counts = session_counts(wh, wh.read(TOUCHED_TABLE))
    spread = {r[0] for r in counts.select("date").distinct().collect()}        # bounded by the calendar
    rebuilt = sorted({*days, *spread}, key=str)
    others = [d for d in rebuilt if d not in days]
    sessions = wh.read(TOUCHED_TABLE).select("session_id")
    events, kept = sliced, None
    if others:
        events = events.unionByName(wh.read_dates("bronze_ga_events", others).join(sessions, "session_id", "left_semi").select(*sliced.columns))
        kept = wh.read_dates("silver_ga_events", others).join(sessions, "session_id", "left_anti")
    ev = with_audit(silver.transform_events(events, counts), batch_id)
    ev = ev if kept is None else ev.unionByName(kept.select(*ev.columns))
    wh.replace_dates("silver_ga_events", ev, rebuilt, dates_from=wh.read_dates("bronze_ga_events", rebuilt))
    wh.drop(TOUCHED_TABLE)
    return rebuilt


def merge_sessions(wh: Warehouse, sliced: DataFrame, days: list) -> None:
    """Merges the slice's counts into the kept ones: the difference to what is kept of those days is added.

    Added rows are few and lie in their sessions' buckets, beside what was there.
    Running it again adds nothing.  A full load writes the counts anew.
    """
    new = silver.session_days(sliced)
    old = wh.read(SESSIONS_TABLE).where(in_dates("date", days)).select("session_id", "date", (-F.col("n")).alias("n"))
    changed = silver.added_up(new.unionByName(old)).withColumn("bucket", silver.session_bucket(wh.session_buckets))
    wh.append(SESSIONS_TABLE, changed, "bucket")


def session_counts(wh: Warehouse, sessions: DataFrame) -> DataFrame:
    """(session_id, date, n) of the given (session_id, bucket) only: their buckets are read, and only their rows are summed."""
    buckets = [r[0] for r in sessions.select("bucket").distinct().collect()]      # as many as buckets at most
    rows = wh.read(SESSIONS_TABLE).where(F.col("bucket").isin(buckets) if buckets else F.lit(False))
    return silver.added_up(rows.join(sessions.select("session_id"), "session_id", "left_semi"))


def keep_moments(wh: Warehouse, dates: list | None = None) -> None:
    """Keeps count, sum and sum of squares of the scored columns; a replaced slice's are taken back by subtraction."""
    table = "silver_ads_performance"
    if dates is None or not wh.exists(MOMENTS_TABLE):
        wh.replace(MOMENTS_TABLE, moments.slice_moments(wh.read(table), SCORED))
        return
    new = moments.slice_moments(wh.read_dates(table, dates), SCORED)
    old = moments.added_up(wh.read(MOMENTS_TABLE).where(in_dates("date", dates)), "date")
    changed = moments.added_up(new.unionByName(moments.negated(old)), "date")
    wh.append(MOMENTS_TABLE, changed)


def scored_stats(wh: Warehouse) -> dict:
    """Mean and deviation of the scored columns as kept, by table; empty where nothing is kept."""
    if not wh.exists(MOMENTS_TABLE):
        return {}
    return {"silver_ads_performance": moments.mean_and_deviation(wh.read(MOMENTS_TABLE))}


def quarantine_silver(wh: Warehouse, batch_id: str, dates: list | None = None) -> int:
    """Move silver ads rows that break a validation rule to ``silver_ads_quarantine``.

    Opt-in: the reference's silver keeps every row.  Once the quarantine table
    exists, later date runs apply the rules to their dates again.  Both tables
    are written from one staged copy (a written table cuts the lineage before
    silver itself is replaced).  Returns the number of rows quarantined.
    """
    silver_table, staged = "silver_ads_performance", "stage_quarantine"
    rows = wh.read(silver_table) if dates is None else wh.read_dates(silver_table, dates)
    grain = wh.grain_of(silver_table)
    wh.replace(staged, rows, partition_by="date", grain=grain)
    clean, bad = insights.quarantine_split(wh.read(staged))
    if dates is None:
        wh.replace(QUARANTINE_TABLE, bad, partition_by="date", grain=grain)
        wh.replace(silver_table, clean, partition_by="date", grain=grain)
    else:
        wh.replace_dates(QUARANTINE_TABLE, bad, dates)
        wh.replace_dates(silver_table, clean, dates)
    moved = bad.count()
    keep_moments(wh, dates)
    wh.drop(staged)
    return moved


def apply_retention(wh: Warehouse, table: str, as_of: dt.datetime | dt.date | None = None, days: int = 90) -> list:
    """Delete the rows of ``table`` dated before ``as_of - days`` (whole dates).

    Partitions are dropped by name; no job runs unless the cutoff falls within a
    monthly partition, which is then written again.  Returns the removed dates.
    """
    return wh.drop_dates_before(table, _date(as_of or dt.datetime.now()) - dt.timedelta(days=days))


# ---------------------------------------------------------------- gold
def build_gold(wh: Warehouse, dates: list | None = None) -> None:
    """Hourly rollup of silver, then the four gold tables from it: whole, or the slice of ``dates``."""
    if not wh.exists("silver_ads_performance"):
        return
    grain = wh.grain_of("silver_ads_performance")
    whole = dates is None or not all(wh.exists(t) for t in (ROLLUP_TABLE, *gold.BUILDERS))
    s = wh.read("silver_ads_performance") if whole else wh.read_dates("silver_ads_performance", dates)
    if whole:
        wh.replace(ROLLUP_TABLE, gold.rollup(s), partition_by="date", grain=grain)
    else:
        wh.replace_dates(ROLLUP_TABLE, gold.rollup(s), dates, dates_from=s)
    base = wh.read(ROLLUP_TABLE) if whole else wh.read_dates(ROLLUP_TABLE, dates)

    def write(table: str, build, order: list[str]) -> None:
        rows = with_audit(build(base), "gold").drop("_batch_id")
        if whole:
            wh.replace(table, rows, partition_by="date", grain=grain, sort_by=order)
        else:
            wh.replace_dates(table, rows, dates, sort_by=order, dates_from=base)

    works = [partial(write, table, build, order) for table, (build, order) in gold.BUILDERS.items()]
    _side_by_side(wh, [*works, lambda: keep_campaign_bitmaps(wh, base, None if whole else dates)])


def keep_campaign_bitmaps(wh: Warehouse, base: DataFrame, dates: list | None = None) -> None:
    """Bitmaps of each day's and channel's campaigns, for exact distinct counts over any days.

    Campaigns get their numbers once: a full build numbers anew, a date run adds
    those not yet in the dictionary.
    """
    seen = base.select("campaign_id").where(F.col("campaign_id").isNotNull()).distinct()
    known = None if dates is None or not wh.exists(IDS_TABLE) else wh.read(IDS_TABLE)
    fresh = seen if known is None else seen.join(known, "campaign_id", "left_anti")
    wh.replace(NEW_IDS_TABLE, distinct.placed(fresh, "campaign_id"))
    start = 0 if known is None else (known.agg(F.max("id")).first()[0] or 0) + 1
    numbered = distinct.numbered(wh.read(NEW_IDS_TABLE), "campaign_id", start)
    if known is None:
        wh.replace(IDS_TABLE, numbered)
    elif not wh.read(NEW_IDS_TABLE).isEmpty():
        wh.append(IDS_TABLE, numbered)
    wh.drop(NEW_IDS_TABLE)
    rows = base.select("date", "channel", "campaign_id").join(wh.read(IDS_TABLE), "campaign_id")
    state = distinct.bitmaps(rows, ["date", "channel"])
    if known is None:
        wh.replace(BITMAPS_TABLE, state, partition_by="date", grain=wh.grain_of(ROLLUP_TABLE))
    else:
        wh.replace_dates(BITMAPS_TABLE, state, dates, dates_from=base.where(F.col("campaign_id").isNotNull()))


def distinct_campaigns(wh: Warehouse, start=None, end=None) -> DataFrame:
    """(channel, campaign_count): exact, over any range of dates, from the kept bitmaps."""
    state = wh.read(BITMAPS_TABLE)
    if start is not None and end is not None:
        state = state.where(F.col("date").between(F.lit(_date(start)), F.lit(_date(end))))
    return distinct.distinct_count(state, ["channel"], "campaign_count")


# ---------------------------------------------------------------- quality
def audited_tables(wh: Warehouse) -> dict[str, DataFrame]:
    names = ["silver_ads_performance", "silver_ga_events", "gold_campaign_daily", "bronze_campaigns"]
    return {t: wh.read(t) for t in names if wh.exists(t)}


def run_quality(wh: Warehouse, batch_id: str | None = None, as_of=None, gate: bool = False) -> dict:
    """Run the standard suite, store it under its batch id, return the summary."""
    batch_id = batch_id or new_batch_id()
    results = quality.run_checks(audited_tables(wh), batch_id=batch_id, as_of=as_of, stats=scored_stats(wh))
    wh.replace_where(RESULTS_TABLE, results, "batch_id", schema=QUALITY_RESULTS)
    stored = wh.read(RESULTS_TABLE).where(F.col("batch_id") == batch_id)
    # The reference's summary contract: exactly these five keys.
    summary = quality.summary(stored).select("total", "passed", "warned", "failed", "pass_rate").first().asDict()
    if gate:
        quality.enforce(stored)
    return summary


def check_freshness(wh: Warehouse, batch_id: str | None = None, as_of=None) -> DataFrame:
    """The freshness checks alone, from the tables' newest dates as metadata tells them: no table is scanned."""
    checks = [c for c in quality.standard_suite() if c.kind == "freshness" and wh.exists(c.table)]
    newest = {c.table: wh.spark.createDataFrame([(wh.bounds(c.table, c.columns[0])[1],)], f"{c.columns[0]} date") for c in checks}
    return quality.run_checks(newest, checks, batch_id=batch_id, as_of=as_of)


def dashboard_filters(wh: Warehouse, table: str = "gold_campaign_daily", days: int = 30, channels: list[str] | None = None) -> reports.Filters:
    """The dashboard's opening filters, from the newest date as metadata tells it."""
    end = wh.bounds(table)[1]
    return reports.Filters(date_range=None if end is None else (end - dt.timedelta(days=days), end), channels=channels)


# ---------------------------------------------------------------- jobs
@dataclass
class RunResult:
    batch_id: str
    summary: dict


def gate_silver(wh: Warehouse, as_of=None) -> None:
    """Quality gate on the silver layer, before gold is published.

    Runs the suite's checks on the tables that exist so far (silver and the
    campaign dimension) and raises ``QualityGateError`` on any FAIL.
    """
    tables = {t: df for t, df in audited_tables(wh).items() if not t.startswith("gold")}
    quality.enforce(quality.run_checks(tables, as_of=as_of))


def run_full(wh: Warehouse, sources: dict[str, DataFrame], batch_id: str | None = None,
             as_of=None, gate: bool = False, gate_before_gold: bool = False) -> RunResult:
    """bronze -> silver -> gold -> checks, one batch id throughout.

    ``gate`` raises after the checks are stored (the reference's order);
    ``gate_before_gold`` stops the run before gold is rebuilt when silver
    fails a check, so a bad batch never reaches the reports.
    """
    batch_id = batch_id or new_batch_id()
    ingest_bronze(wh, sources, batch_id)
    build_silver(wh, batch_id)
    if gate_before_gold:
        gate_silver(wh, as_of)
    build_gold(wh)
    return RunResult(batch_id, run_quality(wh, batch_id, as_of=as_of, gate=gate))


DIMENSIONS = ["bronze_campaigns", "bronze_adgroups"]


def run_dates(wh: Warehouse, sources: dict[str, DataFrame], dates: list, batch_id: str | None = None,
              refresh_dimensions: bool = False, as_of=None, gate: bool = False) -> RunResult:
    """Replace ``dates`` in bronze, rebuild what depends on them, then run the checks.

    Dimensions are left as loaded (the reference's incremental behaviour)
    unless ``refresh_dimensions``; a refreshed dimension can rename any
    date's rows, so silver and gold are then rebuilt whole, from all that
    bronze holds (after a retention run, gold loses the dates bronze lost).
    """
    batch_id = batch_id or new_batch_id()
    sliced = ingest_bronze_dates(wh, sources, dates, batch_id)
    if sliced and refresh_dimensions:
        ingest_bronze(wh, {t: sources[t] for t in DIMENSIONS if t in sources}, batch_id)
    scope = dates if sliced and not refresh_dimensions else None
    build_silver(wh, batch_id, scope)
    if scope is None and wh.exists(QUARANTINE_TABLE):
        quarantine_silver(wh, batch_id)
    build_gold(wh, scope)
    return RunResult(batch_id, run_quality(wh, batch_id, as_of=as_of, gate=gate))


def run_incremental(wh: Warehouse, sources: dict[str, DataFrame], target_date, batch_id: str | None = None,
                    refresh_dimensions: bool = False, as_of=None, gate: bool = False) -> RunResult:
    """Idempotent reprocessing of one date."""
    return run_dates(wh, sources, [_date(target_date)], batch_id, refresh_dimensions, as_of, gate)


def run_d_minus_1(wh: Warehouse, sources: dict[str, DataFrame], as_of: dt.datetime | None = None) -> RunResult:
    """Reprocess yesterday relative to ``as_of`` (default: now)."""
    now = as_of or dt.datetime.now()
    return run_incremental(wh, sources, now.date() - dt.timedelta(days=1), as_of=now)


class Ledger:
    """Which stages of a job have been committed, kept in the warehouse.

    A stage is entered after its tables are written.  A job is its batch id and
    slice; when its last stage is entered it is over, and the same job asked for
    again is a new run.
    """

    LAST = "quality"

    def __init__(self, wh: Warehouse, batch_id: str, job_slice: str):
        self.wh, self.batch_id, self.slice = wh, batch_id, job_slice
        if not wh.exists(LEDGER_TABLE):
            wh.replace(LEDGER_TABLE, wh.spark.createDataFrame([], STAGE_JOB_LEDGER))
        rows = wh.read(LEDGER_TABLE).where((F.col("batch_id") == batch_id) & (F.col("slice") == job_slice)).select("run", "stage").collect()
        self.run = max((r.run for r in rows), default=0)
        self.done = {r.stage for r in rows if r.run == self.run}
        if self.LAST in self.done or not rows:
            self.run, self.done = self.run + 1, set()

    def once(self, stage: str, work) -> None:
        """Does a stage and enters it, unless this run has done it before."""
        if stage in self.done:
            log.info("%s of %s %s is done -- skipping", stage, self.batch_id, self.slice)
            return
        work()
        entry = self.wh.spark.range(1).select(F.lit(self.batch_id).alias("batch_id"), F.lit(self.slice).alias("slice"), F.lit(self.run).alias("run"),
                                              F.lit(stage).alias("stage"), F.current_timestamp().alias("at"))
        self.wh.append(LEDGER_TABLE, entry)
        self.done.add(stage)


def backfill(wh: Warehouse, sources: dict[str, DataFrame], start_date, end_date, batch_id: str | None = None,
             as_of=None, gate: bool = False) -> RunResult:
    """Reprocess every date in [start_date, end_date] with one range replace and one rebuild.

    Each stage is entered in the job ledger when it is committed.  A backfill that
    was broken off goes on where it stopped when it is called again with its batch
    id and dates.
    """
    if not start_date or not end_date:
        raise ValueError("backfill requires both start_date and end_date")
    start, end = _date(start_date), _date(end_date)
    if end < start:
        raise ValueError(f"backfill end {end} is before start {start}")
    days = [start + dt.timedelta(days=i) for i in range((end - start).days + 1)]
    batch_id = batch_id or new_batch_id()
    ledger = Ledger(wh, batch_id, f"{start}..{end}")
    # A first run loads everything, and then builds everything.
    scope = days if all(wh.exists(t) for t in FACT_TABLES if t in sources) and "bronze_whole" not in ledger.done else None
    if scope is None:
        ledger.once("bronze_whole", lambda: ingest_bronze(wh, sources, batch_id))
    else:
        ledger.once("bronze", lambda: ingest_bronze_dates(wh, sources, days, batch_id))
    ledger.once("silver", lambda: build_silver(wh, batch_id, scope))
    ledger.once("gold", lambda: build_gold(wh, scope))
    summary = []
    ledger.once(Ledger.LAST, lambda: summary.append(run_quality(wh, batch_id, as_of=as_of, gate=gate)))
    return RunResult(batch_id, summary[0])


def _date(d) -> dt.date | None:
    if d is None:
        return None
    if isinstance(d, dt.datetime):
        return d.date()
    return d if isinstance(d, dt.date) else dt.date.fromisoformat(str(d))
