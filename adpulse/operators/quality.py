"""Data-quality checks: completeness, validity, consistency, anomaly, freshness.

A suite is data (a list of ``Check`` specs).  ``run_checks`` compiles all
checks on one table into a single aggregation over that table, so the
table is scanned once however many columns are audited (twice when a
z-score needs the mean and standard deviation first; those come from one
scalar subquery).  Results are a lazy DataFrame in the results schema,
one row per check; nothing but the final rows ever leaves the executors.
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adpulse.config import (
    MAX_NULL_PCT, MAX_STALENESS_HOURS, MESSAGES, MIN_DAILY_ROWS, OUTLIER_PASS, OUTLIER_WARN, RANGE_WARN, ROAS_MAX,
    SCORE_AT_RISK, SCORE_HEALTHY, ZSCORE_THRESHOLD,
)
from adpulse.functions.exprs import fixed, round_half_away, thousands


@dataclass(frozen=True)
class Check:
    kind: str                      # completeness | non_negative | range | row_count | referential | zscore | freshness | unique
    table: str
    columns: tuple[str, ...] = ()
    min_val: float | None = None
    max_val: float | None = None
    min_rows: int = 0
    parent_table: str | None = None
    parent_column: str | None = None


def standard_suite() -> list[Check]:
    """The governance suite: 28 checks when every audited table exists."""
    ads, ev, gold = "silver_ads_performance", "silver_ga_events", "gold_campaign_daily"
    return [
        Check("completeness", ads, ("date", "campaign_id", "channel", "impressions", "clicks", "spend")),
        Check("non_negative", ads, ("impressions", "clicks", "spend", "conversions", "revenue")),
        Check("range", ads, ("ctr",), 0.0, 1.0),
        Check("range", ads, ("roas",), 0.0, ROAS_MAX),
        Check("zscore", ads, ("spend",)),
        Check("zscore", ads, ("revenue",)),
        Check("freshness", ads, ("date",)),
        Check("completeness", ev, ("date", "event_name", "session_id", "user_id")),
        Check("freshness", ev, ("date",)),
        Check("row_count", gold, min_rows=MIN_DAILY_ROWS),
        Check("non_negative", gold, ("total_impressions", "total_clicks", "total_spend", "total_revenue")),
        Check("freshness", gold, ("date",)),
        Check("referential", ads, ("campaign_id",), parent_table="bronze_campaigns", parent_column="campaign_id"),
    ]


def _row(name, ctype: str, table: str, column, status: Column, metric: Column, threshold: float, details: Column) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(
        as_col(name).cast("string").alias("check_name"),
        F.lit(ctype).alias("check_type"),
        F.lit(table).alias("table_name"),
        as_col(column).cast("string").alias("column_name"),
        status.alias("status"),
        metric.cast("double").alias("metric_value"),
        F.lit(float(threshold)).alias("threshold"),
        details.cast("string").alias("details"),
    )


_ROW_TYPE = ("array<struct<check_name:string,check_type:string,table_name:string,column_name:string,"
             "status:string,metric_value:double,threshold:double,details:string>>")


def _rows(items: list[Column]) -> Column:
    """array<struct> of result rows; typed even when empty."""
    return F.array(*items) if items else F.array().cast(_ROW_TYPE)


def _said(kind: str, *values: Column | str) -> Column:
    """A result's text with its figures filled in."""
    texts = MESSAGES[kind].split("{}")
    cols = [F.lit(texts[0])]
    for v, text in zip(values, texts[1:], strict=True):
        cols += [v if isinstance(v, Column) else F.lit(v), F.lit(text)]
    return F.concat(*cols)


def _py_num(v) -> str:
    """How the reference prints a bound: Python ``str`` of the value."""
    return str(v)


class _Compiler:
    """Collects aggregate expressions for one table and the rows built from them."""

    def __init__(self, table: str, df: DataFrame, as_of: str, stats: dict[str, tuple[float, float]] | None = None):
        self.table, self.df, self.as_of, self.stats = table, df, as_of, stats
        self.aggs: list[Column] = [F.count(F.lit(1)).alias("__n")]
        self.rows: list[Column] = []   # array<struct> expressions over the aggregated row
        self._zcols: list[str] = []
        self._i = 0

    def _name(self, base: str) -> str:
        self._i += 1
        return f"__{base}{self._i}"

    def add(self, c: Check) -> None:
        getattr(self, f"_{c.kind}")(c)

    def _completeness(self, c: Check) -> None:
        n = F.col("__n")
        per_col = []
        for col in c.columns:
            a = self._name("null")
            self.aggs.append(F.count_if(F.col(col).isNull()).alias(a))
            pct = F.try_divide(F.col(a).cast("double"), n.cast("double"))
            per_col.append(_row(
                f"null_check_{col}", "completeness", self.table, col,
                F.when(pct <= MAX_NULL_PCT, "PASS").otherwise("FAIL"),
                round_half_away(pct, 4), MAX_NULL_PCT,
                _said("completeness", thousands(F.col(a)), thousands(n)),
            ))
        empty = _row("completeness", "completeness", self.table, "*", F.lit("FAIL"), F.lit(0.0), 0,
                     _said("completeness_empty"))
        self.rows.append(F.when(n == 0, F.array(empty)).otherwise(_rows(per_col)))

    def _non_negative(self, c: Check) -> None:
        out = []
        for col in c.columns:
            a = self._name("neg")
            self.aggs.append(F.count_if(F.col(col) < 0).alias(a))
            out.append(_row(
                f"non_negative_{col}", "validity", self.table, col,
                F.when(F.col(a) == 0, "PASS").otherwise("FAIL"), F.col(a), 0,
                _said("non_negative", thousands(F.col(a))),
            ))
        self.rows.append(_rows(out))

    def _range(self, c: Check) -> None:
        col = c.columns[0]
        conds = []
        if c.min_val is not None:
            conds.append(F.col(col) < F.lit(float(c.min_val)))
        if c.max_val is not None:
            conds.append(F.col(col) > F.lit(float(c.max_val)))
        if not conds:
            return
        bad = conds[0] if len(conds) == 1 else (conds[0] | conds[1])
        a = self._name("range")
        self.aggs.append(F.count_if(bad).alias(a))
        v, n = F.col(a), F.col("__n")
        pct = F.when(n > 0, v.cast("double") / n.cast("double")).otherwise(F.lit(0.0))
        status = F.when(v == 0, "PASS").when(pct < RANGE_WARN, "WARN").otherwise("FAIL")
        self.rows.append(F.array(_row(
            f"range_check_{col}", "validity", self.table, col, status, v, 0,
            _said("range", _py_num(c.min_val), _py_num(c.max_val), thousands(v)),
        )))

    def _row_count(self, c: Check) -> None:
        n = F.col("__n")
        self.rows.append(F.array(_row(
            f"row_count_{self.table}", "consistency", self.table, "*",
            F.when(n >= c.min_rows, "PASS").otherwise("FAIL"), n, c.min_rows,
            _said("row_count", thousands(n), f"{c.min_rows:,}"),
        )))

    def _unique(self, c: Check) -> None:
        """Key uniqueness of a dimension (a duplicate key fans out every LEFT join to it)."""
        col = c.columns[0]
        a = self._name("dup")
        self.aggs.append((F.count(F.col(col)) - F.count_distinct(F.col(col))).alias(a))
        self.rows.append(F.array(_row(
            f"unique_{col}", "consistency", self.table, col,
            F.when(F.col(a) == 0, "PASS").otherwise("FAIL"), F.col(a), 0,
            F.concat(F.lit("Duplicate key rows: "), thousands(F.col(a))),
        )))

    def _zscore(self, c: Check) -> None:
        self._zcols.append(c.columns[0])

    def _freshness(self, c: Check) -> None:
        col = c.columns[0] if c.columns else "date"
        a = self._name("maxd")
        self.aggs.append(F.max(F.col(col).cast("date")).alias(a))
        hours = (
            F.unix_seconds(F.lit(self.as_of).cast("timestamp"))
            - F.unix_seconds(F.col(a).cast("timestamp"))
        ).cast("double") / 3600.0
        name = f"freshness_{self.table}"
        missing = _row(name, "freshness", self.table, col, F.lit("FAIL"), F.lit(0.0), MAX_STALENESS_HOURS,
                       _said("freshness_empty"))
        found = _row(
            name, "freshness", self.table, col,
            F.when(hours <= MAX_STALENESS_HOURS, "PASS").otherwise("WARN"), round_half_away(hours, 1),
            MAX_STALENESS_HOURS,
            _said("freshness", fixed(hours, 1), str(MAX_STALENESS_HOURS)),
        )
        self.rows.append(F.when(F.col(a).isNull(), F.array(missing)).otherwise(F.array(found)))

    def _finish_zscores(self) -> None:
        if not self._zcols:
            return
        if self.stats is None:
            # Population mean / std of every z-scored column in one pass, used as a scalar.
            fields = []
            for i, col in enumerate(self._zcols):
                fields += [F.avg(col).alias(f"m{i}"), F.stddev_pop(col).alias(f"s{i}")]
            st = self.df.agg(F.struct(*fields).alias("st")).scalar()
        for i, col in enumerate(self._zcols):
            x = F.col(col).cast("double")
            if self.stats is None:
                m, s = st.getField(f"m{i}"), st.getField(f"s{i}")
            else:                                    # kept state: no pass over the rows for them
                m, s = (F.lit(v).cast("double") for v in self.stats.get(col, (None, None)))
            cnt, out, sd = self._name("zn"), self._name("zout"), self._name("zsd")
            self.aggs += [
                F.count(F.col(col)).alias(cnt),
                F.count_if(x.isNotNull() & (s > 0) & (F.abs(F.try_divide(x - m, s)) > ZSCORE_THRESHOLD)).alias(out),
                F.first(s, ignorenulls=True).alias(sd),
            ]
            name = f"anomaly_{col}"
            flat = _row(name, "anomaly", self.table, col, F.lit("PASS"), F.lit(0.0), ZSCORE_THRESHOLD,
                        _said("zscore_flat"))
            pct = F.try_divide(F.col(out).cast("double"), F.col(cnt).cast("double"))
            scored = _row(
                name, "anomaly", self.table, col,
                F.when(pct < OUTLIER_PASS, "PASS").when(pct < OUTLIER_WARN, "WARN").otherwise("FAIL"), F.col(out), ZSCORE_THRESHOLD,
                _said("zscore", fixed(pct * 100.0, 2), thousands(F.col(out))),
            )
            self.rows.append(
                F.when(F.col(cnt) == 0, _rows([]))
                .when(F.col(sd) == 0, F.array(flat))
                .otherwise(F.array(scored))
            )

    def result(self) -> DataFrame | None:
        self._finish_zscores()
        if not self.rows:
            return None
        one = self.df.agg(*self.aggs)
        arr = self.rows[0] if len(self.rows) == 1 else F.concat(*self.rows)
        return one.select(F.inline(arr))


def _referential(c: Check, child: DataFrame, parent: DataFrame) -> DataFrame:
    """Distinct non-NULL child keys absent from the parent (anti-join)."""
    col = c.columns[0]
    keys = child.select(col).where(F.col(col).isNotNull()).distinct()
    parent_keys = parent.select(F.col(c.parent_column).alias(col)).distinct()
    orphans = keys.join(parent_keys, col, "left_anti").agg(F.count(F.lit(1)).alias("o"))
    o = F.col("o")
    return orphans.select(F.inline(F.array(_row(
        f"ref_integrity_{col}", "consistency", c.table, col,
        F.when(o == 0, "PASS").otherwise("WARN"), o, 0,
        _said("referential", o.cast("string"), c.table),
    ))))


def run_checks(
    tables: dict[str, DataFrame],
    checks: list[Check] | None = None,
    batch_id: str | None = None,
    as_of: str | _dt.datetime | None = None,
    checked_at: str | _dt.datetime | None = None,
    stats: dict[str, dict[str, tuple[float, float]]] | None = None,
) -> DataFrame:
    """Evaluate ``checks`` over ``tables`` (absent tables are skipped).

    ``stats``: mean and population deviation by table and column, where they are
    kept; else z-scores take a pass over the rows for them.
    ``as_of`` is the freshness clock (default: now).  Returns the results
    table rows; ``check_id`` is a stable hash of batch, check, table, column.
    """
    checks = standard_suite() if checks is None else checks
    now = _dt.datetime.now()
    as_of_s = str(as_of or now.replace(microsecond=0))
    batch_id = batch_id or now.strftime("%Y%m%d_%H%M%S")
    compilers: dict[str, _Compiler] = {}
    parts: list[DataFrame] = []
    for c in checks:
        if c.table not in tables:
            continue
        if c.kind == "referential":
            if c.parent_table in tables:
                parts.append(_referential(c, tables[c.table], tables[c.parent_table]))
            continue
        comp = compilers.setdefault(c.table, _Compiler(c.table, tables[c.table], as_of_s, (stats or {}).get(c.table)))
        comp.add(c)
    for comp in compilers.values():
        r = comp.result()
        if r is not None:
            parts.append(r)
    if not parts:
        from pyspark.sql import SparkSession
        spark = next(iter(tables.values())).sparkSession if tables else SparkSession.getActiveSession()
        return spark.createDataFrame([], _results_schema())
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    ts = F.current_timestamp() if checked_at is None else F.lit(str(checked_at)).cast("timestamp")
    key = F.concat_ws("|", F.lit(batch_id), "check_name", "table_name", "column_name")
    return out.select(
        F.substring(F.sha2(key, 256), 1, 12).alias("check_id"),
        "check_name", "check_type", "table_name", "column_name", "status",
        "metric_value", "threshold", "details",
        ts.alias("checked_at"), F.lit(batch_id).alias("batch_id"),
    )


def _results_schema():
    from adpulse.sources.schemas import QUALITY_RESULTS
    return QUALITY_RESULTS


def summary(results: DataFrame) -> DataFrame:
    """Totals per status and the pass rate in percent (1 dp)."""
    s = results.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "PASS").alias("passed"),
        F.count_if(F.col("status") == "WARN").alias("warned"),
        F.count_if(F.col("status") == "FAIL").alias("failed"),
    )
    rate = F.when(F.col("total") > 0, round_half_away(F.col("passed") * 100.0 / F.col("total"), 1)).otherwise(F.lit(0.0))
    exact = F.when(F.col("total") > 0, F.col("passed") * 100.0 / F.col("total")).otherwise(F.lit(0.0))
    # Governance index band on the unrounded rate.
    band = F.when(exact >= SCORE_HEALTHY, "HEALTHY").when(exact >= SCORE_AT_RISK, "AT RISK").otherwise("CRITICAL")
    return s.select("total", "passed", "warned", "failed", rate.alias("pass_rate"), band.alias("score_band"))


def audit_log(results: DataFrame, check_type: str | None = None) -> DataFrame:
    """Stored results, optionally of one check type, newest first."""
    out = results if check_type is None else results.where(F.col("check_type") == check_type)
    return out.orderBy(F.desc("checked_at"), "table_name", "check_name")


class QualityGateError(RuntimeError):
    """Raised when any check in a result set has status FAIL."""


def gate(results: DataFrame) -> DataFrame:
    """(table_name, check_name) of every failed check: what the quality gate stops on."""
    return results.where(F.col("status") == "FAIL").select("table_name", "check_name")


def enforce(results: DataFrame) -> None:
    """Quality gate: raise if any check failed, naming each one."""
    failed = sorted(f"{r.table_name}.{r.check_name}" for r in gate(results).collect())   # as many rows as checks at most
    if failed:
        raise QualityGateError(f"quality gate failed: {', '.join(failed)}")
