"""Warehouse: one catalog database of Parquet tables at a shared location.

Fact, silver and gold tables are partitioned by ``date``.  A warehouse opened
with ``grain="month"`` partitions new tables by ``date_month`` (first day of the
month) instead, for small data; each table keeps the grain it was made with,
recorded by its schema (``date_month`` present or not).

A date slice is replaced with dynamic partition overwrite: under the daily
grain the slice's partitions are rewritten directly; under the monthly
grain the affected months are rewritten as (old rows outside the slice) +
(new rows).  Partitions left without rows are dropped (a DELETE that
inserts nothing).  Rows without a date are a slice of their own, ``None``.
Writes go through Spark's commit protocol, so a lost executor only reruns its
tasks.

A full replace is published in two phases.  The rows are written to a new
version folder of the table; when they are all there, an empty marker file
publishes that version, and the catalog's table is switched to it.  Until then
readers see the old version, and a write that fails leaves it as it was.  The
version before the current one is kept for readers that still scan it.

The tables outlive the session: their files lie under ``location``, and
opening a warehouse there registers the published version of every table.
Declared columns have their defaults (``schemas.DEFAULTS``), and every insert
overwrites the partitions it names, whatever the session's overwrite mode.
"""

from __future__ import annotations

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adpulse.config import STAGE_PREFIX
from adpulse.functions.exprs import layer_of
from adpulse.session import configure
from adpulse.sources.extracts import in_dates, slice_dates
from adpulse.sources.schemas import DEFAULTS, TABLES

MONTH_COL = "date_month"
_MARKER, _VERSION = "_published-", "v"


def _q(name: str) -> str:
    return f"`{name}`"


class Warehouse:
    def __init__(self, spark: SparkSession, database: str, location: str, grain: str = "day", pii_salt: str | None = None, session_buckets: int = 32):
        """Opens the warehouse at ``location``, a folder that driver and executors share.

        ``session_buckets`` is how many buckets the kept session counts are dealt
        over, the same for the life of a warehouse.  ``pii_salt`` belongs to the warehouse: every job that loads events into
        it hashes user and session ids with it.
        """
        if grain not in ("day", "month"):
            raise ValueError("grain is 'day' or 'month'")
        configure(spark)
        self.spark = spark
        self.database = database
        self.grain = grain
        self.pii_salt = pii_salt
        self.session_buckets = session_buckets
        self._footer_session: SparkSession | None = None
        self.location = location.rstrip("/")
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {_q(database)} LOCATION '{self.location}'")
        self._register()

    def path(self, table: str) -> str:
        return f"{self.location}/{table}"

    # -- files ---------------------------------------------------------------
    def _fs(self, path: str) -> tuple:
        """(file system, path) as the session's Hadoop settings see them."""
        jvm, conf = self.spark._jvm, self.spark._jsparkSession.sessionState().newHadoopConf()
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(conf), p

    def _folders(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def _delete(self, path: str) -> None:
        fs, p = self._fs(path)
        fs.delete(p, True)

    def _versions(self, table: str) -> tuple[list[int], list[int]]:
        """(published versions, all version folders) of a table, ascending."""
        names = self._folders(self.path(table))
        number = lambda prefix: sorted(int(n[len(prefix):]) for n in names if n.startswith(prefix) and n[len(prefix):].isdigit())
        return number(_MARKER), number(_VERSION)

    def version_path(self, table: str, version: int) -> str:
        return f"{self.path(table)}/{_VERSION}{version}"

    def _new_version(self, table: str) -> int:
        published, folders = self._versions(table)
        return max([0, *published, *folders]) + 1

    def _publish(self, table: str, version: int, columns: list[T.StructField], partition_by: str | None) -> None:
        """Makes a written version the table: first its marker, then the catalog, then the versions before the last go."""
        fs, marker = self._fs(f"{self.path(table)}/{_MARKER}{version}")
        if not fs.createNewFile(marker):
            raise RuntimeError(f"version {version} of {table} was published by another job")
        self._switch(table, version, columns, partition_by)
        published, folders = self._versions(table)
        for old in [v for v in {*published, *folders} if v < version and v not in published[-2:]]:
            self._delete(f"{self.path(table)}/{_MARKER}{old}")
            self._delete(self.version_path(table, old))

    def _switch(self, table: str, version: int, columns: list[T.StructField], partition_by: str | None) -> None:
        """Points the catalog's table at a version: registered aside with its partitions, then renamed."""
        aside = f"{table}__v{version}"
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name(aside)}")
        defaults = DEFAULTS.get(table, {})
        ddl = ", ".join(f"{_q(f.name)} {f.dataType.simpleString()}" + (f" DEFAULT {defaults[f.name]}" if f.name in defaults else "") for f in columns)
        by = f" PARTITIONED BY ({_q(partition_by)})" if partition_by else ""
        self.spark.sql(f"CREATE TABLE {self.name(aside)} ({ddl}) USING parquet OPTIONS (partitionOverwriteMode 'dynamic'){by} LOCATION '{self.version_path(table, version)}'")
        if partition_by:
            self.spark.sql(f"ALTER TABLE {self.name(aside)} RECOVER PARTITIONS")
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name(table)}")         # the name only: the files stay
        self.spark.sql(f"ALTER TABLE {self.name(aside)} RENAME TO {self.name(table)}")

    def _register(self) -> None:
        """Brings the catalog to the published versions found at the location."""
        present = set(self._folders(self.location))
        for table, (schema, partition) in TABLES.items():
            published = self._versions(table)[0] if table in present else []
            if not published:
                continue
            path = self.version_path(table, published[-1])
            if self.exists(table) and self.location_of(table).endswith(f"/{table}/{_VERSION}{published[-1]}"):
                self.spark.catalog.refreshTable(self.name(table))
                continue
            columns = list(schema.fields)
            if partition == "date" and any(x.startswith(f"{MONTH_COL}=") for x in self._folders(path)):
                columns, partition = [*columns, T.StructField(MONTH_COL, T.DateType())], MONTH_COL
            self._switch(table, published[-1], columns, partition)

    def refresh(self) -> None:
        """Takes up what other sessions have written since the warehouse was opened."""
        self._register()

    # -- catalog -------------------------------------------------------------
    def name(self, table: str) -> str:
        return f"{_q(self.database)}.{_q(table)}"

    def exists(self, table: str) -> bool:
        return self.spark.catalog.tableExists(f"{self.database}.{table}")

    def tables(self) -> list[str]:
        """The user's tables; those that only the jobs use are left out."""
        names = (t.name for t in self.spark.catalog.listTables(self.database))
        return sorted(n for n in names if not n.startswith(STAGE_PREFIX) and "__v" not in n)

    def _raw(self, table: str) -> DataFrame:
        return self.spark.table(self.name(table))

    def read(self, table: str) -> DataFrame:
        df = self._raw(table)
        return df.drop(MONTH_COL) if MONTH_COL in df.columns else df

    def read_dates(self, table: str, dates: list) -> DataFrame:
        """Rows of ``dates`` with partition pruning under either grain."""
        df = self._raw(table)
        if MONTH_COL in df.columns:
            df = df.where(in_dates(MONTH_COL, [_month(d) for d in dates])).drop(MONTH_COL)
        return slice_dates(df, dates)

    def grain_of(self, table: str) -> str:
        return "month" if MONTH_COL in self._raw(table).columns else "day"

    def read_or_empty(self, table: str, schema: T.StructType | None = None) -> DataFrame:
        """The table, or an empty frame of its declared schema when it does not exist."""
        if self.exists(table):
            return self.read(table)
        return self.spark.createDataFrame([], schema or TABLES[table][0])

    def row_count(self, table: str) -> int:
        return self.read(table).count()

    # -- bounds from metadata --------------------------------------------------
    def _footers(self, table: str) -> DataFrame:
        """The table's files, in a session of its own whose plain counts and bounds are answered from Parquet footers."""
        if self._footer_session is None:
            self._footer_session = configure(self.spark.newSession())
            self._footer_session.conf.set("spark.sql.sources.useV1SourceList", "")
            self._footer_session.conf.set("spark.sql.parquet.aggregatePushdown", "true")
        return self._footer_session.read.schema(self._raw(table).schema).parquet(self.location_of(table))

    def footer_bounds(self, table: str, column: str, partition: tuple | None = None) -> DataFrame:
        """One row (lo, hi, n) of the table, or of one (column, value) partition, from footers alone."""
        files = self._footers(table)
        if partition is not None:
            files = files.where(F.col(partition[0]) == F.lit(partition[1]))
        return files.agg(F.min(column).alias("lo"), F.max(column).alias("hi"), F.count(F.lit(1)).alias("n"))

    def bounds(self, table: str, column: str = "date") -> tuple:
        """(min, max) of a column, exact, (None, None) without values; no data page is read for dates.

        A partition column's bounds are partition names, of partitions whose footers
        count rows.  Other columns' come from footers: of the first and the last
        months for ``date`` under the monthly grain, else of all files.  Files whose
        footers do not tell (no statistics, or a type without them) are scanned.
        """
        raw = self._raw(table)
        by = MONTH_COL if MONTH_COL in raw.columns else "date"
        if column != "date" or by not in raw.columns or not self._is_partitioned(table, by):
            return self._bounds_of(table, column, None)
        values = sorted(v for v in self.partition_values(table, by) if v is not None)
        ends = []
        for way in (values, values[::-1]):
            found = None
            for v in way:                                # nearly always the first one answers
                if by == "date":
                    found = v if self._footers(table).where(F.col(by) == F.lit(v)).agg(F.count(F.lit(1))).first()[0] else None
                else:
                    found = self._bounds_of(table, column, (by, v))[len(ends)]
                if found is not None:
                    break
            ends.append(found)
        return tuple(ends)

    def _bounds_of(self, table: str, column: str, partition: tuple | None) -> tuple:
        try:
            r = self.footer_bounds(table, column, partition).first()
        except Exception as e:
            if "min/max" not in str(e) and "nulls" not in str(e) and "AGGREGATE" not in str(e).upper():
                raise
            rows = self._raw(table)
            rows = rows if partition is None else rows.where(F.col(partition[0]) == F.lit(partition[1]))
            r = rows.agg(F.min(column).alias("lo"), F.max(column).alias("hi")).first()
        return r["lo"], r["hi"]

    def _is_partitioned(self, table: str, column: str) -> bool:
        return any(c.name == column and c.isPartition for c in self.spark.catalog.listColumns(f"{self.database}.{table}"))

    def execute(self, sql: str, params: dict | list | None = None) -> DataFrame:
        """Ad-hoc SQL in this database with bound parameters (``:name`` or ``?``)."""
        self.spark.catalog.setCurrentDatabase(self.database)
        return self.spark.sql(sql, args=params) if params else self.spark.sql(sql)

    def execute_script(self, script: str) -> DataFrame:
        """Runs one text of several statements as a Spark SQL script; the result of its last query.

        A text without ``BEGIN ... END`` is put into one.  Spark's own parser tells
        statements apart, so a ``;`` in a literal or a comment ends none, and local
        variables, conditions, loops and handlers are there to use.
        """
        body = script.strip().rstrip(";")
        compound = body.upper().startswith("BEGIN") and body.upper().endswith("END")
        if compound:
            return self.execute(body)
        try:
            return self.execute(f"BEGIN\n{body}\n;\nEND")      # parsed as a whole before anything runs
        except ParseException:
            return self.execute(f"BEGIN\n{body}\nEND")          # it ended its last statement before a comment

    def inventory(self) -> DataFrame:
        """(table_name, row_count, layer) for every table, sorted by name.

        One count job per table: the union of per-table counts is a single
        plan whose branches run as parallel stages.
        """
        parts = [
            self.read(t).agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(t).alias("table_name"), "row_count")
            for t in self.tables()
        ]
        if not parts:
            return self.spark.createDataFrame([], "table_name string, row_count long, layer string")
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.select("table_name", "row_count", layer_of("table_name").alias("layer")).orderBy("table_name")

    # -- writes --------------------------------------------------------------
    @staticmethod
    def _clustered(df: DataFrame, partition_by: str | None, sort_by: list[str] | None) -> DataFrame:
        """Shape rows for a partitioned write: ``REBALANCE`` on the partition column.

        Rows of one partition value meet in one task (one file per value),
        and AQE splits a value holding a large share of the rows into
        several tasks and packs small values together; unlike a range
        repartition this needs no sampling pass over the upstream plan.
        """
        if partition_by is None:
            return df.sortWithinPartitions(*sort_by) if sort_by else df
        out = df.hint("rebalance", partition_by)
        return out.sortWithinPartitions(partition_by, *sort_by) if sort_by else out

    def replace(self, table: str, df: DataFrame, partition_by: str | None = None,
                sort_by: list[str] | None = None, grain: str | None = None) -> None:
        """Idempotent full replace of ``table`` with ``df``: written aside, then published.

        ``partition_by="date"`` asks for time partitioning: by the table's own
        grain if it exists, else by ``grain``, else by the warehouse's.
        """
        if partition_by == "date":
            grain = self.grain_of(table) if self.exists(table) else grain or self.grain
            if grain == "month":
                df, partition_by = df.withColumn(MONTH_COL, F.trunc("date", "MM")), MONTH_COL
        version = self._new_version(table)
        w = self._clustered(df, partition_by, sort_by).write.format("parquet")
        if partition_by:
            w = w.partitionBy(partition_by)
        w.save(self.version_path(table, version))
        columns = [f for f in df.schema.fields if f.name != partition_by]
        if partition_by:
            columns.append(df.schema[partition_by])
        self._publish(table, version, columns, partition_by)

    def append(self, table: str, df: DataFrame, partition_by: str | None = None) -> None:
        """Adds rows to an existing table."""
        target = self._raw(table)
        self._clustered(df.select(*target.columns), partition_by, None).write.insertInto(self.name(table))

    def replace_dates(self, table: str, df: DataFrame, dates: list, sort_by: list[str] | None = None,
                      dates_from: DataFrame | None = None) -> None:
        """Replace the ``dates`` slice of a time-partitioned table with ``df``.

        ``df`` must only hold rows of ``dates``; afterwards the slice holds
        exactly ``df`` and every other date is untouched.  ``dates_from`` is
        a cheaper frame with the same set of dates as ``df`` (for a silver
        slice, its bronze slice), so finding which dates got rows does not
        re-run ``df``'s plan.
        """
        present = {r[0] for r in (dates_from if dates_from is not None else df).select("date").distinct().collect()}   # bounded by the calendar
        if self.grain_of(table) == "month":
            self._replace_months(table, df, dates, present, sort_by)
            return
        target = self._raw(table)
        self._clustered(df.select(*target.columns), "date", sort_by).write.insertInto(self.name(table), overwrite=True)
        # Dates of the slice that got no new rows but still hold old ones are
        # dropped.  Both sets are bounded by the number of dates.
        self._drop_partitions(table, "date", (set(self.partition_values(table, "date")) & {_as_date(d) for d in dates}) - present)

    def _replace_months(self, table: str, df: DataFrame, dates: list, present: set, sort_by: list[str] | None) -> None:
        """Monthly grain: rewrite each touched month as old-outside-slice + new.

        Dynamic overwrite stages the output and swaps whole month partitions
        at commit, so reading the old rows of those months in the same job
        is safe.  A month left with no rows at all is dropped.
        """
        target = self._raw(table)
        months = {_month(d) for d in dates}
        kept = target.where(in_dates(MONTH_COL, list(months)) & ~F.coalesce(in_dates("date", dates), F.lit(False))).drop(MONTH_COL)
        data_cols = [c for c in target.columns if c != MONTH_COL]
        merged = kept.unionByName(df.select(*data_cols)).withColumn(MONTH_COL, F.trunc("date", "MM"))
        # Months that will still hold rows, known before the table changes.
        kept_months = {r[0] for r in kept.select(F.trunc("date", "MM")).distinct().collect()}
        filled = kept_months | {_month(d) for d in present}
        self._clustered(merged.select(*target.columns), MONTH_COL, sort_by).write.insertInto(self.name(table), overwrite=True)
        self._drop_partitions(table, MONTH_COL, (set(self.partition_values(table, MONTH_COL)) & months) - filled)

    def _drop_partitions(self, table: str, column: str, values) -> None:
        stale = sorted(values, key=str)
        for i in range(0, len(stale), 200):
            specs = ", ".join(f"PARTITION ({column} = " + (f"DATE '{d}')" if d is not None else "NULL)") for d in stale[i:i + 200])
            self.spark.sql(f"ALTER TABLE {self.name(table)} DROP IF EXISTS {specs}")
        base = self.location_of(table)
        for d in stale:                                # the catalog forgets a partition; its files go too
            self._delete(f"{base}/{column}={d if d is not None else '__HIVE_DEFAULT_PARTITION__'}")

    def location_of(self, table: str) -> str:
        """The folder of the table's current version."""
        return next(r[1] for r in self.spark.sql(f"DESCRIBE TABLE EXTENDED {self.name(table)}").collect() if r[0] == "Location")

    def drop(self, table: str) -> None:
        """The table, with every version of it."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name(table)}")
        self._delete(self.path(table))

    def drop_dates_before(self, table: str, cutoff) -> list:
        """Removes every date before ``cutoff``; the dates that went.

        Under the daily grain this is a range of partitions dropped by name, and no
        job runs.  Under the monthly grain whole months go the same way, and only a
        month that the cutoff falls in is written again without its earlier dates.
        """
        if self.grain_of(table) == "day":
            old = sorted(d for d in self.partition_values(table, "date") if d is not None and d < cutoff)
            self._drop_partitions(table, "date", old)
            return old
        months = [m for m in self.partition_values(table, MONTH_COL) if m is not None and m < cutoff]
        rows = self._raw(table).where(in_dates(MONTH_COL, months))
        old = sorted(r[0] for r in rows.where(F.col("date") < F.lit(cutoff)).select("date").distinct().collect())
        straddling = [m for m in months if m == _month(cutoff)]
        whole = [m for m in months if m not in straddling]
        if straddling and any(_month(d) == straddling[0] for d in old):
            self._replace_months(table, self.read(table).limit(0), [d for d in old if _month(d) == straddling[0]], set(), None)
        self._drop_partitions(table, MONTH_COL, whole)
        return old

    def partition_values(self, table: str, column: str) -> list:
        """Values of a date-typed partition column (catalog metadata only); None for rows without a date."""
        rows = self.spark.sql(f"SHOW PARTITIONS {self.name(table)}").collect()
        values = [r[0].split("=", 1)[1] for r in rows if r[0].startswith(f"{column}=")]
        return [None if v in ("__HIVE_DEFAULT_PARTITION__", "null") else _as_date(v) for v in values]

    def partition_dates(self, table: str) -> list:
        """Dates that hold rows: partition values, or distinct dates under the monthly grain."""
        if self.grain_of(table) == "day":
            return self.partition_values(table, "date")
        return [r[0] for r in self.read(table).select("date").distinct().collect()]

    def replace_where(self, table: str, df: DataFrame, column: str, schema: T.StructType | None = None) -> None:
        """Batch replace: the rows of ``df`` take the place of the ``column`` partitions that they name.

        The table is created (partitioned by ``column``) when absent.
        """
        if not self.exists(table):
            fields = list((schema or df.schema).fields)
            version = self._new_version(table)
            fs, folder = self._fs(self.version_path(table, version))
            fs.mkdirs(folder)
            self._publish(table, version, [f for f in fields if f.name != column] + [f for f in fields if f.name == column], column)
        target = self.read(table)
        df.select(*target.columns).write.insertInto(self.name(table), overwrite=True)


def _as_date(d):
    import datetime as dt
    if d is None:
        return None
    if isinstance(d, dt.datetime):
        return d.date()
    return d if isinstance(d, dt.date) else dt.date.fromisoformat(str(d))


def _month(d):
    return None if d is None else _as_date(d).replace(day=1)

