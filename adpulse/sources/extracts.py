"""Source extracts: typed Parquet reads and snappy Parquet writes."""

from __future__ import annotations

import logging

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adpulse.config import SOURCE_MAP
from adpulse.operators.common import SOURCE_COLUMNS
from adpulse.sources import schemas

log = logging.getLogger(__name__)


class ExtractTypeError(ValueError):
    """A file of an extract does not hold the declared columns."""


# Types that a file may hold for a declared one: Parquet readers widen them, and
# days may be ISO text, which is cast.
_WIDENED = {
    T.LongType: (T.IntegerType, T.ShortType, T.ByteType),
    T.IntegerType: (T.ShortType, T.ByteType),
    T.DoubleType: (T.FloatType,),
    T.DateType: (T.StringType,),
}
_EXTRA = ("_load_seq",)


def _is_missing(e: AnalysisException) -> bool:
    return "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e)


def _misfits(found: T.StructType, schema: T.StructType) -> list[str]:
    """What is wrong with a file's types, column by column."""
    out = []
    for f in schema.fields:
        if f.name not in found.names:
            out.append(f"{f.name} is missing")
            continue
        kind = found[f.name].dataType
        if kind != f.dataType and not isinstance(kind, _WIDENED.get(type(f.dataType), ())):
            out.append(f"{f.name} is {kind.simpleString()}, declared {f.dataType.simpleString()}")
    return out


def checked_types(spark: SparkSession, path: str, schema: T.StructType) -> T.StructType:
    """The columns of an extract's files, compared with the declared ones before any row is read.

    Only footers are read, all of them in one job.  Raises ``ExtractTypeError`` with
    the name of the first file that does not fit.
    """
    def of(p: str, merge: bool = False) -> T.StructType:
        return spark.read.option("mergeSchema", merge).parquet(p).schema

    try:
        found = of(path, merge=True)
        if not _misfits(found, schema):
            return found
    except AnalysisException as e:
        if _is_missing(e):
            raise
    except Exception as e:                    # files that contradict one another fail in the job
        if "MERGE" not in str(e).upper():
            raise
    for file in spark.read.schema(schema).parquet(path).inputFiles():
        wrong = _misfits(of(file), schema)
        if wrong:
            raise ExtractTypeError(f"{file}: {'; '.join(wrong)}")
    raise ExtractTypeError(f"{path}: its files hold different types for one column")


def _scan(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A scan with the declared types (days as text where the files hold text), with the file of each row.

    ``_source_file`` is the file's path from the extract's name on, ``_source_modified``
    its modification time; both come from the scan itself.
    """
    found = checked_types(spark, path, schema)
    fields = [T.StructField(f.name, T.StringType()) if isinstance(f.dataType, T.DateType) and isinstance(found[f.name].dataType, T.StringType) else f
              for f in schema.fields]
    fields += [found[c] for c in _EXTRA if c in found.names]
    name = path.rstrip("/").rsplit("/", 1)[-1]
    file = F.concat(F.lit(name), F.substring_index("_metadata.file_path", f"/{name}", -1))
    return (spark.read.schema(T.StructType(fields)).parquet(path)
            .select("*", file.alias("_source_file"), F.col("_metadata.file_modification_time").alias("_source_modified")))


def conform(df: DataFrame, schema: T.StructType, keep_extra: tuple[str, ...] = (*_EXTRA, *SOURCE_COLUMNS)) -> DataFrame:
    """Project ``df`` onto ``schema`` (cast each declared column; keep listed extras).

    Where the file already has the declared type the cast is a no-op and
    filters on the column still reach the Parquet scan.
    """
    cols = [F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields]
    cols += [F.col(c) for c in keep_extra if c in df.columns]
    return df.select(*cols)


def read_extract(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame | None:
    """Whole scan of one extract with its declared types; ``None`` (with a warning) if it is missing."""
    try:
        return conform(_scan(spark, path, schema), schema)
    except AnalysisException as e:
        if _is_missing(e):
            log.warning("source file not found: %s -- skipping", path)
            return None
        raise


def read_extracts(spark: SparkSession, data_dir: str) -> dict[str, DataFrame]:
    """All available extracts under ``data_dir``, keyed by bronze table name."""
    out = {}
    for table, file in SOURCE_MAP.items():
        df = read_extract(spark, f"{data_dir.rstrip('/')}/{file}", schemas.SOURCES[table])
        if df is not None:
            out[table] = df
    return out


def write_extract(df: DataFrame, path: str) -> None:
    """Snappy Parquet extract (overwrites)."""
    df.write.mode("overwrite").option("compression", "snappy").parquet(path)


def in_dates(column: str, dates: list):
    """Predicate for a set of days; a contiguous run becomes one BETWEEN, None stands for NULL dates."""
    import datetime as dt

    days = sorted({d if isinstance(d, dt.date) else dt.date.fromisoformat(str(d)) for d in dates if d is not None})
    lit = lambda d: F.lit(str(d)).cast("date")
    found = F.lit(False)
    if days:
        lo, hi = days[0], days[-1]
        whole = (hi - lo).days + 1 == len(days)
        found = F.col(column).between(lit(lo), lit(hi)) if whole else F.col(column).isin([lit(d) for d in days])
    return found | F.col(column).isNull() if None in dates else found


def slice_dates(df: DataFrame, dates: list) -> DataFrame:
    """Rows of the given dates only (pushed to the scan when ``date`` is typed)."""
    return df.where(in_dates("date", dates))


def read_extract_dates(spark: SparkSession, path: str, schema: T.StructType, dates: list) -> DataFrame | None:
    """The given days of one extract; ``None`` (with a warning) if the file is missing.

    Where the file holds ``date`` as ISO text, the days are also compared as
    text before the cast, so that the bound reaches the scan: text that casts
    to one of the days begins with it.  (Zoned or padded text would not; such
    files are read with ``read_extract`` and sliced.)
    """
    days = sorted(str(d) for d in dates if d is not None)
    try:
        raw = _scan(spark, path, schema)
    except AnalysisException as e:
        if _is_missing(e):
            log.warning("source file not found: %s -- skipping", path)
            return None
        raise
    if isinstance(raw.schema["date"].dataType, T.StringType) and days and None not in dates:
        raw = raw.where(F.col("date").between(days[0], days[-1] + "~"))
    return slice_dates(conform(raw, schema), dates)
