"""Small plan-level helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


SOURCE_COLUMNS = ("_source_file", "_source_modified")


def with_audit(df: DataFrame, batch_id: str, source_file: str | None = None, loaded_at=None) -> DataFrame:
    """Append the lineage columns ``_loaded_at`` [, ``_source_file``, ``_source_modified``], ``_batch_id``.

    With ``source_file`` the rows are a source's.  Where they carry the file they
    were read from and its modification time, these stay; else ``source_file`` is
    the name and the time is not known.
    """
    ts = F.current_timestamp() if loaded_at is None else F.lit(loaded_at).cast("timestamp")
    rows = [F.col(c) for c in df.columns if source_file is None or c not in SOURCE_COLUMNS]
    cols = [ts.alias("_loaded_at")]
    if source_file is not None:
        file, modified = SOURCE_COLUMNS
        cols.append((F.col(file) if file in df.columns else F.lit(source_file)).alias(file))
        cols.append((F.col(modified) if modified in df.columns else F.lit(None)).cast("timestamp").alias(modified))
    cols.append(F.lit(batch_id).alias("_batch_id"))
    return df.select(*rows, *cols)


def drop_audit(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c in ("_loaded_at", *SOURCE_COLUMNS, "_batch_id", "_load_seq")])
