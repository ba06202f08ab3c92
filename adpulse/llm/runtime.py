"""Session settings, tables kept between jobs, and job sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adpulse.session import configure, scratch_path

# Rows and bytes handed to Python at a time: a task's memory does not depend
# on how long the texts are, but for a single text that is longer than that.
ARROW_CONF = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}


def prepare(spark: SparkSession) -> SparkSession:
    configure(spark)
    for k, v in ARROW_CONF.items():
        spark.conf.set(k, v)
    return spark


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a new table in the shared folder and read it again.

    This cuts lineage for iterations and for results that several later jobs
    read: the files outlive any executor.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def folded(name: str, modulus: int, remainder: int):
    """Whether crc32 of the id as text leaves this remainder; a null id does not."""
    return F.coalesce(F.crc32(F.col(name).cast("string").cast("binary")) % modulus == remainder, F.lit(False))
