"""Count, sum and sum of squares per slice, exact and additive.

Values are taken to six decimal places as decimals, so sums do not depend on
order: the state of the whole is the sum of the states of its slices, and a slice
is taken back by subtracting its state.  Mean and population deviation follow
from the three numbers.
"""

from __future__ import annotations

from decimal import Decimal, localcontext

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_VALUE, _SUM = "decimal(18,6)", "decimal(38,12)"


def slice_moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, date, n, s1, s2) of the non-null values of each column on each date."""
    x = F.col("x").cast(_VALUE)
    long = df.select("date", F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("x")) for c in columns])).alias("v"))
    return (long.select("v.column_name", "date", "v.x").where(F.col("x").isNotNull())
            .groupBy("column_name", "date").agg(F.count(F.lit(1)).alias("n"), F.sum(x.cast(_SUM)).cast(_SUM).alias("s1"), F.sum((x * x).cast(_SUM)).cast(_SUM).alias("s2")))


def negated(state: DataFrame) -> DataFrame:
    return state.select("column_name", "date", *[(-F.col(c)).alias(c) for c in ("n", "s1", "s2")])


def added_up(state: DataFrame, *keys: str) -> DataFrame:
    """The state of the union of disjoint slices."""
    sums = [F.sum("n").alias("n"), F.sum("s1").cast(_SUM).alias("s1"), F.sum("s2").cast(_SUM).alias("s2")]
    return state.groupBy("column_name", *keys).agg(*sums).where((F.col("n") != 0) | (F.col("s1") != 0) | (F.col("s2") != 0))


def mean_and_deviation(state: DataFrame) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of each column; as many rows as columns come to the driver."""
    out = {}
    with localcontext() as ctx:
        ctx.prec = 80
        for r in added_up(state).collect():
            if r.n > 0:
                mean = r.s1 / Decimal(r.n)
                out[r.column_name] = (float(mean), float(max(r.s2 / Decimal(r.n) - mean * mean, Decimal(0)).sqrt()))
    return out
