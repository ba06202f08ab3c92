"""Exact distinct counts that merge: bitmaps over dictionary numbers.

A dictionary gives every id a dense number, once and for good.  The ids of a day
and channel are then bitmaps of 32,768 numbers each, and the distinct ids of any
set of days are the union (OR) of their bitmaps.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def placed(ids: DataFrame, column: str) -> DataFrame:
    """(column, place): the distinct ids in order, with partition and place within it; to be written before it is numbered."""
    return ids.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).select(column, F.monotonically_increasing_id().alias("place"))


def numbered(written: DataFrame, column: str, start: int) -> DataFrame:
    """(column, id): the ids of a written ``placed`` table, numbered densely from ``start`` on in their order.

    The driver gets one count for each partition that wrote it.
    """
    part, nth = F.shiftright("place", 33), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted((r["part"], r["n"]) for r in written.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    if not sizes:
        return written.select(column, F.lit(0).cast("long").alias("id"))
    begins = dict(zip([p for p, _ in sizes], accumulate([start, *[n for _, n in sizes]])))
    at = F.element_at(F.create_map(*[F.lit(x) for kv in begins.items() for x in kv]), part)
    return written.select(column, (at + nth).cast("long").alias("id"))


def bitmaps(rows: DataFrame, keys: list[str], number: str = "id") -> DataFrame:
    """(keys, bucket, bitmap) of the numbers that stand beside each key."""
    return (rows.groupBy(*keys, F.bitmap_bucket_number(number).alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("bitmap")))


def distinct_count(state: DataFrame, keys: list[str], name: str = "distinct_count") -> DataFrame:
    """How many different numbers the bitmaps of each key hold together."""
    joined = state.groupBy(*keys, "bucket").agg(F.bitmap_count(F.bitmap_or_agg("bitmap")).alias("_k"))
    return joined.groupBy(*keys).agg(F.sum("_k").alias(name))
