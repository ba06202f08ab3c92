"""Column-expression helpers shared by every layer (all JVM-side, no UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from adpulse.config import CONVERSION_EVENTS, ENGAGEMENT_EVENTS, MONEY_TYPE, NAVIGATION_EVENTS


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_half_away(x, k: int) -> Column:
    """SQL-table rounding: scale in double, round half away from zero, unscale.

    Spark's native ``round`` rounds the decimal text of a double (1.005 -> 1.01);
    the reference's tables round the scaled double (1.005 -> 1.0).
    """
    scale = float(10 ** k)
    return F.round(_col(x).cast("double") * scale, 0) / scale


def round_half_even(x, k: int) -> Column:
    """Report rounding, as a pandas ``Series.round``: rint(x * 10^k) / 10^k."""
    scale = float(10 ** k)
    return F.rint(_col(x).cast("double") * scale) / scale


def safe_ratio(num, den, k: int) -> Column:
    """``CASE WHEN den > 0 THEN ROUND(num / den, k) ELSE 0.0 END``.

    Negative or NULL denominators give 0.0, never NULL; division is in double.
    """
    n, d = _col(num).cast("double"), _col(den)
    return F.when(d > 0, round_half_away(n / d.cast("double"), k)).otherwise(F.lit(0.0))


def guarded_ratio(num, den) -> Column:
    """Unrounded ``num / den`` when ``den > 0`` else 0.0 (report headline form)."""
    n, d = _col(num).cast("double"), _col(den)
    return F.when(d > 0, n / d.cast("double")).otherwise(F.lit(0.0))


def open_ratio(num, den) -> Column:
    """Unguarded report ratio: NULL instead of inf/NaN when den is 0 (ANSI-safe)."""
    return F.try_divide(_col(num).cast("double"), _col(den).cast("double"))


def money(x) -> Column:
    """A money value as a wide decimal: sums of it are exact, in any order."""
    return _col(x).cast(MONEY_TYPE)


def money_sum(x) -> Column:
    """Exact sum of a money column, returned as double; NULL on no rows."""
    return F.sum(money(x)).cast("double")


def exact_mean(x, k: int) -> Column:
    """Mean of values already rounded to k dp, summed exactly in 10^-k units."""
    scale = float(10 ** k)
    units = F.round(_col(x).cast("double") * scale, 0).cast("long")
    return F.sum(units).cast("double") / (F.count(_col(x)).cast("double") * scale)


def event_category(name) -> Column:
    """Business bucket of an event name; unknown and NULL names are 'other'."""
    n = _col(name)
    return (
        F.when(n.isin(*CONVERSION_EVENTS), "conversion")
        .when(n.isin(*ENGAGEMENT_EVENTS), "engagement")
        .when(n.isin(*NAVIGATION_EVENTS), "navigation")
        .otherwise("other")
    )


def thousands(x) -> Column:
    """Integer with thousands separators, like Python's ``f"{n:,}"``."""
    return F.format_number(_col(x).cast("long"), 0)


def fixed(x, k: int) -> Column:
    """Number rounded half away from zero and printed with k decimals."""
    return F.format_string(f"%.{k}f", round_half_away(x, k))


def layer_of(table_name) -> Column:
    """Medallion layer label from the table-name prefix."""
    t = _col(table_name)
    return (
        F.when(t.startswith("bronze"), "BRONZE")
        .when(t.startswith("silver"), "SILVER")
        .when(t.startswith("gold"), "GOLD")
        .otherwise("SYSTEM")
    )
