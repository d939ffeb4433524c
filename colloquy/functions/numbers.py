"""Number, time and vector functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000
WEEK_MS = 7 * DAY_MS


def millis(ts: Column) -> Column:
    """Epoch milliseconds; null where a string isn't a timestamp."""
    return F.unix_millis(ts.cast("timestamp"))


def parsed_millis(ts: Column) -> Column:
    return F.unix_millis(F.try_to_timestamp(ts))


def working_day(ts: Column) -> Column:
    """The day that starts at four o'clock."""
    return F.to_date(ts.cast("timestamp") - F.expr("interval 4 hours"))


def round_half_up(c: Column, digits: int) -> Column:
    """Rounds halves towards plus infinity."""
    return F.floor(c * 10**digits + 0.5) / F.lit(float(10**digits))


def rate(part: Column, of: Column) -> Column:
    return F.when(of == 0, 0.0).otherwise(part / F.nullif(of, F.lit(0)))


def lift(neg: Column, neg_total: Column, ordinary: Column, ordinary_total: Column) -> Column:
    """P(category | negative) / P(category | ordinary): infinite if never ordinary, 0 if never at all."""
    p_neg, p_ord = rate(neg, neg_total), rate(ordinary, ordinary_total)
    return F.when(p_ord == 0, F.when(p_neg > 0, float("inf")).otherwise(0.0)).otherwise(p_neg / F.nullif(p_ord, F.lit(0.0)))


def headroom(p: Column, base: Column) -> Column:
    """How much of what is left above the base rate p takes."""
    return (p - base) / F.nullif(1 - base, F.lit(0.0))


def floor_quantile(values: Column, fraction: float) -> Column:
    """The element at floor(n * fraction) of a sorted array."""
    n = F.size(values)
    at = F.least(n - 1, F.floor(n * F.lit(fraction)).cast("int"))
    return F.get(values, at)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)

