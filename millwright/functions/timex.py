"""Time and numeric Column helpers. Instants travel as epoch microseconds (BIGINT)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

US_PER_S = 1_000_000
US_PER_MIN = 60 * US_PER_S
US_PER_HOUR = 3600 * US_PER_S
US_PER_DAY = 24 * US_PER_HOUR
MS_PER_HOUR = 3.6e6
MS_PER_MIN = 6e4


def us(ts: Column | str) -> Column:
    return F.unix_micros(F.col(ts) if isinstance(ts, str) else ts)


def at(micros: Column | str) -> Column:
    return F.timestamp_micros(F.col(micros) if isinstance(micros, str) else micros)


def floor_div(x: Column, width: int) -> Column:
    """Exact integer floor division of a BIGINT."""
    return ((x - F.pmod(x, F.lit(width).cast("bigint"))) / F.lit(width)).cast("bigint")


def floor_us(x: Column, width: int) -> Column:
    return x - F.pmod(x, F.lit(width).cast("bigint"))


def value_slice(x: Column, steps: int = 64) -> Column:
    """Order-preserving coarse bucket of a double: signed logarithmic steps. For values such as scores whose range is known."""
    x = x.cast("double")
    return (F.signum(x) * F.floor(F.log1p(F.abs(x)) * F.lit(steps))).cast("bigint")


def hours(ms: Column | str) -> Column:
    c = F.col(ms) if isinstance(ms, str) else ms
    return c.try_cast("double") / F.lit(MS_PER_HOUR)


def minutes(ms: Column | str) -> Column:
    c = F.col(ms) if isinstance(ms, str) else ms
    return c.try_cast("double") / F.lit(MS_PER_MIN)


def clamp(x: Column, lo: float, hi: float) -> Column:
    """Clip that keeps NULL (least/greatest alone would replace it by a bound)."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))


def nan_to_null(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def half_up(x: Column | str, digits: int) -> Column:
    """Rounding that does not depend on the last bits of a sum."""
    return F.round(F.round(F.col(x) if isinstance(x, str) else x, 8), digits)


def half_even(x: Column | str, digits: int) -> Column:
    """Banker's rounding, for reported figures that are summed up again."""
    return F.bround(F.round(F.col(x) if isinstance(x, str) else x, 8), digits)
