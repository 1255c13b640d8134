"""Ratios that can't fail, rounding, and functions SQL lacks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rate(part: Column, whole: Column, digits: int = 6) -> Column:
    """part / whole rounded; null where the whole isn't positive."""
    return F.when(whole > 0, F.round(part.cast("double") / whole.cast("double"), digits))


def floored_ratio(part: Column, whole: Column) -> Column:
    """part over the whole, which counts as 1 at least."""
    return part.cast("double") / F.greatest(whole.cast("double"), F.lit(1.0))


def half_up(value: Column, digits: int) -> Column:
    """Rounded half away from zero, as decimals are."""
    return F.round(value.cast("decimal(38,10)"), digits)


def finite(value: Column) -> Column:
    """0 for null, NaN and the infinities."""
    number = value.cast("double")
    return F.when(number.isNull() | F.isnan(number) | (F.abs(number) == float("inf")), 0.0).otherwise(number)


def logistic(value: Column) -> Column:
    """1 / (1 + exp(-x))."""
    return 1.0 / (1.0 + F.exp(-value))


#: The polynomial of Abramowitz and Stegun 7.1.26 for the error function, within 1.5e-7.
ERF = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
ERF_SCALE = 0.3275911


def normal_cdf(value: Column) -> Column:
    """The standard normal distribution function, within 1e-7."""
    x = F.abs(value) / F.lit(2.0**0.5)
    t = 1.0 / (1.0 + ERF_SCALE * x)
    series = F.lit(0.0)
    for c in reversed(ERF):
        series = (series + c) * t
    erf = 1.0 - series * F.exp(-x * x)
    return 0.5 * (1.0 + F.signum(value) * erf)


#: Steps of days to expiry and what lies beyond them.
EXPIRY = ([(30, "00_30"), (60, "31_60"), (90, "61_90"), (180, "91_180"), (365, "181_365")], "366_plus")


def ladder(value: Column, steps: list[tuple[float, str]], beyond: str, strict: bool = False) -> Column:
    """The label of the first step that a value isn't above (``strict``: is under), or ``beyond``; null for null."""
    label = F.when(value.isNotNull(), beyond)
    for bound, name in reversed(steps):
        label = F.when(value < bound if strict else value <= bound, name).otherwise(label)
    return label
