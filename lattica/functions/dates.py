"""Dates and times (session time zone; use UTC)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.core import as_column

UNITS = ("day", "week", "month", "year")
SECONDS = {"secs": 1, "mins": 60, "hours": 3600, "days": 86400, "weeks": 604800}


def year(c) -> Column:
    return F.year(as_column(c))


def month(c) -> Column:
    return F.month(as_column(c))


def day(c) -> Column:
    return F.dayofmonth(as_column(c))


def weekday(c) -> Column:
    """The day's full name."""
    return F.date_format(as_column(c), "EEEE")


def yearday(c) -> Column:
    return F.dayofyear(as_column(c))


def week(c) -> Column:
    """Weeks that start on Sunday, 0 to 53; days before the first Sunday are in week 0."""
    x = as_column(c)
    return F.floor((F.dayofyear(x) - 1 + 7 - (F.dayofweek(x) - 1)) / 7).cast("int")


def quarter(c) -> Column:
    return F.quarter(as_column(c))


def hour(c) -> Column:
    return F.hour(as_column(c))


def minute(c) -> Column:
    return F.minute(as_column(c))


def second(c) -> Column:
    return F.second(as_column(c))


def _unit(unit: str) -> str:
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {', '.join(UNITS)}.")
    return unit


def floordate(c, unit: str = "day") -> Column:
    """The start of the day, week (Monday), month or year."""
    d = as_column(c).cast("date")
    return d if _unit(unit) == "day" else F.trunc(d, unit)


def ceilingdate(c, unit: str = "day") -> Column:
    """The next start, even from a start; a day is its own."""
    low = floordate(c, unit)
    return {"day": lambda: low, "week": lambda: F.date_add(low, 7), "month": lambda: F.add_months(low, 1), "year": lambda: F.add_months(low, 12)}[unit]()


def rounddate(c, unit: str = "day") -> Column:
    """The nearer start, the earlier of two equally near."""
    d, low, high = as_column(c).cast("date"), floordate(c, unit), ceilingdate(c, unit)
    return F.when(F.datediff(d, low) <= F.datediff(high, d), low).otherwise(high)


def adddays(c, n) -> Column:
    return F.date_add(as_column(c), n if isinstance(n, Column) else F.lit(n))


def addweeks(c, n) -> Column:
    return F.date_add(as_column(c), (n if isinstance(n, Column) else F.lit(n)) * 7)


def addmonths(c, n: int, invalid: str = "previous") -> Column:
    """Months later; a day that the month lacks is its last day, the overflow into the next month, NULL or an error."""
    if invalid not in ("previous", "next", "missing", "error"):
        raise ValueError("invalid must be previous, next, missing or error.")
    d = as_column(c).cast("date")
    last = F.add_months(d, n)
    if invalid == "previous":
        return last
    over = F.date_add(F.add_months(F.trunc(d, "month"), n), F.dayofmonth(d) - 1)
    if invalid == "next":
        return over
    other = F.lit(None).cast("date") if invalid == "missing" else F.raise_error(F.lit("Invalid date.")).cast("date")
    return F.when(d.isNull() | (over == last), last).otherwise(other)


def addyears(c, n: int, invalid: str = "previous") -> Column:
    return addmonths(c, 12 * n, invalid)


def datediff(x, y, units: str = "days") -> Column:
    """x - y, with fractions."""
    if units not in SECONDS:
        raise ValueError(f"units must be one of {', '.join(SECONDS)}.")
    a, b = (F.unix_micros(as_column(v).cast("timestamp")) for v in (x, y))
    return (a - b) / (SECONDS[units] * 1e6)


def dateseq(spark: SparkSession, start: str, end: str, by: str = "day", length_out: int | None = None) -> DataFrame:
    """Dates from ``start`` to ``end`` by a step such as "day" or "2 weeks", or ``length_out`` evenly spaced ones."""
    a, b = F.lit(start).cast("date"), F.lit(end).cast("date")
    if length_out is not None:
        if length_out < 1:
            raise ValueError("length_out must be positive.")
        step = F.datediff(b, a) / max(1, length_out - 1)
        return spark.range(length_out).select(F.date_add(a, F.floor(F.col("id") * step).cast("int")).alias("date"))
    number, unit = by.split() if " " in by else ("1", by)
    unit = unit.removesuffix("s")
    _unit("month" if unit == "quarter" else unit)
    step = F.expr(f"interval {int(number) * (3 if unit == 'quarter' else 1)} {'month' if unit == 'quarter' else unit}")
    return spark.range(1).select(F.explode(F.sequence(a, b, step)).alias("date"))


def betweendates(c, start, end) -> Column:
    """From ``start`` to ``end``, both included."""
    bound = lambda v: (v if isinstance(v, Column) else F.lit(v)).cast("date")
    return as_column(c).cast("date").between(bound(start), bound(end))
