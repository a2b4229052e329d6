"""Numeric transforms that need a statistic of the whole column.

The statistic comes from one aggregate, whose single row is joined to the table: no window gathers all rows in a task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.core import as_column, exact_quantiles, one_col, quoted


def _with_statistics(df: DataFrame, column: str, name: str | None, statistics: dict[str, Column], value: Callable[..., Column]) -> DataFrame:
    one = df.agg(*(s.alias(f"_s_{n}") for n, s in statistics.items()))
    out = value(quoted(column), *(F.col(f"_s_{n}") for n in statistics))
    target = name or column
    joined = df.crossJoin(F.broadcast(one))  # one row
    cols = [out.alias(target) if c == target else quoted(c) for c in df.columns]
    return joined.select(*cols, *([] if target in df.columns else [out.alias(target)]))


def rescale(df: DataFrame, column: str, to: tuple[float, float] = (0.0, 1.0), name: str | None = None) -> DataFrame:
    """From the column's range to ``to``."""
    c = quoted(one_col(df, column, "column"))
    return _with_statistics(df, column, name, {"lo": F.min(c), "hi": F.max(c)}, lambda x, lo, hi: F.try_divide(x - lo, hi - lo) * (to[1] - to[0]) + to[0])


def standardize(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """Distance from the mean in sample standard deviations."""
    c = quoted(one_col(df, column, "column"))
    return _with_statistics(df, column, name, {"mean": F.avg(c), "sd": F.stddev_samp(c)}, lambda x, m, s: F.try_divide(x - m, s))


def center(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    c = quoted(one_col(df, column, "column"))
    return _with_statistics(df, column, name, {"mean": F.avg(c)}, lambda x, m: x - m)


def winsorize(df: DataFrame, column: str, probs: tuple[float, float] = (0.01, 0.99), name: str | None = None) -> DataFrame:
    """Clamped to two quantiles (linear interpolation)."""
    c = quoted(one_col(df, column, "column"))
    lo, hi = exact_quantiles(df, column, probs) or (None, None)
    target = name or column
    return df.withColumn(target, c if lo is None else clamp(c.cast("double"), F.lit(lo), F.lit(hi)))


def clamp(c, lower=None, upper=None) -> Column:
    """Between two bounds; NULL stays NULL."""
    x = out = as_column(c)
    if lower is not None:
        out = F.greatest(out, as_column(lower))
    if upper is not None:
        out = F.least(out, as_column(upper))
    return F.when(x.isNotNull(), out)


def quantilegroup(df: DataFrame, column: str, n: int = 5, name: str | None = None, labels: bool = True) -> DataFrame:
    """The group of each value between n + 1 quantiles, closed at the right, the least included: ``(a,b]`` or its number from 1."""
    c = quoted(one_col(df, column, "column"))
    breaks = exact_quantiles(df, column, [i / n for i in range(n + 1)])
    if breaks is None or len(set(breaks)) < n + 1:
        raise ValueError("quantiles are not distinct.")
    text = [f"{b:.3g}" for b in breaks]
    out = F.lit(None)
    for i in range(n, 0, -1):
        label = f"{'[' if i == 1 else '('}{text[i - 1]},{text[i]}]" if labels else i
        out = F.when((c >= breaks[0] if i == 1 else c > breaks[i - 1]) & (c <= breaks[i]), F.lit(label)).otherwise(out)
    return df.withColumn(name or column, out)
