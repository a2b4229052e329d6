"""Shifts, ranks, cumulative and rolling functions.

Each takes a column and ``order`` (names or sort Columns), and ``by`` to start over for each key. Without ``by`` Spark
sorts all rows in one task, as the row order of a whole table demands.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from lattica.core import Names, as_column, names_of, quoted, range_of, value_bounds, window


def lagvalue(c, n: int = 1, default=None, *, order, by: Names | None = None) -> Column:
    return F.lag(as_column(c), n, default).over(window(by, order))


def leadvalue(c, n: int = 1, default=None, *, order, by: Names | None = None) -> Column:
    return F.lead(as_column(c), n, default).over(window(by, order))


def difference(c, lag: int = 1, *, order, by: Names | None = None) -> Column:
    return as_column(c) - lagvalue(c, lag, order=order, by=by)


def percentchange(c, *, order, by: Names | None = None) -> Column:
    """Change against the value before, in percent; NULL where that is 0."""
    before = lagvalue(c, order=order, by=by)
    return F.try_divide(as_column(c) - before, before) * 100


def rownumber(*, order, by: Names | None = None) -> Column:
    return F.row_number().over(window(by, order))


cumcount = rownumber


def _over_values(c: Column, by: Names | None):
    return Window.partitionBy(*(quoted(b) for b in names_of(by or []))).orderBy(c.asc_nulls_last())


def denserank(c, by: Names | None = None) -> Column:
    """Dense rank of the values; NULL has none."""
    x = as_column(c)
    return F.when(x.isNotNull(), F.dense_rank().over(_over_values(x, by)))


def percentrank(c, by: Names | None = None) -> Column:
    """Average rank over the number of values that aren't NULL (not SQL's PERCENT_RANK).

    As a Column it sorts each group in one task; ``averaged_rank`` adds the same by counts and suits long groups.
    """
    x, keys = as_column(c), [quoted(b) for b in names_of(by or [])]
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, x))
    return F.when(x.isNotNull(), (F.rank().over(_over_values(x, by)) + (ties - 1) / 2) / F.count(x).over(Window.partitionBy(*keys)))


def averaged_rank(df, c, by: Names | None = None, name: str = "percentrank", ranges: int = 64):
    """``percentrank`` as a new column of ``df`` without sorting a whole group in one task.

    Rows of each value are counted; the counts are summed within ranges of the value, after the sums of the ranges before.
    """
    keys = names_of(by or [])
    valued = df.withColumn("_v", as_column(c))
    key = F.struct(*map(quoted, keys), F.lit(0).alias("_"))  # fields of structs match NULL with NULL
    ties = valued.filter(F.col("_v").isNotNull()).select(key.alias("_k"), "_v").groupBy("_k", "_v").agg(F.count(F.lit(1)).alias("_n"))
    ties = ties.withColumn("_range", range_of(["_v"], ties, value_bounds(valued, ["_v"], ranges)))
    sums = ties.groupBy("_k", "_range").agg(F.sum("_n").alias("_sum"))  # at most so many rows as ranges for each group
    sums = sums.select("_k", "_range", (F.sum("_sum").over(Window.partitionBy("_k").orderBy("_range")) - F.col("_sum")).alias("_before"), F.sum("_sum").over(Window.partitionBy("_k")).alias("_all"))
    below = F.sum("_n").over(Window.partitionBy("_k", "_range").orderBy("_v")) - F.col("_n")
    ranks = ties.withColumn("_below", below).join(sums, ["_k", "_range"])
    ranks = ranks.select(F.col("_k").alias("_rk"), F.col("_v").alias("_rv"), ((F.col("_before") + F.col("_below") + 1 + (F.col("_n") - 1) / 2) / F.col("_all")).alias("_rank"))
    out = valued.withColumn("_k", key).join(ranks, (F.col("_k") == F.col("_rk")) & (F.col("_v") == F.col("_rv")), "left")
    return out.select(*(quoted(col) for col in df.columns if col != name), F.col("_rank").alias(name))


def cumedist(c, *, order, by: Names | None = None) -> Column:
    """Distinct values so far over the number of rows so far (not SQL's CUME_DIST).

    As a Column it keeps the set of values so far; ``running_distinct`` adds the same without sets and suits long groups.
    """
    x = as_column(c)
    spec = window(by, order)
    # a row brings something new if its value's first row number is its own: kept as a set of first places
    so_far = F.size(F.collect_set(F.coalesce(x.cast("string"), F.lit("\x00"))).over(spec.rowsBetween(Window.unboundedPreceding, 0)))
    return so_far / F.row_number().over(spec)


def running_distinct(df, c: str, *, order, by: Names | None = None, name: str = "cumedist"):
    """``cumedist`` as a new column of ``df`` without sets: the first row of each value is flagged and flags are summed."""
    keys = names_of(by or [])
    flag = (F.row_number().over(window([*keys, c], order)) == 1).cast("int")
    spec = window(by, order)
    return df.withColumn("_new", flag).withColumn(name, F.sum("_new").over(spec.rowsBetween(Window.unboundedPreceding, 0)) / F.row_number().over(spec)).drop("_new")


def cummean(c, *, order, by: Names | None = None) -> Column:
    """Mean so far; NULL from the first NULL on."""
    x, spec = as_column(c), window(by, order).rowsBetween(Window.unboundedPreceding, 0)
    return F.when(F.count(x).over(spec) == F.count(F.lit(1)).over(spec), F.avg(x).over(spec))


def _bounds(width: int, align: str) -> tuple[int, int]:
    if width < 1 or align not in ("right", "left", "center"):
        raise ValueError("width must be positive, align right, left or center.")
    before = {"right": width - 1, "left": 0, "center": (width - 1) // 2}[align]
    return -before, width - 1 - before


def _rolled(c, value: Callable[[Column], Column], width: int, align: str, fill, partial: bool, na_rm: bool, order, by) -> Column:
    """``value`` (an aggregate) over a moving frame; incomplete frames give ``fill`` unless ``partial``, frames with NULL give NULL unless ``na_rm``."""
    x, spec = as_column(c), window(by, order).rowsBetween(*_bounds(width, align))
    rows = F.count(F.lit(1)).over(spec)
    out = value(x).over(spec)
    if not na_rm:
        out = F.when(F.count(x).over(spec) == rows, out)
    return out if partial else F.when(rows == width, out).otherwise(F.lit(fill))


def _rolling(name: str, value: Callable[[Column], Column]):
    def roll(c, width: int, align: str = "right", fill=None, partial: bool = False, na_rm: bool = False, *, order, by: Names | None = None) -> Column:
        return _rolled(c, value, width, align, fill, partial, na_rm, order, by)

    roll.__name__ = name
    roll.__doc__ = f"Moving {name[4:]} over ``width`` rows."
    return roll


rollmean = _rolling("rollmean", F.avg)
rollsum = _rolling("rollsum", F.sum)
rollmin = _rolling("rollmin", F.min)
rollmax = _rolling("rollmax", F.max)
rollmedian = _rolling("rollmedian", lambda c: F.percentile(c, 0.5))
rollsd = _rolling("rollsd", F.stddev_samp)
rollvar = _rolling("rollvar", F.var_samp)


def rollapply(c, width: int, fun: Callable[[Column], Column], align: str = "right", fill=None, partial: bool = False, *, order, by: Names | None = None) -> Column:
    """``fun`` over the array of each window's values, NULL among them."""
    x, spec = as_column(c), window(by, order).rowsBetween(*_bounds(width, align))
    held = F.collect_list(F.struct(x.alias("v"))).over(spec)  # a list leaves out NULL, but not a row that holds it
    out = fun(F.transform(held, lambda one: one["v"]))
    return out if partial else F.when(F.count(F.lit(1)).over(spec) == width, out).otherwise(F.lit(fill))


def rollprod(c, width: int, align: str = "right", fill=None, partial: bool = False, na_rm: bool = False, *, order, by: Names | None = None) -> Column:
    """Moving product over ``width`` rows."""
    x, spec = as_column(c).cast("double"), window(by, order).rowsBetween(*_bounds(width, align))
    rows = F.count(F.lit(1)).over(spec)
    out = F.aggregate(F.collect_list(x).over(spec), F.lit(1.0), lambda a, b: a * b)
    if not na_rm:
        out = F.when(F.count(x).over(spec) == rows, out)
    return out if partial else F.when(rows == width, out).otherwise(F.lit(fill))
