"""Row selection, sorting, limits, sampling, duplicates, fills and row generation.

Operators that depend on row order take ``order``: column names (ascending, NULL last) or sort Columns.
"""

from __future__ import annotations

import math
import random
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.core import Names, all_of, any_of, as_table, batch_only, is_blank, order_columns, quoted, resolve_cols, reversed_order, unused, window, with_row_id


def reorder(df: DataFrame, by: Names, decreasing: bool | Sequence[bool] = False, na_last: bool | None = True) -> DataFrame:
    """Sorts by several keys in byte order, NULL last in both directions (False: first; None: rows with NULL keys go)."""
    keys = resolve_cols(df, by)
    down = [decreasing] * len(keys) if isinstance(decreasing, bool) else list(decreasing)
    if len(down) == 1:
        down *= len(keys)
    if len(down) != len(keys):
        raise ValueError(f"`decreasing` must have length 1 or {len(keys)}.")
    if na_last is None:
        df = df.filter(all_of(quoted(k).isNotNull() for k in keys))
    suffix = "nulls_first" if na_last is False else "nulls_last"
    return df.orderBy(*(getattr(quoted(k), f"{'desc' if d else 'asc'}_{suffix}")() for k, d in zip(keys, down, strict=True)))


arrange = orderrows = reorder


def slice(df: DataFrame, rows: Sequence[int], order) -> DataFrame:
    """Rows by place (from 1): repeats repeat, negative places exclude, places beyond the end give rows of NULL."""
    if any(r < 0 for r in rows) and any(r > 0 for r in rows):
        raise ValueError("places must be all positive or all negative.")
    numbered = with_row_id(df, order, "_row")
    if any(r < 0 for r in rows):
        return numbered.filter(~F.col("_row").isin([-r for r in rows])).orderBy("_row").drop("_row")
    wanted = df.sparkSession.createDataFrame([(i, r) for i, r in enumerate(rows) if r], "_at long, _row long")
    return F.broadcast(wanted).join(numbered.filter(F.col("_row").isin([r for r in rows])), "_row", "left").orderBy("_at").select(*map(quoted, df.columns))


def firstrows(df: DataFrame, n: int = 1, *, order) -> DataFrame:
    return batch_only(df, "firstrows").orderBy(*order_columns(order)).limit(n)


def lastrows(df: DataFrame, n: int = 1, *, order) -> DataFrame:
    return batch_only(df, "lastrows").orderBy(*reversed_order(order)).limit(n).orderBy(*order_columns(order))


def headtail(df: DataFrame, n: int = 3, *, order) -> DataFrame:
    """The first and last n rows; the whole table if it has no more than 2n."""
    if df.limit(2 * n + 1).count() <= 2 * n:
        return df.orderBy(*order_columns(order))
    return firstrows(df, n, order=order).unionByName(lastrows(df, n, order=order)).orderBy(*order_columns(order))


def reverse(df: DataFrame, order) -> DataFrame:
    return batch_only(df, "reverse").orderBy(*reversed_order(order))


def _drawn(df: DataFrame, n: int, total: int, seed: int | None) -> DataFrame:
    """n of the ``total`` rows: those with the smallest random numbers.

    Nearly all of them are below a bound that is known beforehand; only the rows between it and a second bound, some
    eight standard deviations of their number, are sorted.
    """
    if n >= total:
        return df
    draw = unused("_draw", df.columns)
    marked = df.withColumn(draw, F.rand(random.getrandbits(31) if seed is None else seed))
    spread = 4 * math.sqrt(n * (1 - n / total)) + 10
    while True:
        low, high = max(0.0, (n - spread) / total), min(1.0, (n + spread) / total)
        sure, middle = marked.agg(F.count_if(F.col(draw) < low), F.count_if((F.col(draw) >= low) & (F.col(draw) <= high))).first()
        if sure <= n <= sure + middle:
            break
        spread *= 4
    rest = marked.filter((F.col(draw) >= low) & (F.col(draw) <= high)).orderBy(draw).limit(n - sure)
    return marked.filter(F.col(draw) < low).unionByName(rest).drop(draw)


def samplerows(df: DataFrame, n: int, seed: int | None = None) -> DataFrame:
    """n rows without replacement."""
    total = df.count()
    if n > total:
        raise ValueError("cannot take a sample larger than the table.")
    return _drawn(df, n, total, seed)


def samplefrac(df: DataFrame, frac: float, seed: int | None = None) -> DataFrame:
    """A share of the rows, rounded up, without replacement."""
    total = df.count()
    return _drawn(df, -int(-(total * frac) // 1), total, seed)


def _numbered(df: DataFrame, by: Names, order, last: bool = False) -> DataFrame:
    keys = [quoted(k) for k in resolve_cols(df, by)]
    spec = Window.partitionBy(*keys).orderBy(*(reversed_order(order) if last else order_columns(order)))
    return batch_only(df, "this operator").withColumn("_n", F.row_number().over(spec)).filter("_n = 1").drop("_n")


def firstby(df: DataFrame, by: Names, order) -> DataFrame:
    """The first whole row of each key."""
    return _numbered(df, by, order)


def lastby(df: DataFrame, by: Names, order) -> DataFrame:
    """The last whole row of each key."""
    return _numbered(df, by, order, last=True)


def distinct(df: DataFrame, cols: Names | None = None, keep_all: bool = False, order=None) -> DataFrame:
    """Distinct rows, distinct keys, or the first whole row of each key."""
    if cols is None:
        return as_table(df).distinct()
    keys = resolve_cols(df, cols)
    return firstby(df, keys, order) if keep_all else df.select(*map(quoted, keys)).distinct()


def removeduplicates(df: DataFrame, by: Names | None = None, keep: str = "first", order=None) -> DataFrame:
    """Keeps the first or last row of each key, or (none) the rows whose key occurs once. Without ``by`` the key is the whole row."""
    if keep not in ("first", "last", "none"):
        raise ValueError("keep must be first, last or none.")
    keys = resolve_cols(df, by, allow_none=True)
    if keep == "none":
        once = df.groupBy(*map(quoted, keys)).agg(F.count(F.lit(1)).alias("_n")).filter("_n = 1")
        if by is None:
            return once.select(*map(quoted, df.columns))
        return df.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*map(quoted, keys)))).filter("_n = 1").drop("_n")
    if by is None:
        return as_table(df).distinct()
    return (firstby if keep == "first" else lastby)(df, keys, order)


def duplicaterows(df: DataFrame) -> DataFrame:
    """All copies of rows that occur more than once, regenerated from counts so that no copies meet in one task."""
    many = as_table(df).groupBy(*map(quoted, df.columns)).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return many.select(*map(quoted, df.columns), F.explode(F.sequence(F.lit(1), "_n")).alias("_i")).drop("_i")


def _blank_rows(df: DataFrame, cols: Names | None, mode: str):
    if mode not in ("any", "all"):
        raise ValueError("mode must be any or all.")
    found = resolve_cols(df, cols, allow_none=True)
    return found, (any_of if mode == "any" else all_of)(is_blank(df, c) for c in found)


def emptyrows(df: DataFrame) -> DataFrame:
    """Rows with blanks only."""
    return df.filter(all_of(is_blank(df, c) for c in as_table(df).columns))


def missingrows(df: DataFrame, cols: Names | None = None, mode: str = "any") -> DataFrame:
    """Rows with any or all of ``cols`` blank."""
    found, blank = _blank_rows(df, cols, mode)
    return df.filter(blank if found else F.lit(False))


keepmissing = missingrows


def omitmissing(df: DataFrame, cols: Names | None = None, mode: str = "any") -> DataFrame:
    """The rows that ``missingrows`` leaves."""
    found, blank = _blank_rows(df, cols, mode)
    return df.filter(~blank) if found else df


def expandrows(df: DataFrame, times) -> DataFrame:
    """Each row as often as ``times`` (a whole number or a column's name) says; 0 drops it, a NULL, negative or fractional number is an error."""
    if isinstance(times, str):
        t = quoted(resolve_cols(df, times)[0])
    else:
        if times is None or times < 0 or times != int(times):
            raise ValueError("`times` must be non-negative whole numbers.")
        t = F.lit(int(times))
    bad = t.isNull() | (t < 0) | (t != F.floor(t))
    checked = F.when(bad, F.raise_error(F.lit("`times` must be non-negative whole numbers.")).cast("long")).otherwise(t.cast("long"))
    return df.withColumn("_i", F.explode(F.when(checked > 0, F.sequence(F.lit(1).cast("long"), checked)))).drop("_i")


def completegrid(df: DataFrame, cols: Names, fill: Mapping | None = None) -> DataFrame:
    """All combinations of the distinct values of ``cols`` (NULL is one), with the rows that exist; ``fill`` replaces every NULL of its columns."""
    keys = resolve_cols(df, cols)
    grid = None
    for k in keys:
        values = df.select(quoted(k)).distinct()
        grid = values if grid is None else grid.crossJoin(values)
    right = df.withColumnsRenamed({k: f"_{k}" for k in keys})
    joined = grid.join(right, all_of(quoted(k).eqNullSafe(quoted(f"_{k}")) for k in keys), "left")
    filled = {c: F.coalesce(quoted(c), F.lit(v)) for c, v in (fill or {}).items()}
    return joined.select(*(filled.get(c, quoted(c)).alias(c) for c in df.columns))


def _filled(df: DataFrame, cols: Names, by: Names | None, order, down: bool, up: bool) -> DataFrame:
    spec = window(by, order)
    batch_only(df, "a fill")
    before, after = spec.rowsBetween(Window.unboundedPreceding, 0), spec.rowsBetween(0, Window.unboundedFollowing)

    def value(c: str):
        parts = [F.last(quoted(c), ignorenulls=True).over(before)] * down + [F.first(quoted(c), ignorenulls=True).over(after)] * up
        return F.coalesce(*parts)

    return df.withColumns({c: value(c) for c in resolve_cols(df, cols)})


def filldown(df: DataFrame, cols: Names, by: Names | None = None, *, order) -> DataFrame:
    """The last value so far where a value is NULL, within ``by``."""
    return _filled(df, cols, by, order, True, False)


def fillup(df: DataFrame, cols: Names, by: Names | None = None, *, order) -> DataFrame:
    return _filled(df, cols, by, order, False, True)


def fillboth(df: DataFrame, cols: Names, by: Names | None = None, *, order) -> DataFrame:
    """Down, then up."""
    return _filled(df, cols, by, order, True, True)

