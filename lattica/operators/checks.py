"""Assertions and comparisons. ``assert*`` give the table back or raise; each looks for one offending row at most."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.core import Names, any_of, is_missing, one_col, quoted, resolve_cols, true_only, with_row_id
from lattica.operators.groups import duplicated_keys


def _none(bad: DataFrame, message: str) -> None:
    if not bad.limit(1).isEmpty():
        raise AssertionError(message)


def assert_cols(df: DataFrame, cols: Names) -> DataFrame:
    resolve_cols(df, cols)
    return df


assertcols = assert_cols


def assertnames(df: DataFrame, names: Names) -> DataFrame:
    if set([names] if isinstance(names, str) else names) - set(df.columns):
        raise AssertionError("Missing required names.")
    return df


def assert_key(df: DataFrame, by: Names) -> DataFrame:
    _none(duplicated_keys(df, by), "`by` does not identify unique rows.")
    return df


assertkey = assert_key


def invalidrows(df: DataFrame, condition) -> DataFrame:
    """Rows for which the condition isn't true."""
    return df.filter(~true_only(condition))


def invalidvalues(df: DataFrame, column: str, allowed: Sequence) -> DataFrame:
    """Rows with a value that isn't allowed; NULL is."""
    c = quoted(one_col(df, column, "column"))
    return df.filter(c.isNotNull() & ~c.isin(list(allowed)))


def outofrange(df: DataFrame, column: str, lower, upper) -> DataFrame:
    """Rows with a value below ``lower`` or above ``upper``; NULL is in range."""
    c = quoted(one_col(df, column, "column"))
    return df.filter(c.isNotNull() & ~c.between(lower, upper))


def assertrows(df: DataFrame, condition) -> DataFrame:
    _none(invalidrows(df, condition), "Some rows failed the assertion.")
    return df


def assertvalues(df: DataFrame, column: str, allowed: Sequence) -> DataFrame:
    _none(invalidvalues(df, column, allowed), "Some values are not allowed.")
    return df


def assertrange(df: DataFrame, column: str, lower, upper) -> DataFrame:
    _none(outofrange(df, column, lower, upper), "Values out of range.")
    return df


def asserttype(df: DataFrame, column: str, kind: str) -> DataFrame:
    """``kind``: a Spark type's name, or a class as ``classes`` reports it."""
    from lattica.operators.eda import classes

    name = one_col(df, column, "column")
    own = {dict(df.dtypes)[name], {r["column"]: r["class"] for r in classes(df).collect()}[name]}
    if kind not in own:
        raise AssertionError("Unexpected type.")
    return df


def assertunique(df: DataFrame, cols: Names) -> DataFrame:
    _none(duplicated_keys(df, cols), "Values are not unique.")
    return df


def assertcomplete(df: DataFrame, cols: Names | None = None) -> DataFrame:
    """No NULL or NaN; blank text is fine."""
    _none(df.filter(any_of(is_missing(df, c) for c in resolve_cols(df, cols, allow_none=True))), "Missing values found.")
    return df


def lazily(df: DataFrame, condition, message: str) -> DataFrame:
    """The table with a check that fails only when it runs: the condition must be true in every row."""
    check: Column = F.when(true_only(condition), F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean"))
    return df.filter(check)


def sameschema(x: DataFrame, y: DataFrame) -> bool:
    """The same names in the same order."""
    return x.columns == y.columns


def equalrows(x: DataFrame, y: DataFrame, by: Names | None = None, order=None) -> bool:
    """The same rows as often, in any order if ``by`` is given, else in ``order``."""
    if set(x.columns) != set(y.columns) or (by is None and x.columns != y.columns):
        return False
    if by is not None:
        resolve_cols(y, resolve_cols(x, by))
        y = y.select(*map(quoted, x.columns))
        return x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty()
    return _different(x, y, order, 0.0).isEmpty() and x.count() == y.count()


def _different(x: DataFrame, y: DataFrame, order, tolerance: float) -> DataFrame:
    """Rows at the same place that differ."""
    numeric = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    a = with_row_id(x, order, "_row")
    b = with_row_id(y, order, "_row").withColumnsRenamed({c: f"_y_{c}" for c in y.columns})
    conditions = []
    for c, kind in x.dtypes:
        u, v = quoted(c), quoted(f"_y_{c}")
        near = (F.abs(u - v) <= tolerance * F.greatest(F.abs(u), F.lit(1.0))) if kind in numeric and tolerance else F.lit(False)
        conditions.append(~(u.eqNullSafe(v) | F.coalesce(near, F.lit(False))))
    return a.join(b, "_row").filter(any_of(conditions))


def equaldata(x: DataFrame, y: DataFrame, ignoreorder: bool = False, tolerance: float = 1.5e-8, order=None) -> bool:
    """The same names, types and rows, numbers within a relative tolerance; ``ignoreorder`` compares in the order of all columns."""
    if x.dtypes != y.dtypes or x.count() != y.count():
        return False
    if ignoreorder:
        order = x.columns
    return _different(x, y, order, tolerance).isEmpty()
