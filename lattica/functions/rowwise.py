"""Functions across the columns of a row. Each takes a table and names and gives a Column of it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.core import Names, any_of, quoted, resolve_cols


def _columns(df: DataFrame, cols: Names | None) -> list[Column]:
    return [quoted(c) for c in resolve_cols(df, cols, allow_none=True)]


def _extreme(fun, df: DataFrame, cols: Names | None, na_rm: bool) -> Column:
    c = _columns(df, cols)
    value = fun(*c) if len(c) > 1 else c[0]
    return value if na_rm else F.when(~any_of(x.isNull() for x in c), value)


def rowmin(df: DataFrame, cols: Names | None = None, na_rm: bool = False) -> Column:
    """The least value; NULL if any is NULL, unless ``na_rm``."""
    return _extreme(F.least, df, cols, na_rm)


def rowmax(df: DataFrame, cols: Names | None = None, na_rm: bool = False) -> Column:
    return _extreme(F.greatest, df, cols, na_rm)


def rowany(df: DataFrame, cols: Names | None = None, na_rm: bool = False) -> Column:
    """Three-valued OR; with ``na_rm`` NULL is false."""
    return reduce(lambda a, b: a | b, (F.coalesce(c, F.lit(False)) if na_rm else c for c in _columns(df, cols)))


def rowall(df: DataFrame, cols: Names | None = None, na_rm: bool = False) -> Column:
    """Three-valued AND; with ``na_rm`` NULL is true."""
    return reduce(lambda a, b: a & b, (F.coalesce(c, F.lit(True)) if na_rm else c for c in _columns(df, cols)))


def rowcount(df: DataFrame, cols: Names | None = None, value=True, na_rm: bool = False) -> Column:
    """How many columns equal ``value``; NULL if any is NULL, unless ``na_rm``."""
    hits = [(c == F.lit(value)).cast("int") for c in _columns(df, cols)]
    return reduce(lambda a, b: a + b, (F.coalesce(h, F.lit(0)) if na_rm else h for h in hits))


def rowfirst(df: DataFrame, cols: Names | None = None, na_rm: bool = False) -> Column:
    """The first column, or the first value that isn't NULL."""
    c = _columns(df, cols)
    return F.coalesce(*c) if na_rm else c[0]


def rowlast(df: DataFrame, cols: Names | None = None, na_rm: bool = False) -> Column:
    c = _columns(df, cols)
    return F.coalesce(*c[::-1]) if na_rm else c[-1]
