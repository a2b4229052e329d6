"""Aggregation. Unless ``na_rm`` is set, a NULL in a group makes its aggregate NULL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.core import Names, as_expr, as_table, quoted, resolve_cols, unused

AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "mean": F.avg,
    "sum": F.sum,
    "min": F.min,
    "max": F.max,
    "median": F.median,
    "sd": F.stddev_samp,
    "var": F.var_samp,
    "prod": F.product,
    "length": lambda c: F.count(F.lit(1)),
    "first": F.first,
    "last": F.last,
    "n_distinct": lambda c: F.count_distinct(c) + F.max(c.isNull().cast("int")),
}
#: What is left of an aggregate of nothing.
EMPTY = {"sum": 0, "prod": 1, "length": 0}


def poisoned(c: Column, value: Column) -> Column:
    """``value``, or NULL where ``c`` has a NULL."""
    return F.when(F.count(c) == F.count(F.lit(1)), value)


def aggregated(c: Column, fun: str | Callable[[Column], Column], na_rm: bool = False) -> Column:
    """An aggregate of ``c`` by a name of ``AGGREGATES``, a function of Columns, or a grouped-aggregate pandas_udf."""
    if isinstance(fun, str):
        if fun not in AGGREGATES:
            raise ValueError(f"fun must be one of {', '.join(AGGREGATES)}, or a function.")
        value = AGGREGATES[fun](c)
        if fun in ("length", "n_distinct"):
            return value
        return F.coalesce(value, F.lit(EMPTY[fun])) if na_rm and fun in EMPTY else value if na_rm else poisoned(c, value)
    return fun(c) if na_rm else poisoned(c, fun(c))


def aggregate(df: DataFrame, by: Names, value: Names | None = None, fun: str | Callable = "mean", na_rm: bool = False, sort: bool = True) -> DataFrame:
    """One function over each of ``value`` (by default all other columns) for each key; sorted by key, NULL first."""
    keys = resolve_cols(df, by)
    values = [c for c in df.columns if c not in keys] if value is None else resolve_cols(df, value)
    out = df.groupBy(*map(quoted, keys)).agg(*(aggregated(quoted(c), fun, na_rm).alias(c) for c in values))
    return out.orderBy(*map(quoted, keys)) if sort else out


def count(df: DataFrame, by: Names, sort: bool = True, name: str = "n") -> DataFrame:
    """Rows of each key, the most frequent first, ties by key."""
    keys = resolve_cols(df, by)
    out = df.groupBy(*map(quoted, keys)).agg(F.count(F.lit(1)).alias(name))
    return out.orderBy(F.desc(name), *map(quoted, keys)) if sort else out


def summarise(df: DataFrame, by: Names | None = None, **exprs) -> DataFrame:
    """Named aggregates (SQL text or Columns) for each key, or over the whole table."""
    found = [as_expr(e).alias(n) for n, e in exprs.items()]
    if by is None:
        return as_table(df).agg(*found)
    keys = resolve_cols(df, by)
    return df.groupBy(*map(quoted, keys)).agg(*found).orderBy(*map(quoted, keys))


summarize = summaries = summarise


def propcount(df: DataFrame, by: Names, margin: Names | None = None) -> DataFrame:
    """Counts of keys and their share of all rows, or of the rows with the same ``margin`` columns."""
    keys = resolve_cols(df, by)
    within = [quoted(m) for m in resolve_cols(df, margin)] if margin is not None else []
    counts = df.groupBy(*map(quoted, keys)).agg(F.count(F.lit(1)).alias("n"))
    if within:
        return counts.withColumn("prop", F.col("n") / F.sum("n").over(Window.partitionBy(*within)))
    total = unused("_total", counts.columns)
    one = df.agg(F.count(F.lit(1)).alias(total))  # one row
    return counts.crossJoin(F.broadcast(one)).withColumn("prop", F.col("n") / quoted(total)).drop(total)


def freq(df: DataFrame, column: str, by: Names | None = None, prop: bool = False, sort: bool = True) -> DataFrame:
    """Counts of one column's values, within ``by`` if given, with their share if asked for."""
    groups = resolve_cols(df, by) if by is not None else []
    out = propcount(df, [*groups, *resolve_cols(df, column)], groups or None)
    out = out if prop else out.drop("prop")
    return out.orderBy(*map(quoted, groups), F.desc("n"), quoted(column)) if sort else out


def duplicated_keys(df: DataFrame, by: Names) -> DataFrame:
    """Keys that occur more than once, with N."""
    return df.groupBy(*map(quoted, resolve_cols(df, by))).agg(F.count(F.lit(1)).alias("N")).filter("N > 1")


duplicatekeys = duplicated_keys


def split(df: DataFrame, by: Names, keep_by: bool = False, max_keys: int = 1000) -> dict[str, DataFrame]:
    """A lazy table for each key, under its dot-joined values in order. More than ``max_keys`` keys are an error: group instead."""
    keys = resolve_cols(df, by)
    found = df.select(*map(quoted, keys)).distinct().limit(max_keys + 1).collect()
    if len(found) > max_keys:
        raise ValueError(f"more than {max_keys} keys.")
    out = {}
    for row in sorted(found, key=lambda r: [(v is not None, v) for v in r]):
        part = df.filter(_key_is(keys, row))
        out[".".join("NA" if v is None else str(v) for v in row)] = part if keep_by else part.drop(*keys)
    return out


def _key_is(keys: list[str], row) -> Column:
    cond = F.lit(True)
    for k, v in zip(keys, row, strict=True):
        cond = cond & quoted(k).eqNullSafe(F.lit(v))
    return cond


def applyby(df: DataFrame, by: Names, fun: Callable, schema: str | None = None, bind: bool = False, id: str = ".group"):
    """``fun`` over each key's rows: a dict of results, or with ``bind`` one table with the key's label in ``id``.

    Bound results come from ``applyInPandas``: ``fun`` takes and gives a pandas frame of ``schema`` without ``id``.
    """
    keys = resolve_cols(df, by)
    if not bind:
        return {k: fun(part) for k, part in split(df, keys, keep_by=False).items()}
    if schema is None:
        raise ValueError("binding needs the schema that `fun` returns.")

    def run(key, frame):
        out = fun(frame.drop(columns=keys))
        out.insert(0, id, ".".join("NA" if v is None else str(v) for v in key))
        return out

    return df.groupBy(*map(quoted, keys)).applyInPandas(run, f"`{id}` string, {schema}")
