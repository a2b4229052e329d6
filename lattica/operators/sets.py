"""Set operations and row binding."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.core import Names, all_of, any_of, as_table, quoted, resolve_cols
from lattica.operators.joins import antimerge, common_names, matchedkeys, unmatchedkeys
from lattica.operators.rows import firstby


def rbindfill(*tables, id: str | None = None, fill: bool = True, typeconflict: str = "error") -> DataFrame:
    """Tables stacked by name, missing columns NULL; ``id`` adds the name or number of each row's table.

    Columns of different types are an error, or become text with ``typeconflict="coerce"``.
    """
    if typeconflict not in ("error", "coerce"):
        raise ValueError("typeconflict must be error or coerce.")
    if len(tables) == 1 and isinstance(tables[0], (Mapping, list, tuple)):
        tables = tables[0]
    labelled = list(tables.items()) if isinstance(tables, Mapping) else [(str(i), t) for i, t in enumerate(tables, 1)]
    if not labelled:
        raise ValueError("no tables to bind.")
    kinds: dict[str, set[str]] = {}
    for _, t in labelled:
        for name, kind in as_table(t).dtypes:
            kinds.setdefault(name, set()).add(kind)
    mixed = [n for n, k in kinds.items() if len(k) > 1]
    numeric = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    clash = [n for n in mixed if not kinds[n] <= numeric]
    if clash and typeconflict == "error":
        raise TypeError(f"Columns of different types: {', '.join(clash)}")

    def ready(label: str, t: DataFrame) -> DataFrame:
        t = t.withColumns({c: quoted(c).cast("string") for c in clash if c in t.columns})
        return t.select(F.lit(label).alias(id), *map(quoted, t.columns)) if id else t

    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=fill), (ready(n, t) for n, t in labelled))


def bind_rows(*tables, id: str | None = None) -> DataFrame:
    return rbindfill(*tables, id=id)


def unionrows(x: DataFrame, y: DataFrame, by: Names | None = None, order=None) -> DataFrame:
    """Distinct rows of both tables; with ``by`` the first row of each key, x before y."""
    if by is None:
        return bind_rows(x, y).distinct()
    both = bind_rows(x.withColumn("_side", F.lit(0)), y.withColumn("_side", F.lit(1)))
    return firstby(both, by, ["_side", *([order] if isinstance(order, str) else order or [c for c in both.columns if c != "_side"])]).drop("_side")


def intersectrows(x: DataFrame, y: DataFrame, by: Names | None = None) -> DataFrame:
    """Distinct rows of x that are in y; with ``by`` all rows of x whose key is in y."""
    return x.intersect(y.select(*map(quoted, x.columns))) if by is None else matchedkeys(x, y, by)


def diffrows(x: DataFrame, y: DataFrame, by: Names | None = None, order=None) -> DataFrame:
    """Distinct rows of x that aren't in y; with ``by`` the first row of each key that isn't."""
    return x.subtract(y.select(*map(quoted, x.columns))) if by is None else unmatchedkeys(x, y, by, order if order is not None else x.columns)


def addedrows(old: DataFrame, new: DataFrame, by: Names | None = None) -> DataFrame:
    """Rows of ``new`` that ``old`` lacks, by key or as a whole."""
    return new.subtract(old.select(*map(quoted, new.columns))) if by is None else antimerge(new, old, by)


def removedrows(old: DataFrame, new: DataFrame, by: Names | None = None) -> DataFrame:
    return addedrows(new, old, by)


def changedrows(old: DataFrame, new: DataFrame, by: Names | None = None) -> DataFrame:
    """Keys in both tables where a shared column differs (NULL equals NULL), with .old and .new columns.

    Without ``by`` whole rows are compared as sets, as in ``addedrows``.
    """
    if by is None:
        return addedrows(old, new)
    keys = resolve_cols(new, resolve_cols(old, by))
    shared = [c for c in common_names(old, new) if c not in keys]
    a = old.withColumnsRenamed({c: f"{c}.old" for c in shared})
    b = new.withColumnsRenamed({c: f"{c}.new" for c in shared} | {k: f"_n_{k}" for k in keys})
    joined = a.join(b, all_of(quoted(k).eqNullSafe(quoted(f"_n_{k}")) for k in keys), "inner")
    differs = any_of(~quoted(f"{c}.old").eqNullSafe(quoted(f"{c}.new")) for c in shared)
    rest = [c for c in a.columns if c not in keys] + [c for c in b.columns if not c.startswith("_n_")]
    return joined.filter(differs).select(*map(quoted, keys), *map(quoted, rest))
