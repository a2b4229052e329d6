"""Projection, filters and column management."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.core import Names, all_of, as_expr, as_table, batch_only, clean_names, is_blank, one_col, quoted, resolve_cols, true_only, with_row_id


def subset(df: DataFrame, condition=None, select: Names | None = None, drop: bool = False) -> DataFrame | Column:
    """Rows for which ``condition`` (SQL text or Column) is true, and the columns in ``select``.

    With ``drop`` and one selected column the result is that Column of the filtered table.
    """
    out = as_table(df) if condition is None else df.filter(as_expr(condition))
    if select is None:
        return out
    cols = resolve_cols(df, select)
    out = out.select(*map(quoted, cols))
    return out[cols[0]] if drop and len(cols) == 1 else out


def filter(df: DataFrame, *conditions) -> DataFrame:
    """Rows for which all conditions are true; NULL counts as false."""
    return as_table(df).filter(all_of(map(as_expr, conditions))) if conditions else as_table(df)


def pick(df: DataFrame, cols: Names) -> DataFrame:
    return df.select(*map(quoted, resolve_cols(df, cols)))


select = pick


def drop(df: DataFrame, cols: Names) -> DataFrame:
    """All columns but ``cols``, which must exist."""
    gone = set(resolve_cols(df, cols))
    return df.select(*(quoted(c) for c in df.columns if c not in gone))


def transform(df: DataFrame, *, keep: bool = True, **exprs) -> DataFrame:
    """Adds or replaces columns one after another, so that an expression sees those before it; None deletes a column."""
    out, made = as_table(df), []
    for name, e in exprs.items():
        if e is None:
            out = out.select(*(quoted(c) for c in out.columns if c != name))
            made = [m for m in made if m != name]
        else:
            out = out.withColumn(name, as_expr(e))
            made.append(name)
    return out if keep else out.select(*map(quoted, dict.fromkeys(made)))


mutate = transform


def transmute(df: DataFrame, **exprs) -> DataFrame:
    """Only the columns that are created."""
    return transform(df, keep=False, **exprs)


class _Block(dict):
    """Columns by name; assignments shadow them."""

    def __getattr__(self, name: str) -> Column:
        try:
            return self[name]
        except KeyError:
            raise AttributeError(name) from None

    def __setattr__(self, name: str, value) -> None:
        self[name] = value

    def __delattr__(self, name: str) -> None:
        self[name] = None


def within(df: DataFrame, block: Callable[[_Block], None]) -> DataFrame:
    """Runs ``block`` on a namespace of the columns; what it sets is added or replaced, what it deletes or sets to None goes."""
    space = _Block({c: quoted(c) for c in as_table(df).columns})
    block(space)
    return df.select(*(as_expr(v).alias(n) for n, v in space.items() if v is not None))


def rename(df: DataFrame, **new_from_old: str) -> DataFrame:
    """``new="old"`` pairs."""
    resolve_cols(df, list(new_from_old.values()))
    return df.withColumnsRenamed({old: new for new, old in new_from_old.items()})


def renamewith(df: DataFrame, cols: Names, fun: Callable[[str], str]) -> DataFrame:
    return df.withColumnsRenamed({c: fun(c) for c in resolve_cols(df, cols)})


def move(df: DataFrame, cols: Names, before: str | int | None = None, after: str | int | None = None) -> DataFrame:
    """Columns before or after an anchor, by default in front; a number is a place (from 1) among the other columns."""
    moved = resolve_cols(df, cols)
    rest = [c for c in df.columns if c not in moved]
    if before is not None and after is not None:
        raise ValueError("Use only one of `before` or `after`.")
    at = 0
    for anchor, what, shift in ((before, "before", -1), (after, "after", 0)):
        if anchor is not None:
            at = anchor + shift if isinstance(anchor, int) else rest.index(one_col(df, anchor, what)) + 1 + shift
    return df.select(*map(quoted, rest[:at] + moved + rest[at:]))


def relocate(df: DataFrame, cols: Names, before: str | None = None, after: str | None = None) -> DataFrame:
    return move(df, cols, before, after)


def firstcols(df: DataFrame, cols: Names) -> DataFrame:
    return move(df, cols)


def lastcols(df: DataFrame, cols: Names) -> DataFrame:
    return move(df, cols, after=len(df.columns) - len(resolve_cols(df, cols)))


def cleannames(df: DataFrame) -> DataFrame:
    return repairnames(df)


def repairnames(df: DataFrame, method: str = "unique") -> DataFrame:
    return as_table(df).toDF(*clean_names(df.columns, method))


def applycols(df: DataFrame, cols: Names, fun: Callable[[Column], Column]) -> DataFrame:
    """``fun`` (Column to Column; wrap code on values in a pandas_udf) over each of ``cols``."""
    return df.withColumns({c: fun(quoted(c)) for c in resolve_cols(df, cols)})


def convertcols(df: DataFrame, cols: Names, to: str | Callable[[Column], Column]) -> DataFrame:
    """Converts columns by a function, or to a SQL type with NULL where that fails."""
    return applycols(df, cols, to if callable(to) else lambda c: c.try_cast(to))


def replacecols(df: DataFrame, cols: Names, values: Sequence) -> DataFrame:
    """Replaces columns by the values (Columns or literals) at the same places."""
    found = resolve_cols(df, cols)
    if len(values) != len(found):
        raise ValueError("`values` must match `cols`.")
    return df.withColumns({c: v if isinstance(v, Column) else F.lit(v) for c, v in zip(found, values, strict=True)})


def replacewhere(df: DataFrame, condition, cols: Names, value) -> DataFrame:
    """``value`` in ``cols`` where the condition is true."""
    new = value if isinstance(value, Column) else F.lit(value)
    return df.withColumns({c: F.when(true_only(condition), new).otherwise(quoted(c)) for c in resolve_cols(df, cols)})


def unite(df: DataFrame, column: str, cols: Names, sep: str = "_", remove: bool = True, na_rm: bool = False) -> DataFrame:
    """Columns as one text at the end; a NULL is written NA, or left out with ``na_rm``."""
    found = resolve_cols(df, cols)
    parts = [quoted(c).cast("string") for c in found]
    text = F.concat_ws(sep, *(parts if na_rm else [F.coalesce(p, F.lit("NA")) for p in parts]))
    kept = [c for c in df.columns if not (remove and c in found) and c != column]
    return df.select(*map(quoted, kept), text.alias(column))


def separate(df: DataFrame, column: str, into: Sequence[str], sep: str, remove: bool = True, extra: str = "warn", fill: str = "warn") -> DataFrame:
    """Splits a text by a regular expression into columns at the end.

    Pieces beyond the last go (``extra="merge"``: stay with the last one); short rows get NULL at the right
    (``fill="left"``: at the left).
    """
    if extra not in ("warn", "drop", "merge") or fill not in ("warn", "left", "right"):
        raise ValueError("extra must be warn, drop or merge; fill must be warn, left or right.")
    name, n = one_col(df, column, "column"), len(into)
    pieces = F.split(quoted(name).cast("string"), sep, n if extra == "merge" else -1)
    shift = F.greatest(F.lit(n) - F.size(pieces), F.lit(0)) if fill == "left" else F.lit(0)
    parts = [F.when(F.lit(i) >= shift, F.get(pieces, F.lit(i) - shift)).alias(c) for i, c in enumerate(into)]
    return df.select(*(quoted(c) for c in df.columns if not (remove and c == name) and c not in into), *parts)


def bind_cols(*tables: DataFrame, order: Sequence) -> DataFrame:
    """Columns side by side, matched by row number in each table's entry of ``order``; row counts must agree."""
    if not tables:
        raise ValueError("an empty table has no Spark form: pass at least one table.")
    numbered = [with_row_id(batch_only(t, "bind_cols"), o, "_row") for t, o in zip(tables, order, strict=True)]
    if len({t.count() for t in tables}) > 1:
        raise ValueError("All inputs must have the same number of rows.")
    out = numbered[0]
    for t in numbered[1:]:
        out = out.join(t, "_row")
    return out.drop("_row")


def missingindicator(df: DataFrame, cols: Names | None = None, prefix: str = "missing_") -> DataFrame:
    """Adds a boolean for each column: is it blank?"""
    found = resolve_cols(df, cols, allow_none=True)
    if clash := [prefix + c for c in found if prefix + c in df.columns]:
        raise ValueError(f"Columns already exist: {', '.join(clash)}")
    return df.withColumns({prefix + c: is_blank(df, c) for c in found})

