"""Long and wide forms."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.core import Names, batch_only, dealt_by, one_col, order_columns, quoted, resolve_cols
from lattica.operators.groups import aggregated


def _one_type(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``cols`` in one type: double for different numbers, text for anything else that differs."""
    kinds = {dict(df.dtypes)[c] for c in cols}
    if len(kinds) == 1:
        return df
    numeric = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    to = "double" if kinds <= numeric else "string"
    return df.withColumns({c: quoted(c).cast(to) for c in cols})


def tolong(df: DataFrame, cols: Names, names: str = "variable", values: str = "value", idcols: Names | None = None, na_rm: bool = False) -> DataFrame:
    """A row for each of ``cols``; the other columns (or ``idcols``) are repeated."""
    found = resolve_cols(df, cols)
    ids = [c for c in df.columns if c not in found] if idcols is None else resolve_cols(df, idcols)
    out = _one_type(df, found).unpivot([quoted(c) for c in ids], [quoted(c) for c in found], names, values)
    return out.filter(quoted(values).isNotNull()) if na_rm else out


def towide(df: DataFrame, names: str, values: str, idcols: Names | None = None, fun: str | Callable | None = None, fill=None, levels: Sequence | None = None) -> DataFrame:
    """A column for each value of ``names``; cells are counts unless ``fun`` is given, and ``fill`` where there are no rows.

    ``levels`` names the columns in advance, which saves a job that looks for them (and counts the rows, as many are
    dealt out by ``idcols`` first: no task then aggregates more than its share).
    """
    name, value = one_col(df, names, "names"), one_col(df, values, "values")
    ids = [c for c in df.columns if c not in (name, value)] if idcols is None else resolve_cols(df, idcols)
    cell = F.count(F.lit(1)) if fun is None else aggregated(quoted(value), fun, True)
    present = "\x00present"
    if levels is None:
        found = df.groupBy(quoted(name)).agg(F.count(F.lit(1)).alias(present)).orderBy(quoted(name)).limit(10_001).collect()
        levels = [r[0] for r in found]
        if len(levels) > 10_000:
            raise ValueError("more than 10,000 columns.")
        df = dealt_by(df, ids, sum(r[1] for r in found)) if ids else df
    wide = df.groupBy(*map(quoted, ids)).pivot(name, list(levels)).agg(cell.alias("v"), F.count(F.lit(1)).alias(present))
    label = lambda v: "null" if v is None else str(v)
    cells = [F.when(quoted(f"{label(v)}_{present}").isNotNull(), quoted(f"{label(v)}_v")).otherwise(F.lit(fill)).alias("NA" if v is None else str(v)) for v in levels]
    return wide.select(*map(quoted, ids), *cells).orderBy(*map(quoted, ids))


def reshape(df: DataFrame, direction: str, *, idvar: Names, timevar: str, v_names: str, varying: Names | None = None, times: Sequence | None = None) -> DataFrame:
    """``long``: the columns ``varying`` become rows of ``v_names`` with their place (or ``times``) in ``timevar``; ``wide``: back, one column v.time for each."""
    ids = resolve_cols(df, idvar)
    if direction == "long":
        cols = resolve_cols(df, varying)
        stamps = list(times) if times is not None else list(range(1, len(cols) + 1))
        long = tolong(df, cols, "\x00name", v_names, [c for c in df.columns if c not in cols])
        at = F.coalesce(*(F.when(quoted("\x00name") == c, F.lit(t)) for c, t in zip(cols, stamps, strict=True)))
        return long.withColumn(timevar, at).select(*(quoted(c) for c in df.columns if c not in cols), timevar, v_names)
    if direction != "wide":
        raise ValueError("direction must be long or wide.")
    wide = towide(df, timevar, v_names, ids, "first")
    return wide.select(*map(quoted, ids), *(quoted(c).alias(f"{v_names}.{c}") for c in wide.columns if c not in ids))


def stack(df: DataFrame, select: Names | None = None) -> DataFrame:
    """``values`` and ``ind`` (the column they come from)."""
    return tolong(df, resolve_cols(df, select, allow_none=True), "ind", "values", []).select("values", "ind")


def unstack(df: DataFrame, values: str, ind: str, *, order, levels: Sequence | None = None) -> DataFrame:
    """One column for each level of ``ind``, its values in row order."""
    spec = Window.partitionBy(quoted(ind)).orderBy(*order_columns(order))
    placed = batch_only(df, "unstack").select(quoted(ind).alias("ind"), quoted(values).alias("values"), F.row_number().over(spec).alias("_row"))
    return towide(placed, "ind", "values", "_row", "first", levels=levels).orderBy("_row").drop("_row")


def transpose(df: DataFrame, max_rows: int = 1000, *, order) -> DataFrame:
    """Rows as columns V1, V2, ...; mixed types become text. More than ``max_rows`` rows are an error: a table has to have few columns."""
    rows = df.orderBy(*order_columns(order)).limit(max_rows + 1)
    n = rows.count()
    if n > max_rows:
        raise ValueError(f"more than {max_rows} rows.")
    spec = Window.orderBy(*order_columns(order))
    long = tolong(rows.withColumn("_row", F.row_number().over(spec)), df.columns, "_col", "_value", "_row")
    wide = towide(long, "_row", "_value", "_col", "first", levels=list(range(1, n + 1)))
    place = F.array_position(F.array(*map(F.lit, df.columns)), F.col("_col"))
    return wide.orderBy(place).select(*(quoted(str(i)).alias(f"V{i}") for i in range(1, n + 1)))


def rowapply(df: DataFrame, fun: Callable[[Column], Column], cols: Names | None = None) -> Column:
    """``fun`` (array Column to Column, or a pandas_udf) over each row's values as an array of one type."""
    found = resolve_cols(df, cols, allow_none=True)
    kinds = {dict(df.dtypes)[c] for c in found}
    numeric = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    to = next(iter(kinds)) if len(kinds) == 1 else "double" if kinds <= numeric else "string"
    return fun(F.array(*(quoted(c).cast(to) for c in found)))
