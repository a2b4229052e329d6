"""Rules that all verbs share: column checks, missing values, row order, null-safe keys."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

Names = str | Sequence[str]


def as_table(data: DataFrame) -> DataFrame:
    """``data`` itself; a DataFrame is lazy and immutable, so nothing is copied. Anything else is a TypeError."""
    if not isinstance(data, DataFrame):
        raise TypeError("`data` must be a DataFrame.")
    return data


def names_of(cols: Names) -> list[str]:
    return [cols] if isinstance(cols, str) else list(cols)


def resolve_cols(df: DataFrame, cols: Names | None, allow_none: bool = False) -> list[str]:
    """The column names in ``cols``, checked against the schema without a job; None means all where it is allowed."""
    as_table(df)
    if cols is None:
        if allow_none:
            return df.columns
        raise ValueError("`cols` must not be NULL.")
    found = names_of(cols)
    if not all(isinstance(c, str) for c in found):
        raise TypeError("Column specification must be a character vector.")
    if unknown := [c for c in dict.fromkeys(found) if c not in df.columns]:
        raise ValueError(f"Unknown columns: {', '.join(unknown)}")
    return found


def one_col(df: DataFrame, name: str, what: str) -> str:
    found = resolve_cols(df, name)
    if len(found) != 1:
        raise ValueError(f"`{what}` must identify one column.")
    return found[0]


def quoted(name: str) -> Column:
    """A column by its literal name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def as_column(x) -> Column:
    """Columns stay, strings name columns, other values are literals."""
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def as_expr(x) -> Column:
    """Columns stay, strings are SQL expressions, other values are literals."""
    return x if isinstance(x, Column) else F.expr(x) if isinstance(x, str) else F.lit(x)


def true_only(condition) -> Column:
    """A predicate in which NULL counts as false."""
    return F.coalesce(as_expr(condition), F.lit(False))


def is_float(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType))


def is_missing(df: DataFrame, name: str) -> Column:
    """NULL or NaN."""
    c = quoted(name)
    return c.isNull() | F.isnan(c) if is_float(df, name) else c.isNull()


def is_blank(df: DataFrame, name: str) -> Column:
    """Missing, or text of white space only."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.StringType, T.VarcharType, T.CharType)):
        return F.coalesce(quoted(name).rlike(r"^[ \t\r\n]*$"), F.lit(True))
    return is_missing(df, name)


def same_keys(x: DataFrame, y: DataFrame, by: Sequence[str]) -> Column:
    """Equality of keys in which NULL equals NULL."""
    return all_of(x[_tick(k)].eqNullSafe(y[_tick(k)]) for k in by)


def _tick(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def order_columns(order) -> list[Column]:
    """Sort columns of ``order``: names (ascending, NULL last) or Columns as they are."""
    if order is None:
        raise ValueError("this operator depends on row order: pass `order=`.")
    return [quoted(o).asc_nulls_last() if isinstance(o, str) else o for o in ([order] if isinstance(order, (str, Column)) else order)]


def reversed_order(order) -> list[Column]:
    """The reverse of ``order``; only names can be reversed."""
    found = [order] if isinstance(order, (str, Column)) else list(order or [])
    if not found or not all(isinstance(o, str) for o in found):
        raise ValueError("this operator reverses row order: pass `order=` as column names.")
    return [quoted(o).desc_nulls_first() for o in found]


def window(by: Names | None, order) -> WindowSpec:
    keys = [quoted(b) for b in names_of(by)] if by else []
    return Window.partitionBy(*keys).orderBy(*order_columns(order))


def batch_only(df: DataFrame, what: str) -> DataFrame:
    """Operators that depend on row order refuse streams."""
    if as_table(df).isStreaming:
        raise ValueError(f"{what} depends on row order and can't run on a stream.")
    return df


def _place(columns: Sequence[Column]) -> Column:
    """A value that sorts as the columns do: ascending, NULL last."""
    return F.struct(*(f.alias(f"_{2 * i + k}") for i, c in enumerate(columns) for k, f in enumerate((c.isNull(), c))))


def unused(name: str, columns: Sequence[str]) -> str:
    """``name``, with as many underscores appended as make it differ from all ``columns``."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def value_bounds(df: DataFrame, keys: Sequence[str], ranges: int) -> list[tuple]:
    """Bounds between ``ranges`` ranges of the columns ``keys``, drawn from a sample of so many rows."""
    drawn = df.select(*map(quoted, keys)).orderBy(F.rand(1)).limit(ranges - 1)
    return [tuple(r) for r in drawn.distinct().orderBy(*order_columns(list(keys))).collect()]


def range_of(keys: Sequence[str], df: DataFrame, bounds: list[tuple]) -> Column:
    """The number of a row's range (from 0), by its own values alone."""
    kinds = [df.schema[k].dataType for k in keys]
    own = _place([quoted(k) for k in keys])

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        bound = _place([F.lit(v).cast(t) for v, t in zip(bounds[middle], kinds, strict=True)])
        return F.when(own <= bound, search(low, middle)).otherwise(search(middle + 1, high))

    return search(0, len(bounds))


def with_row_id(df: DataFrame, order, name: str = "row_id", buckets: int | None = None) -> DataFrame:
    """Adds 1..n in ``order`` (column names), without bringing all rows into one task.

    Rows are numbered within ranges of the order, from the sum of the sizes of the ranges before. There are ``buckets``
    ranges, by default one for a million rows and from 64 to 2,048; a row's range depends on its own values alone. Rows
    that tie go by a hash of all their values, so only equal rows can change places between runs.
    """
    if name in batch_only(df, "with_row_id").columns:
        raise ValueError(f"a column is already called {name}.")
    order_columns(order)
    keys = [order] if isinstance(order, str) else list(order)
    if not all(isinstance(k, str) for k in keys):
        raise ValueError("row numbers need `order=` as column names.")
    keys = resolve_cols(df, keys)
    buckets = buckets or min(2048, max(64, df.count() // 1_000_000))
    tied = df.withColumn("_tie", F.xxhash64(*map(quoted, (f.name for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))))))
    bounds = value_bounds(tied, [*keys, "_tie"], buckets)
    placed = tied.withColumn("_bucket", range_of([*keys, "_tie"], tied, bounds))
    sizes = placed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_size"))  # a row for each range
    before = sizes.select("_bucket", F.coalesce(F.sum("_size").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    number = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order_columns([*keys, "_tie"]))) + F.col("_before")
    return placed.join(F.broadcast(before), "_bucket").withColumn(name, number).select(*map(quoted, df.columns), name)


def exact_quantiles(df: DataFrame, column: str, probs: Sequence[float], few: int = 1_000_000) -> list[float] | None:
    """Quantiles with linear interpolation, NULL left out; None without values.

    Up to ``few`` values are counted in one aggregate. Of more, approximate quantiles bracket each place, again and
    again until that few values lie in between, so no buffer grows with the table.
    """
    values = df.select(quoted(column).cast("double").alias("v")).filter("v is not null")
    n = values.count()
    if n <= few:
        return values.agg(F.percentile("v", [float(p) for p in probs])).first()[0]

    def at(place: int) -> float:
        """The value at a place (from 0)."""
        inside, below, total, slack = values, 0, n, 3e-4
        while total > few:
            share = (place - below) / total
            a, b = inside.agg(F.percentile_approx("v", [max(0.0, share - slack), min(1.0, share + slack)], 10_000)).first()[0]
            less, low, between, high = inside.agg(*(F.count_if(c) for c in (F.col("v") < a, F.col("v") == a, (F.col("v") > a) & (F.col("v") < b), (F.col("v") == b) & F.lit(a != b)))).first()
            rank = place - below - less
            if not 0 <= rank < low + between + high:
                slack *= 4
                continue
            if not low <= rank < low + between:
                return a if rank < low else b
            inside, below, total, slack = inside.filter((F.col("v") > a) & (F.col("v") < b)), below + less + low, between, 3e-4
        return inside.agg(F.get(F.sort_array(F.collect_list("v")), F.lit(place - below))).first()[0]

    out = []
    for p in probs:
        place = p * (n - 1)
        low = at(int(place))
        out.append(low + (at(int(place) + 1) - low) * (place - int(place)) if place > int(place) else low)
    return out


def dealt_by(df: DataFrame, keys: Sequence[str], rows: int, share: int = 500_000) -> DataFrame:
    """``df`` in tasks of some ``share`` of its ``rows``, equal keys together, so that aggregates and sorts by key hold no more."""
    return df.repartition(-(-rows // share), *map(quoted, keys)) if rows > share else df


def clean_names(names: Sequence[str], method: str = "unique") -> list[str]:
    """Names in lower case with underscores, made unique with _1, _2 (``universal``: also syntactic; ``minimal``: as they are)."""
    import re

    if method not in ("unique", "universal", "minimal"):
        raise ValueError("method must be unique, universal or minimal.")
    if method == "minimal":
        return list(names)
    cleaned = [re.sub(r"^_+|_+$", "", re.sub(r"[^0-9a-z]+", "_", n.lower())) or "x" for n in names]
    if method == "universal":
        cleaned = [n if re.match(r"[a-z.]", n) and not re.match(r"\.\d", n) else f"X{n}" for n in cleaned]
    taken, out, next_number = set(cleaned), [], {}
    for n in cleaned:
        new = n
        if n in out:
            k = next_number.get(n, 1)
            while f"{n}_{k}" in taken:
                k += 1
            new, next_number[n] = f"{n}_{k}", k + 1
            taken.add(new)
        out.append(new)
    return out


def suffixed(x: DataFrame, y: DataFrame, by: Sequence[str], suffixes: tuple[str, str]) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``suffixes`` on the names that they share besides the keys."""
    shared = [c for c in x.columns if c in y.columns and c not in by]
    return tuple(df.withColumnsRenamed({c: c + s for c in shared}) for df, s in ((x, suffixes[0]), (y, suffixes[1])))


def composed(df: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    return reduce(lambda d, step: step(d), steps, df)
