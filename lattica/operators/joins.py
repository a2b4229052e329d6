"""Joins. NULL keys match NULL keys; columns come as keys, rest of x, rest of y; shared other names get suffixes."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.core import Names, all_of, as_table, batch_only, one_col, quoted, range_of, resolve_cols, same_keys, suffixed, value_bounds
from lattica.operators.rows import firstby


def common_names(x: DataFrame, y: DataFrame) -> list[str]:
    """Column names of both tables, in the order of x."""
    return [c for c in as_table(x).columns if c in as_table(y).columns]


commonnames = common_names


def _keys(x: DataFrame, y: DataFrame, by: Names | None) -> list[str]:
    keys = common_names(x, y) if by is None else resolve_cols(x, by)
    if not keys:
        raise ValueError("No common columns to join by.")
    return resolve_cols(y, keys)


def merge(x: DataFrame, y: DataFrame, by: Names | None = None, all: bool = False, all_x: bool | None = None, all_y: bool | None = None, sort: bool = False, suffixes: tuple[str, str] = (".x", ".y")) -> DataFrame:
    """Equi join: inner, or with all rows of x, of y or of both. The optimizer picks the strategy; AQE splits skewed keys."""
    keys = _keys(x, y, by)
    left, right = (all if f is None else f for f in (all_x, all_y))
    x, y = suffixed(x, y, keys, suffixes)
    tagged = y.withColumnsRenamed({k: f"_y_{k}" for k in keys})
    how = {(False, False): "inner", (True, False): "left", (False, True): "right", (True, True): "full"}[left, right]
    joined = x.join(tagged, all_of(quoted(k).eqNullSafe(quoted(f"_y_{k}")) for k in keys), how)
    both = [(F.coalesce(quoted(k), quoted(f"_y_{k}")) if right else quoted(k)).alias(k) for k in keys]
    out = joined.select(*both, *(quoted(c) for c in x.columns if c not in keys), *(quoted(c) for c in y.columns if c not in keys))
    return out.orderBy(*map(quoted, keys)) if sort else out


def semimerge(x: DataFrame, y: DataFrame, by: Names) -> DataFrame:
    """Rows of x, repeats included, whose key is in y."""
    keys = _keys(x, y, by)
    return x.join(y.select(*map(quoted, keys)), same_keys(x, y, keys), "left_semi")


def antimerge(x: DataFrame, y: DataFrame, by: Names) -> DataFrame:
    """Rows of x whose key isn't in y; a NULL key goes if y has one."""
    keys = _keys(x, y, by)
    return x.join(y.select(*map(quoted, keys)), same_keys(x, y, keys), "left_anti")


matchedkeys = semimerge


def unmatchedkeys(x: DataFrame, y: DataFrame, by: Names, order) -> DataFrame:
    """The first row of each key of x that isn't in y."""
    return firstby(antimerge(x, y, by), by, order)


def crossmerge(x: DataFrame, y: DataFrame) -> DataFrame:
    """Every row of x with every row of y."""
    x, y = suffixed(x, y, [], (".x", ".y"))
    return x.crossJoin(y)


def _as_number(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp")) / 1e6
    return F.unix_date(c).cast("double") if isinstance(kind, T.DateType) else c.cast("double")


def _ranged(stacked: DataFrame, right: DataFrame, ranges: int = 64) -> tuple[DataFrame, DataFrame]:
    """``stacked`` with _range, a range of _roll, and for each range the last row of ``right`` before it and the first after it."""
    bounds = value_bounds(stacked, ["_roll"], ranges)
    number = range_of(["_roll"], stacked, bounds)
    found = right.withColumn("_range", number).groupBy("_range", "_roll").agg(F.max("_y").alias("_y")).groupBy("_range")
    ends = found.agg(F.min_by("_y", "_roll").alias("_least"), F.max_by("_y", "_roll").alias("_most"))
    every = stacked.sparkSession.range(len(bounds) + 1).select(F.col("id").cast("int").alias("_range")).join(ends, "_range", "left")
    order = Window.orderBy("_range")  # a row for each range
    before = F.last("_most", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("_least", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    return stacked.withColumn("_range", number), every.select("_range", before.alias("_before_range"), after.alias("_after_range"))


def rollingmerge(x: DataFrame, y: DataFrame, by: Names, direction: str = "backward", tolerance: float | None = None) -> DataFrame:
    """As-of join: all rows of x with the row of y that is last before (or first after, or nearest to) the last key of ``by``.

    The other keys are equal. Rows of both sides are stacked and sorted once by key, and each row of x takes the last
    row of y seen so far: one shuffle, no pairs. Without other keys, ranges of the last key are sorted apart, and each
    takes over the nearest rows of the ranges beside it. Keys of y should be unique; of several the largest row counts. Nearest
    takes the earlier one of two equally near rows. Matches farther away than ``tolerance`` (seconds for times, days
    for dates) count as none.
    """
    if direction not in ("backward", "forward", "nearest"):
        raise ValueError("direction must be backward, forward or nearest.")
    batch_only(x, "rollingmerge")
    *equal, roll = _keys(x, y, by)
    extra = [c for c in y.columns if c not in (*equal, roll)]
    shown = {c: f"{c}.y" if c in x.columns else c for c in extra}
    payload = F.struct(quoted(roll).alias("_at"), *(quoted(c).alias(f"_{i}") for i, c in enumerate(extra)))
    left = x.select(*(quoted(k).alias(f"_k{i}") for i, k in enumerate(equal)), quoted(roll).alias("_roll"), F.struct(*map(quoted, x.columns)).alias("_x"), F.lit(None).cast(T.StructType([T.StructField("_at", y.schema[roll].dataType), *(T.StructField(f"_{i}", y.schema[c].dataType) for i, c in enumerate(extra))])).alias("_y"))
    right = y.filter(quoted(roll).isNotNull()).select(*(quoted(k).alias(f"_k{i}") for i, k in enumerate(equal)), quoted(roll).alias("_roll"), F.lit(None).cast(left.schema["_x"].dataType).alias("_x"), payload.alias("_y"))
    stacked = left.unionByName(right)
    keys = [F.col(f"_k{i}") for i in range(len(equal))]
    is_x = F.col("_x").isNotNull()
    if not keys:  # ranges of the roll key take the place of equal keys
        stacked, carried = _ranged(stacked, right.select("_roll", "_y"))
        keys = [F.col("_range")]
    tie = F.col("_y").asc_nulls_last()
    before = F.last("_y", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(F.col("_roll").asc_nulls_first(), is_x, tie).rowsBetween(Window.unboundedPreceding, 0))
    after = F.last("_y", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(F.col("_roll").desc_nulls_first(), is_x, tie).rowsBetween(Window.unboundedPreceding, 0))
    if direction != "forward":
        stacked = stacked.withColumn("_before", before)
    if direction != "backward":
        stacked = stacked.withColumn("_after", after)
    if not equal:
        stacked = stacked.join(F.broadcast(carried), "_range")  # a row for each range
        for side in ("_before", "_after"):
            if side in stacked.columns:
                stacked = stacked.withColumn(side, F.coalesce(side, f"{side}_range"))
    kind = x.schema[roll].dataType
    gap = lambda m: F.abs(_as_number(F.col("_roll"), kind) - _as_number(F.col(f"{m}._at"), y.schema[roll].dataType))
    match = {"backward": F.col("_before") if direction == "backward" else None, "forward": F.col("_after") if direction == "forward" else None}.get(direction)
    if direction == "nearest":
        match = F.when(F.col("_after").isNull() | (gap("_before") <= gap("_after")), F.col("_before")).otherwise(F.col("_after"))
    out = stacked.filter(is_x).withColumn("_m", F.when(F.col("_roll").isNotNull(), match))
    if tolerance is not None:
        out = out.withColumn("_m", F.when(gap("_m") <= tolerance, F.col("_m")))
    return out.select("_x.*", *(F.col(f"_m._{i}").alias(shown[c]) for i, c in enumerate(extra)))


def nearestmerge(x: DataFrame, y: DataFrame, by: Names, tolerance: float | None = None) -> DataFrame:
    return rollingmerge(x, y, by, "nearest", tolerance)


#: Pairs of one task, about; and the product of both sides' rows up to which a join is left as it is.
_TASK_PAIRS, _FEW_PAIRS = 20_000_000, 200_000_000


def _spread(df: DataFrame, rows: int) -> DataFrame:
    """``df`` in tasks of half a million rows at most, however few files it is in."""
    return df.repartition(max(64, rows // 500_000))


def _met(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], condition: Column, sized: bool) -> DataFrame:
    """Pairs of rows with equal ``on`` (NULL equals NULL) that fulfil ``condition``; no task has to make more than its share.

    Groups of many pairs are counted first and cut into pieces: the longer side is dealt out, the shorter one copied to
    each piece. Groups go to a fixed number of tasks, so a broadcast of one side doesn't leave all pairs to the few
    tasks that read the other. Without ``sized`` there are too few pairs to count.
    """
    names = [f"_g{i}" for i in range(len(on))]
    key = lambda side, more=(): F.struct(*(quoted(pair[side]).alias(n) for n, pair in zip(names, on, strict=True)), *more)  # noqa: E731  fields of structs match NULL with NULL
    if not sized:
        return left.withColumn("_g", key(0)).repartition(16, "_g").join(right.withColumn("_y__g", key(1)).repartition(16, "_y__g"), (F.col("_g") == F.col("_y__g")) & condition)
    rows = [df.groupBy(key(side).alias("_g")).agg(F.count(F.lit(1)).alias(n)) for side, (df, n) in enumerate(((left, "_m"), (right, "_n")))]
    most = rows[0].join(rows[1], "_g").select("*", (F.col("_m").cast("double") * F.col("_n")).alias("_pairs")).orderBy(F.desc("_pairs")).limit(10_000)
    largest = most.collect()  # of more groups than that none has to be cut
    share = max(_TASK_PAIRS, sum(r["_pairs"] for r in largest) / 4096)
    heavy = [(r["_g"], math.ceil(r["_pairs"] / share), r["_m"] >= r["_n"]) for r in largest if r["_pairs"] > share]
    tasks = max(64, sum(math.ceil(r["_pairs"] / share) for r in largest if r["_pairs"] > share / 16))
    pieces = left.sparkSession.createDataFrame(heavy, T.StructType([T.StructField("_h", most.schema["_g"].dataType), T.StructField("_of", T.IntegerType()), T.StructField("_cut", T.BooleanType())]))

    def dealt(df: DataFrame, side: int) -> DataFrame:
        hashed = F.xxhash64(*(quoted(f.name) for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))))
        own = F.col("_cut") if side == 0 else ~F.col("_cut")
        number = F.when(F.col("_of").isNull(), F.array(F.lit(0))).when(own, F.array(F.pmod(hashed, "_of").cast("int"))).otherwise(F.sequence(F.lit(0), F.col("_of") - 1))
        found = df.withColumn("_k", key(side)).join(F.broadcast(pieces), F.col("_k") == F.col("_h"), "left") if heavy else df.withColumns({"_of": F.lit(None).cast("int"), "_cut": F.lit(None).cast("boolean")})
        found = found.withColumn("_piece", F.explode(number)) if heavy else found.withColumn("_piece", F.lit(0))
        return found.withColumn("_y__g" if side else "_g", key(side, [F.col("_piece")])).drop("_k", "_h", "_of", "_cut", "_piece")

    return dealt(left, 0).repartition(min(4096, tasks), "_g").join(dealt(right, 1).repartition(min(4096, tasks), "_y__g"), (F.col("_g") == F.col("_y__g")) & condition)


_OPERATORS = {">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, "<": lambda a, b: a < b, "==": lambda a, b: a.eqNullSafe(b)}


def _one_kind(x: DataFrame, a: str, y: DataFrame, b: str) -> bool:
    kinds = x.schema[a].dataType, y.schema[b].dataType
    return kinds[0] == kinds[1] or all(isinstance(k, T.NumericType) for k in kinds)


def _between(ranges: list[tuple[str, str, str]], x: DataFrame, y: DataFrame) -> tuple[str, str, str, str] | None:
    """Of the conditions two that put a column of one side between two of the other, as intervals of x and y."""
    lower = [(a, b) for a, op, b in ranges if op in (">=", ">")]
    upper = [(a, b) for a, op, b in ranges if op in ("<=", "<")]
    for (a, b), (c, d) in ((low, high) for low in lower for high in upper):
        if (a == c or b == d) and all(_can_bin(df, n) for df, n in ((x, a), (x, c), (y, b), (y, d))):
            return (a, a, b, d) if a == c else (c, a, b, b)
    return None


def nonequimerge(x: DataFrame, y: DataFrame, by: Names) -> DataFrame:
    """Inner join on equal names and conditions like ``"date>=start"`` (x on the left); both sides' columns are kept.

    Of many rows not all pairs are compared: where two conditions make an interval, rows meet in bins as in
    ``overlapmerge``; otherwise the rows of y are cut by the first condition's column into ranges (the more, the more rows
    a key has), and those of x go only to ranges that can fulfil it.
    """
    found = [by] if isinstance(by, str) else list(by)
    equal, ranges = [], []
    for item in found:
        m = re.fullmatch(r"\s*(.+?)\s*(>=|<=|==|>|<)\s*(.+?)\s*", item)
        if m:
            ranges.append((one_col(x, m[1], "by"), m[2], one_col(y, m[3], "by")))
        else:
            equal.append(item)
    resolve_cols(x, equal), resolve_cols(y, equal)
    shared = [c for c in x.columns if c in y.columns and c not in equal]
    tagged = y.withColumnsRenamed({c: f"_y_{c}" for c in y.columns})
    keys = [(k, k) for k in equal] + [(a, b) for a, op, b in ranges if op == "=="]
    cond = all_of([*(quoted(a).eqNullSafe(quoted(f"_y_{b}")) for a, b in keys), *(_OPERATORS[op](quoted(a), quoted(f"_y_{b}")) for a, op, b in ranges if op != "==")])
    first = next(((a, op, b) for a, op, b in ranges if op != "==" and _one_kind(x, a, y, b)), None)
    same = all(x.schema[a].dataType == y.schema[b].dataType for a, b in keys)
    can = first and same and not x.isStreaming and not y.isStreaming
    m, n = (x.count(), y.count()) if can else (0, 0)
    if m * n <= _FEW_PAIRS:
        joined = x.join(tagged, cond, "inner")
    else:
        residual = all_of(_OPERATORS[op](quoted(a), quoted(f"_y_{b}")) for a, op, b in ranges if op != "==")
        spans = _between(ranges, x, y)
        left, right, on, once = _in_bins(x, y, keys, spans, None)[:4] if spans else _in_ranges(_spread(x, m), y, keys, *first, n)
        joined = _met(left, right, on, once & residual, True)
    own = [quoted(c).alias(f"{c}.x" if c in shared else c) for c in x.columns]
    return joined.select(*own, *(quoted(f"_y_{c}").alias(f"{c}.y" if c in shared else c) for c in y.columns if c not in equal))


def _in_ranges(x: DataFrame, y: DataFrame, keys: list[tuple[str, str]], a: str, op: str, b: str, rows: int, depth: int = 6):
    """Both sides ready for ``_met``: y cut into ranges of ``b``, x copied to those in which ``a op b`` can hold.

    There are 2**depth ranges over all; a key of few rows joins neighbours together until a range holds some 256 rows.
    """
    kind = x.schema[a].dataType if x.schema[a].dataType == y.schema[b].dataType else T.DoubleType()  # rounding keeps the order
    y = y.filter(quoted(b).isNotNull()).withColumn("_at", quoted(b).cast(kind))
    x = x.filter(quoted(a).isNotNull()).withColumn("_at", quoted(a).cast(kind))
    number = range_of(["_at"], y, value_bounds(y, ["_at"], 2**depth))
    key = lambda side: F.struct(*(quoted(pair[side]).alias(f"_{i}") for i, pair in enumerate(keys)), F.lit(0).alias("_"))
    size = y.groupBy(key(1).alias("_k")).agg(F.count(F.lit(1)).alias("_size")).filter("_size > 256")
    size = size.select("_k", (depth - F.least(F.lit(depth), F.greatest(F.lit(0), F.ceil(F.log2(F.col("_size") / 256))))).cast("int").alias("_shift"))
    size = F.broadcast(size) if rows <= 256_000_000 else size  # a row for each 256 of y at most
    ranged = lambda df, side: df.withColumns({"_k": key(side), "_r": number}).join(size, "_k", "left").withColumn("_shift", F.coalesce("_shift", F.lit(depth))).withColumn("_r", F.expr("shiftright(_r, _shift)"))
    right = ranged(y, 1).drop("_k", "_shift", "_at")
    right = right.withColumnsRenamed({c: f"_y_{c}" for c in right.columns})
    fits = F.sequence(F.lit(0), F.col("_r")) if op in (">=", ">") else F.sequence(F.col("_r"), F.expr(f"shiftright({2**depth - 1}, _shift)"))
    left = ranged(x, 0).withColumn("_r", F.explode(fits)).drop("_k", "_shift", "_at")
    return left, right, [*((p, f"_y_{q}") for p, q in keys), ("_r", "_y__r")], F.lit(True)


def _left_on(x: DataFrame, y: DataFrame, by: list[str], condition) -> DataFrame:
    """Left join on equal keys and a condition; key columns of y go, other shared names get suffixes."""
    shared = [c for c in x.columns if c in y.columns and c not in by]
    tagged = y.withColumnsRenamed({c: f"_y_{c}" for c in y.columns})
    joined = x.join(tagged, all_of([*(quoted(k).eqNullSafe(quoted(f"_y_{k}")) for k in by), condition]), "left")
    own = [quoted(c).alias(f"{c}.x" if c in shared else c) for c in x.columns]
    return joined.select(*own, *(quoted(f"_y_{c}").alias(f"{c}.y" if c in shared else c) for c in y.columns if c not in by))


def _in_bins(x: DataFrame, y: DataFrame, keys: list[tuple[str, str]], spans: tuple[str, str, str, str], bin_width: float | None):
    """Both sides ready for ``_met``, with its ``on`` and the condition by which a pair counts once, and the rows of both sides.

    Each interval has a level: the first doubling of the width that is no shorter, and at its own level and at all higher
    ones it lies in two bins at most. Two intervals meet in a bin of the higher of their levels, and each pair counts in
    the first one. So that intervals of lower levels don't meet there among themselves, x of the higher (or the same) level
    and y of the higher level are kept apart: the latter meet at -1 - level.
    """
    sx, ex, sy, ey = spans
    number = lambda df, c: F.nanvl(_as_number(quoted(c), df.schema[c].dataType), F.lit(float("inf")))  # noqa: E731  NaN is the largest number
    exponent = lambda length: F.when(length > 0, F.least(F.ceil(F.log2(length)), F.lit(1100))).cast("int")  # noqa: E731  endless ones lie in one bin
    lengths = number(x, ex) - number(x, sx), number(y, ey) - number(y, sy)
    mean, of_x, m = x.agg(F.avg(F.when((lengths[0] >= 0) & (lengths[0] < float("inf")), lengths[0])), F.collect_set(exponent(lengths[0])), F.count(F.lit(1))).first()  # as many as powers of two
    other, of_y, n = y.agg(F.avg(F.when((lengths[1] >= 0) & (lengths[1] < float("inf")), lengths[1])), F.collect_set(exponent(lengths[1])), F.count(F.lit(1))).first()
    if bin_width is None:
        mean = mean or other
        bin_width = 2.0 ** math.ceil(math.log2(mean)) if mean and 0 < mean < float("inf") else 1.0
    shift = math.floor(math.log2(bin_width))
    x_levels, y_levels = (sorted({0, *(max(0, e - shift) for e in found)}) for found in (of_x, of_y))

    apart = [-1 - v for v in y_levels if v]
    x = _spread(x, m) if m * n > _FEW_PAIRS else x

    def binned(df: DataFrame, s: str, e: str, meets: Column) -> DataFrame:
        df = df.withColumns({"_from": number(df, s), "_to": number(df, e)}).filter("_from <= _to")
        df = df.withColumn("_own", F.greatest(F.lit(0), F.coalesce(exponent(F.col("_to") - F.col("_from")) - shift, F.lit(0))))
        df = df.withColumn("_level", F.explode(F.array(*map(F.lit, [*x_levels, *apart])))).filter(meets)
        df = df.withColumn("_w", F.pow(F.lit(2.0), F.when(F.col("_level") < 0, -1 - F.col("_level")).otherwise(F.col("_level"))) * bin_width)
        df = df.withColumn("_first", F.floor(F.col("_from") / F.col("_w")).cast("long"))
        return df.withColumn("_bin", F.explode(F.sequence(F.col("_first"), F.floor(F.col("_to") / F.col("_w")).cast("long")))).drop("_w", "_from", "_to", "_own")

    left = binned(x, sx, ex, F.expr("if(_level < 0, -1 - _level > _own, _level = _own)"))
    right = binned(y, sy, ey, F.expr("if(_level < 0, -1 - _level = _own, _level >= _own)"))
    right = right.withColumnsRenamed({c: f"_y_{c}" for c in right.columns})
    on = [*((p, f"_y_{q}") for p, q in keys), ("_level", "_y__level"), ("_bin", "_y__bin")]
    return left, right, on, F.col("_bin") == F.greatest("_first", "_y__first"), m, n


def _overlapping(x: DataFrame, y: DataFrame, keys: list[str], spans: tuple[str, str, str, str], bin_width: float | None) -> DataFrame:
    """All rows of x with the rows of y of equal keys whose closed interval overlaps theirs."""
    sx, ex, sy, ey = spans
    left, right, on, once, m, n = _in_bins(x, y, [(k, k) for k in keys], spans, bin_width)
    overlap = (quoted(sx) <= quoted(f"_y_{ey}")) & (quoted(ex) >= quoted(f"_y_{sy}"))
    shared = [c for c in x.columns if c in y.columns and c not in keys]
    own = [quoted(c).alias(f"{c}.x" if c in shared else c) for c in x.columns]
    others = [c for c in y.columns if c not in keys]
    matched = _met(left, right, on, once & overlap, m * n > _FEW_PAIRS).select(*own, *(quoted(f"_y_{c}").alias(f"{c}.y" if c in shared else c) for c in others))
    # a row of x comes up in several bins: it is unmatched only where no bin has a match; one match is enough to know
    key = lambda side: F.struct(*(quoted(pair[side]).alias(f"_{i}") for i, pair in enumerate(on)))
    tasks = max(64, m // 500_000) if m * n > _FEW_PAIRS else 16
    met = left.withColumn("_g", key(0)).repartition(tasks, "_g").join(right.select(key(1).alias("_y__g"), quoted(f"_y_{sy}"), quoted(f"_y_{ey}")), (F.col("_g") == F.col("_y__g")) & overlap, "left_semi")
    alone = x.join(met.select(*(quoted(c).alias(f"_h_{c}") for c in x.columns)).distinct(), all_of(quoted(c).eqNullSafe(quoted(f"_h_{c}")) for c in x.columns), "left_anti")
    empty = [F.lit(None).cast(y.schema[c].dataType).alias(f"{c}.y" if c in shared else c) for c in others]
    return matched.unionByName(alone.select(*own, *empty))


def _can_bin(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType))


def rangemerge(x: DataFrame, y: DataFrame, by: Names, lower: str, upper: str, value: str, bin_width: float | None = None) -> DataFrame:
    """All rows of x with the rows of y whose ``value`` is from ``lower`` to ``upper``; ``by`` is equal.

    Numbers and times are cut into bins (as in ``overlapmerge``), so not all pairs of a key meet; other types are compared pair by pair.
    """
    keys = _keys(x, y, by)
    lower, upper, value = one_col(x, lower, "lower"), one_col(x, upper, "upper"), one_col(y, value, "value")
    if _can_bin(x, lower) and _can_bin(x, upper) and _can_bin(y, value):
        return _overlapping(x, y, keys, (lower, upper, value, value), bin_width)
    return _left_on(x, y, keys, quoted(f"_y_{value}").between(quoted(lower), quoted(upper)))


def overlapmerge(x: DataFrame, y: DataFrame, startx: str, endx: str, starty: str, endy: str, by: Names | None = None, bin_width: float | None = None) -> DataFrame:
    """All rows of x with the rows of y whose closed interval overlaps theirs; ``by`` is equal if given.

    Numbers and times are cut into bins of ``bin_width`` (seconds for times, days for dates; by default the
    mean length of x's intervals) and its doubles, so that only intervals that share a bin meet. An interval that ends
    before it starts, or has a NULL end, overlaps nothing.
    """
    spans = one_col(x, startx, "startx"), one_col(x, endx, "endx"), one_col(y, starty, "starty"), one_col(y, endy, "endy")
    keys = _keys(x, y, by) if by is not None else []
    if all(_can_bin(df, c) for df, c in zip((x, x, y, y), spans, strict=True)):
        return _overlapping(x, y, keys, spans, bin_width)
    sx, ex, sy, ey = spans
    return _left_on(x, y, keys, (quoted(sx) <= quoted(f"_y_{ey}")) & (quoted(ex) >= quoted(f"_y_{sy}")))


def updatemerge(x: DataFrame, y: DataFrame, by: Names, cols: Names | None = None, order=None) -> DataFrame:
    """Overwrites ``cols`` of x (by default all shared ones) from the first row of y with the key; a NULL overwrites too."""
    keys = _keys(x, y, by)
    changed = [c for c in common_names(x, y) if c not in keys] if cols is None else resolve_cols(y, resolve_cols(x, cols))
    first = (firstby(y, keys, order) if order is not None else y.dropDuplicates(keys)).select(*(quoted(c).alias(f"_y_{c}") for c in [*keys, *changed]), F.lit(True).alias("_hit"))
    joined = x.join(first, all_of(quoted(k).eqNullSafe(quoted(f"_y_{k}")) for k in keys), "left")
    return joined.select(*(F.when(F.col("_hit"), quoted(f"_y_{c}")).otherwise(quoted(c)).alias(c) if c in changed else quoted(c) for c in x.columns))


def joinrelationship(x: DataFrame, y: DataFrame, by: Names) -> str:
    """one-to-one, one-to-many, many-to-one or many-to-many, by whether keys repeat on either side."""
    keys = _keys(x, y, by)
    many = [not df.groupBy(*map(quoted, keys)).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").isEmpty() for df in (x, y)]
    return "-to-".join("many" if m else "one" for m in many)

