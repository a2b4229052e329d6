"""Recoding, missing values and category levels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.core import as_column, one_col, quoted
from lattica.functions.text import isblank


def naif(c, values) -> Column:
    """NULL in place of ``values``."""
    x = as_column(c)
    return F.when(~x.isin(values if isinstance(values, (list, tuple, set)) else [values]), x)


def nato(c, value) -> Column:
    """``value`` in place of NULL (and of NaN, if the value is a number)."""
    x = as_column(c)
    if isinstance(value, float):
        x = F.nanvl(x.cast("double"), F.lit(value))
    return F.coalesce(x, F.lit(value))


def blanktona(c) -> Column:
    x = as_column(c)
    return F.when(~isblank(x), x)


def natoblank(c) -> Column:
    return F.coalesce(as_column(c).cast("string"), F.lit(""))


def replacevalues(c, old: Sequence, new: Sequence) -> Column:
    """``new`` in place of ``old`` at the same places, compared as text; others stay."""
    if len(old) != len(new):
        raise ValueError("`old` and `new` must have the same length.")
    x = as_column(c)
    text, out = x.cast("string"), x
    for o, n in zip(old[::-1], new[::-1], strict=True):
        out = F.when(text.isNull() if o is None else text == str(o), F.lit(n)).otherwise(out)
    return out


replaceall = recode = replacevalues


def collapsevalues(c, groups: Mapping[str, Sequence]) -> Column:
    """A label in place of each of its values; of several labels the last counts."""
    x = as_column(c)
    text = out = x.cast("string")
    for label, values in groups.items():
        out = F.when(text.isin([str(v) for v in values]), F.lit(label)).otherwise(out)
    return out


collapselevels = collapsevalues


def lump(df: DataFrame, column: str, n: int = 5, other: str = "Other", name: str | None = None) -> DataFrame:
    """The n most frequent values (ties by value) as they are; all else, NULL included, as ``other``."""
    c = one_col(df, column, "column")
    top = df.filter(quoted(c).isNotNull()).groupBy(quoted(c)).agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), quoted(c)).limit(n)
    kept = [r[0] for r in top.collect()]  # n values
    return df.withColumn(name or c, F.when(quoted(c).isin(kept), quoted(c).cast("string")).otherwise(F.lit(other)))


def with_levels(df: DataFrame, column: str, levels: Sequence[str]) -> DataFrame:
    """Records an order of categories in the column's metadata; values outside it become NULL."""
    kept = F.when(quoted(column).isin(list(levels)), quoted(column))
    return df.select(*(kept.alias(c, metadata={"levels": list(levels)}) if c == column else quoted(c) for c in df.columns))


def levels_of(df: DataFrame, column: str) -> list[str]:
    return list(df.schema[column].metadata.get("levels", []))


def reorderlevels(c, by: Sequence[str]) -> Column:
    """A category (level, code from 1) in the given order; values that aren't listed are NULL."""
    x = as_column(c)
    place = F.array_position(F.array(*map(F.lit, by)), x)
    return F.when(place > 0, F.struct(x.alias("level"), place.cast("int").alias("code")))


def expandlevels(df: DataFrame, column: str, levels: Sequence[str]) -> DataFrame:
    """Adds levels to a column's; values stay. More than 10,000 distinct values of a column without levels are refused."""
    own = levels_of(df, column) or [r[0] for r in df.select(quoted(column)).distinct().filter(quoted(column).isNotNull()).orderBy(quoted(column)).limit(10_001).collect()]
    if not levels_of(df, column) and len(own) > 10_000:
        raise ValueError("more than 10,000 levels.")
    return with_levels(df, column, list(dict.fromkeys([*own, *levels])))


def nalevel(c, value: str = "Missing") -> Column:
    return F.coalesce(as_column(c).cast("string"), F.lit(value))
