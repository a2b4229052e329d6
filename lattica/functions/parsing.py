"""Parsing text. What can't be parsed is NULL, or with ``strict`` the error "Parse failure."."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.core import as_column, batch_only, quoted, with_row_id

#: strptime's conversions in Java's words.
CONVERSIONS = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "y": "yy", "b": "MMM", "B": "MMMM", "j": "DDD", "I": "hh", "p": "a", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "e": "d"}


def java_format(pattern: str) -> str:
    """A strptime format in Java's syntax."""
    out, i = "", 0
    while i < len(pattern):
        if pattern[i] == "%":
            out += CONVERSIONS[pattern[i + 1]]
            i += 2
        else:
            out += f"'{pattern[i]}'" if pattern[i].isalpha() else pattern[i]
            i += 1
    return out


def _sentinels(x: Column, na: Sequence[str]) -> Column:
    return F.when(~x.isin(list(na)), x) if na else x


def _strictly(x: Column, parsed: Column, kind: str, strict: bool) -> Column:
    return F.when(x.isNotNull() & parsed.isNull(), F.raise_error(F.lit("Parse failure.")).cast(kind)).otherwise(parsed) if strict else parsed


def parseint(c, na: Sequence[str] = (), strict: bool = False) -> Column:
    """Whole numbers; decimals are cut off."""
    x = _sentinels(as_column(c).cast("string"), na)
    return _strictly(x, x.try_cast("double").try_cast("int"), "int", strict)


def parsenum(c, decimal: str = ".", grouping: str = ",", na: Sequence[str] = (), strict: bool = False) -> Column:
    x = _sentinels(as_column(c).cast("string"), na)
    text = F.replace(x, F.lit(grouping), F.lit("")) if grouping else x
    text = F.replace(text, F.lit(decimal), F.lit(".")) if decimal != "." else text
    return _strictly(x, text.try_cast("double"), "double", strict)


def parselogical(c, na: Sequence[str] = (), strict: bool = False) -> Column:
    """true, t, 1 and false, f, 0, in either case."""
    x = _sentinels(as_column(c).cast("string"), na)
    low = F.lower(x)
    return _strictly(x, F.when(low.isin("true", "t", "1"), True).when(low.isin("false", "f", "0"), False), "boolean", strict)


def parsedate(c, formats: Sequence[str], strict: bool = False) -> Column:
    """By the first strptime format that fits."""
    x = as_column(c).cast("string")
    parsed = F.coalesce(*(F.try_to_timestamp(x, F.lit(java_format(f))).cast("date") for f in ([formats] if isinstance(formats, str) else formats)))
    return _strictly(x, parsed, "date", strict)


def parsedatetime(c, formats: Sequence[str], tz: str = "UTC", strict: bool = False) -> Column:
    """By the first strptime format that fits, as a time in ``tz``."""
    x = as_column(c).cast("string")
    parsed = F.coalesce(*(F.try_to_timestamp(x, F.lit(java_format(f))) for f in ([formats] if isinstance(formats, str) else formats)))
    return _strictly(x, parsed if tz == "UTC" else F.to_utc_timestamp(parsed, tz), "timestamp", strict)


def parsepercent(c, strict: bool = False) -> Column:
    return parsenum(F.regexp_replace(as_column(c).cast("string"), "%$", ""), strict=strict) / 100


def parsecurrency(c, strict: bool = False) -> Column:
    return parsenum(F.regexp_replace(as_column(c).cast("string"), "[$,]", ""), strict=strict)


def parsefailures(df: DataFrame, column: str, parse: Callable[[Column], Column], *, order) -> DataFrame:
    """index (row number) and value of what isn't NULL but parses to NULL."""
    numbered = with_row_id(batch_only(df, "parsefailures"), order, "index")
    return numbered.filter(quoted(column).isNotNull() & parse(quoted(column)).isNull()).select("index", quoted(column).alias("value"))
