"""Verbs on streams.

Verbs without row order (projection, filters, text, date, recode and parsing functions) take streams as they are. The
others refuse them; these are the forms that streams allow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.core import Names, as_expr, quoted, resolve_cols


def removeduplicates_within(df: DataFrame, by: Names, time: str, delay: str) -> DataFrame:
    """The first row of each key that arrives; keys are forgotten once the watermark has passed."""
    return df.withWatermark(time, delay).dropDuplicatesWithinWatermark(resolve_cols(df, by))


def summarise_windows(df: DataFrame, time: str, length: str, delay: str, by: Names | None = None, slide: str | None = None, **exprs) -> DataFrame:
    """Named aggregates for each window of time and key; rows later than ``delay`` are dropped."""
    keys = [quoted(k) for k in resolve_cols(df, by)] if by is not None else []
    span = F.window(quoted(time), length, slide) if slide else F.window(quoted(time), length)
    out = df.withWatermark(time, delay).groupBy(span, *keys).agg(*(as_expr(e).alias(n) for n, e in exprs.items()))
    rest = [c for c in out.columns if c != "window"]
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *map(quoted, rest))


def summarise_sessions(df: DataFrame, time: str, gap: str, delay: str, by: Names, **exprs) -> DataFrame:
    """Named aggregates for each session: rows of a key with no pause as long as ``gap``."""
    keys = [quoted(k) for k in resolve_cols(df, by)]
    out = df.withWatermark(time, delay).groupBy(F.session_window(quoted(time), gap), *keys).agg(*(as_expr(e).alias(n) for n, e in exprs.items()))
    rest = [c for c in out.columns if c != "session_window"]
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *map(quoted, rest))
