"""Map, traverse and fold: over array Columns by higher-order functions, over Python lists on the driver."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def map(x, f: Callable):
    """``f`` over each element."""
    return F.transform(x, f) if isinstance(x, (Column, str)) else [f(v) for v in x]


def traverse(lists: Sequence, f: Callable):
    """``f`` over the elements at the same place of several lists of equal length (arrays of unequal length give NULL)."""
    if all(isinstance(v, (Column, str)) for v in lists):
        columns = [F.col(v) if isinstance(v, str) else v for v in lists]
        zipped = F.arrays_zip(*(c.alias(f"_{i}") for i, c in enumerate(columns)))
        same = F.lit(True)
        for c in columns[1:]:
            same = same & (F.size(c) == F.size(columns[0]))
        checked = F.when(same, zipped) if len(columns) > 1 else zipped
        return F.transform(checked, lambda e: f(*(e[f"_{i}"] for i in range(len(columns)))))
    if len({len(v) for v in lists}) > 1:
        raise ValueError("All lists must have the same length.")
    return [f(*v) for v in zip(*lists, strict=True)]


def foldr(x, f: Callable, init=None, accumulate: bool = False):
    """Right fold: f(x1, f(x2, ... f(xn, init))); with ``accumulate`` all partial results, the whole fold first."""
    if isinstance(x, (Column, str)):
        start = init if isinstance(init, Column) else F.lit(init)
        back = F.reverse(x)
        if accumulate:
            return F.aggregate(back, F.array(start), lambda acc, v: F.concat(F.array(f(v, acc[0])), acc))
        return F.aggregate(back, start, lambda acc, v: f(v, acc))
    values = list(x)
    if init is None:
        if not values:
            return [] if accumulate else None
        acc = values.pop()
    else:
        acc = init
    steps = [acc]
    for v in reversed(values):
        acc = f(v, acc)
        steps.insert(0, acc)
    return steps if accumulate else acc
