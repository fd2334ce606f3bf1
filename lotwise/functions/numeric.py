"""Column helpers for numbers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(col: Column, digits: int = 1) -> Column:
    """Round half to even on the scaled double, as numpy does."""
    scale = float(10**digits)
    return F.rint(col * F.lit(scale)) / F.lit(scale)


def r6(col: Column | str, name: str | None = None) -> Column:
    """Six digits, for comparable output."""
    c = F.col(col) if isinstance(col, str) else col
    out = F.round(c, 6)
    label = name or (col if isinstance(col, str) else None)
    return out.alias(label) if label else out


def ladder(col: Column, steps, missing: str | None = None) -> Column:
    """First label whose upper bound exceeds the value; null gets ``missing`` (or the last label)."""
    out = None
    if missing is not None:
        out = F.when(col.isNull(), F.lit(missing))
    for bound, label in steps:
        if bound is None:
            out = out.otherwise(F.lit(label))
        else:
            cond = col < F.lit(float(bound))
            out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out


def clip(col: Column, low: float, high: float) -> Column:
    return F.when(col.isNull(), None).otherwise(F.least(F.greatest(col, F.lit(low)), F.lit(high)))


def add_all(cols) -> Column:
    return reduce(lambda a, b: a + b, cols)


def denan(col: Column) -> Column:
    """NaN to NULL."""
    return F.when(~F.isnan(col), col)
