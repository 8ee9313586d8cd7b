"""Column helpers shared by every operator.

All helpers return native Catalyst expressions, so every stage built from
them stays inside whole-stage codegen (no Python in the hot path).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(x) -> Column:
    if isinstance(x, Column):
        return x
    if isinstance(x, str):
        return F.col(x)
    return F.lit(x)


def clip(x, lo: float = 0.0, hi: float = 1.0) -> Column:
    """Clip to [lo, hi] keeping null as null (Spark's greatest/least skip nulls)."""
    x = _c(x)
    return F.when(x.isNotNull(), F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), x)))


def neg(x) -> Column:
    """abs(x) where x < 0, else 0 (null counts as "not negative" -> 0)."""
    x = _c(x)
    return F.when(x < 0, -x).otherwise(F.lit(0.0))


def rint_to(x, digits: int) -> Column:
    """Half-even rounding of the scaled binary value (NumPy / pandas ``round``)."""
    scale = float(10 ** digits)
    return F.rint(_c(x) * scale) / scale


def safe_div(n, d, default=None) -> Column:
    """n / d, or ``default`` (null) when d is 0 or null: ANSI mode raises on x/0."""
    d = _c(d)
    out = F.when(d != 0, _c(n) / d)
    return out.otherwise(_c(default)) if default is not None else out


def col_or(df: DataFrame, name: str, default) -> Column:
    """The column when the frame has it, else a literal default (decided at plan time)."""
    if name in df.columns:
        return F.col(name)
    return F.lit(default)


def nan_to_null(x) -> Column:
    x = _c(x)
    return F.when(~F.isnan(x), x)
