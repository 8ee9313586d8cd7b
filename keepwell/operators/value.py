"""Customer value.

The discounted CLV is a finite geometric series, so the per-row 36-step loop
becomes the closed form ``mrr * q * (1 - q^n) / (1 - q)`` with
``q = (1 - p) / (1 + r/12)``; ``q = 1`` falls back to ``mrr * n``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import col_or, rint_to

# ---- fixed values: CLV tiers (inclusive lower bounds, first match wins) ----
CLV_TIERS = (("Enterprise", 5000.0), ("High", 1500.0), ("Medium", 500.0), ("Low", 0.0))
CLV_TIER_ORDER = ["Enterprise", "High", "Medium", "Low"]
DISCOUNT_RATE = 0.10
HORIZON_MONTHS = 36
SIMPLE_MONTHLY_FACTOR = 1.008


def geometric_value(mrr: Column, q: Column, months: int) -> Column:
    """sum_{t=1..n} mrr * q^t."""
    return F.when(q == 1.0, mrr * F.lit(float(months))).otherwise(
        mrr * q * (F.lit(1.0) - F.pow(q, F.lit(float(months)))) / (F.lit(1.0) - q)
    )


def clv(mrr: Column, p: Column, discount_rate: float = DISCOUNT_RATE, months: int = HORIZON_MONTHS) -> Column:
    """Discounted CLV, rounded to cents."""
    q = (F.lit(1.0) - p) / (F.lit(1.0) + F.lit(discount_rate / 12))
    return F.round(geometric_value(mrr, q, months), 2)


def clv_simple(mrr: Column, p: Column, months: int = HORIZON_MONTHS) -> Column:
    """Same series with a constant monthly factor 1.008, unrounded."""
    q = (F.lit(1.0) - p) / F.lit(SIMPLE_MONTHLY_FACTOR)
    return geometric_value(mrr, q, months)


def clv_tier(v: Column) -> Column:
    """First tier whose bound is met; anything else (null, negative) -> Low."""
    out = None
    for name, bound in CLV_TIERS:
        out = F.when(v >= bound, name) if out is None else out.when(v >= bound, name)
    return out.otherwise("Low")


def add_clv(df: DataFrame, p_col: str = "churn_probability") -> DataFrame:
    """Clv, clv_tier, annualised_revenue; defaults p .2 and mrr 100 when absent."""
    p = col_or(df, p_col, 0.2)
    mrr = col_or(df, "monthly_revenue", 100.0)
    df = df.withColumn("clv", clv(mrr, p))
    return df.withColumns({"clv_tier": clv_tier(F.col("clv")), "annualised_revenue": rint_to(mrr * 12, 2)})


def clv_summary(df: DataFrame) -> DataFrame:
    """per tier count(clv), avg/sum clv, avg mrr (2 dp), by avg clv desc."""
    if "clv_tier" not in df.columns:
        df = add_clv(df)
    return (
        df.filter(F.col("clv_tier").isNotNull())
        .groupBy("clv_tier")
        .agg(
            F.count("clv").alias("count"),
            rint_to(F.avg("clv"), 2).alias("avg_clv"),
            rint_to(F.sum("clv"), 2).alias("total_clv"),
            rint_to(F.avg("monthly_revenue"), 2).alias("avg_mrr"),
        )
        .orderBy(F.desc("avg_clv"), "clv_tier")
    )
