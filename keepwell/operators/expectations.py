"""Table expectations (L1-L16) as ONE aggregation pass.

Returns ``(check, passed, observed)`` rows.  Every statistic is an aggregate
of the same scan; the result is stacked in-row (no union of 16 scans).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import EXPECTED_COLUMNS

# ---- fixed values: expectation bounds ----
SUBSCRIPTION_TYPES = ("Starter", "Professional", "Business", "Enterprise")
CHURN_RATE_RANGE = (0.05, 0.45)
MIN_ROWS = 100
MIN_DISTINCT = 5


def _bad(cond) -> F.Column:
    """Rows where ``cond`` is not true (null counts as a failure, like NaN comparisons)."""
    return F.count_if(~F.coalesce(cond, F.lit(False)))


def expectations(df: DataFrame) -> DataFrame:
    missing = [c for c in EXPECTED_COLUMNS if c not in df.columns]
    if missing:
        return df.sparkSession.createDataFrame(
            [("L01_required_columns", False, float(len(missing)))], "check string, passed boolean, observed double"
        )
    c = F.col
    stats = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("customer_id").alias("ids"),
        F.count("customer_id").alias("id_nonnull"),
        _bad(c("churned").isin(0, 1)).alias("bad_label"),
        F.avg("churned").alias("churn_rate"),
        _bad(c("monthly_revenue") > 0).alias("bad_mrr"),
        _bad(c("tenure_months") >= 1).alias("bad_tenure"),
        _bad(c("subscription_type").isin(*SUBSCRIPTION_TYPES)).alias("bad_sub"),
        _bad(c("support_sentiment").between(-1, 1)).alias("bad_sentiment"),
        F.count_if(c("customer_id").isNull() | c("monthly_revenue").isNull() | c("churned").isNull()).alias("nulls"),
        _bad((c("sessions_30d") >= 0) & (c("sessions_90d") >= 0)).alias("bad_sessions"),
        _bad(c("tier_capacity_utilization").between(0, 1)).alias("bad_capacity"),
        F.avg(F.when(c("subscription_type") == "Starter", c("monthly_revenue"))).alias("starter_mrr"),
        F.avg(F.when(c("subscription_type") == "Enterprise", c("monthly_revenue"))).alias("enterprise_mrr"),
        F.count_distinct("country").alias("countries"),
        F.count_distinct("industry").alias("industries"),
    )
    d = F.col
    checks = [
        ("L01_required_columns", F.lit(True), F.lit(0.0)),
        # pandas nunique ignores nulls and len counts them, so any null id fails as well
        ("L02_customer_id_unique", d("ids") == d("rows"), (d("rows") - d("ids")).cast("double")),
        ("L03_label_binary", d("bad_label") == 0, d("bad_label").cast("double")),
        (
            "L04_churn_rate_in_range",
            d("churn_rate").between(CHURN_RATE_RANGE[0], CHURN_RATE_RANGE[1]),
            d("churn_rate"),
        ),
        ("L05_mrr_positive", d("bad_mrr") == 0, d("bad_mrr").cast("double")),
        ("L06_tenure_at_least_1", d("bad_tenure") == 0, d("bad_tenure").cast("double")),
        ("L07_subscription_types_valid", d("bad_sub") == 0, d("bad_sub").cast("double")),
        ("L08_sentiment_in_range", d("bad_sentiment") == 0, d("bad_sentiment").cast("double")),
        ("L09_no_null_critical", d("nulls") == 0, d("nulls").cast("double")),
        ("L10_sessions_non_negative", d("bad_sessions") == 0, d("bad_sessions").cast("double")),
        ("L11_capacity_in_range", d("bad_capacity") == 0, d("bad_capacity").cast("double")),
        ("L12_enough_rows", d("rows") >= MIN_ROWS, d("rows").cast("double")),
        ("L13_label_minority", d("churn_rate") < 0.5, d("churn_rate")),
        ("L14_starter_below_enterprise_mrr", d("starter_mrr") < d("enterprise_mrr"), d("enterprise_mrr") - d("starter_mrr")),
        ("L15_countries", d("countries") >= MIN_DISTINCT, d("countries").cast("double")),
        ("L16_industries", d("industries") >= MIN_DISTINCT, d("industries").cast("double")),
    ]
    return stats.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(name).alias("check"),
                        F.coalesce(cond, F.lit(False)).alias("passed"),
                        obs.cast("double").alias("observed"),
                    )
                    for name, cond, obs in checks
                ]
            )
        )
    )
