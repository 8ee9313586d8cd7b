"""Engineered features (B1-B13) as pure Column expressions.

Every feature is one Catalyst expression over the input columns; ``engineer``
adds all 13 in one projection (a narrow, codegen'd stage, no shuffle).
Composite scores are built from columns computed one ``select`` level earlier,
which keeps the expression trees small instead of inlining B2-B5 into B6/B7.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import clip, neg
from ..schema import ENGINEERED_FEATURES

# ---- fixed values: subscription ordinal codes and tenure bin edges ----
SUBSCRIPTION_ORDER = {"Starter": 0, "Professional": 1, "Business": 2, "Enterprise": 3}
TENURE_EDGES = (0, 3, 12, 24, 84)  # right-closed bins (0,3] (3,12] (12,24] (24,84] -> 0..3


def velocity(c=F.col) -> Column:
    s90 = c("sessions_90d")
    raw = F.when(s90 > 0, c("sessions_30d") / (s90 / 3 + F.lit(1e-6))).otherwise(F.lit(0.0))
    return clip(raw, 0.0, 5.0)


def engagement_decay(c=F.col) -> Column:
    return clip(
        F.lit(0.35) * (c("days_since_last_login") / 90)
        + F.lit(0.35) * (c("days_since_last_core_action") / 90)
        + F.lit(0.15) * (1 - clip(c("velocity_30d_vs_90d")))
        + F.lit(0.15) * neg(c("login_frequency_change"))
    )


def friction(c=F.col) -> Column:
    return clip(
        F.lit(0.30) * clip(c("ticket_count") / 20)
        + F.lit(0.25) * c("error_rate")
        + F.lit(0.20) * clip(c("failed_api_calls") / 50)
        + F.lit(0.15) * clip(c("rage_click_count") / 30)
        + F.lit(0.10) * neg(c("support_sentiment"))
    )


def pricing_sensitivity(c=F.col) -> Column:
    trial = c("trial_expiry_days")
    trial_term = F.when(trial >= 0, (14 - clip(trial, 0.0, 14.0)) / 14).otherwise(F.lit(0.0))
    return clip(
        F.lit(0.35) * clip(c("billing_page_visits") / 20)
        + F.lit(0.35) * clip(c("downgrade_page_visits") / 10)
        + F.lit(0.20) * clip(c("invoice_download_frequency") / 12)
        + F.lit(0.10) * trial_term
    )


def growth_pressure(c=F.col) -> Column:
    return clip(
        F.lit(0.35) * c("tier_capacity_utilization")
        + F.lit(0.25) * c("api_limit_usage")
        + F.lit(0.25) * c("seat_limit_usage")
        + F.lit(0.15) * clip(c("export_frequency") / 40)
    )


def customer_health(c=F.col) -> Column:
    return clip(
        F.lit(0.30) * (1 - c("engagement_decay_score"))
        + F.lit(0.25) * (1 - c("friction_score"))
        + F.lit(0.25) * (1 - c("pricing_sensitivity_score"))
        + F.lit(0.20) * clip(c("sessions_30d") / 120)
    )


def retention_risk(c=F.col) -> Column:
    return clip(
        F.lit(0.30) * c("engagement_decay_score")
        + F.lit(0.25) * c("friction_score")
        + F.lit(0.25) * c("pricing_sensitivity_score")
        + F.lit(0.20) * (1 - c("customer_health_score"))
    )


def subscription_tier(c=F.col) -> Column:
    m = F.create_map(*[x for k, v in SUBSCRIPTION_ORDER.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(m, c("subscription_type")), F.lit(0)).cast("int")


def tenure_bucket(c=F.col, strict: bool = False) -> Column:
    t = c("tenure_months")
    e = TENURE_EDGES
    out = F.when((t > e[0]) & (t <= e[1]), 0)
    for i in range(1, len(e) - 1):
        out = out.when((t > e[i]) & (t <= e[i + 1]), i)
    if strict:
        out = out.otherwise(F.raise_error(F.lit("tenure_months outside the tenure bins (0, 84]")))
    return out.cast("int")


def engineer(df: DataFrame, strict_tenure: bool = False) -> DataFrame:
    """Append the 13 engineered features; all input columns kept, row count unchanged."""
    df = df.withColumn("velocity_30d_vs_90d", velocity())
    df = df.withColumns(
        {
            "engagement_decay_score": engagement_decay(),
            "friction_score": friction(),
            "pricing_sensitivity_score": pricing_sensitivity(),
            "growth_pressure_score": growth_pressure(),
        }
    )
    df = df.withColumn("customer_health_score", customer_health())
    return df.withColumns(
        {
            "retention_risk_score": retention_risk(),
            "support_ticket_sentiment": F.col("support_sentiment"),
            "ticket_density_30d": F.col("ticket_count"),
            "subscription_tier": subscription_tier(),
            "tenure_bucket": tenure_bucket(strict=strict_tenure),
            "log_api_usage": F.log1p(F.col("api_usage")),
            "log_monthly_revenue": F.log1p(F.col("monthly_revenue")),
        }
    )


class FeatureEngineer(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Spark ML transformer wrapping :func:`engineer` (B13) so it can sit in a Pipeline."""

    @keyword_only
    def __init__(self):
        super().__init__()

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return engineer(dataset)

    @staticmethod
    def output_columns() -> list[str]:
        return list(ENGINEERED_FEATURES)
