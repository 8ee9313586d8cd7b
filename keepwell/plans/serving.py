"""Serving-shaped projections of the batch plan.

The per-request calls of an online service become projections of the same
batch plan over a table of customers; ``keepwell.streaming`` runs the same
functions on a stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import col_or


def recommendation_record(decided: DataFrame) -> DataFrame:
    """One row per customer with archetype, driver, action and value (p rounded to 4 dp)."""
    return decided.select(
        "customer_id",
        F.round("churn_probability", 4).alias("churn_probability"),
        F.coalesce(col_or(decided, "churn_archetype", "A"), F.lit("A")).alias("churn_archetype"),
        F.coalesce(col_or(decided, "archetype_name", "Unknown"), F.lit("Unknown")).alias("archetype_name"),
        F.coalesce(col_or(decided, "primary_driver", "engagement_decay_score"), F.lit("engagement_decay_score")).alias(
            "primary_driver"
        ),
        F.col("action").alias("recommended_action"),
        "channel",
        "urgency",
        "expected_conversion_rate",
        "expected_revenue_saved",
        "clv",
        "clv_tier",
    )


def batch_prediction(scored: DataFrame) -> DataFrame:
    """Id, p (4 dp), risk level, plus the batch size as a scalar subquery (no global window)."""
    n = scored.select(F.count(F.lit(1))).scalar()
    return scored.select(
        "customer_id",
        F.round("churn_probability", 4).alias("churn_probability"),
        "churn_risk_level",
        n.alias("count"),
    )
