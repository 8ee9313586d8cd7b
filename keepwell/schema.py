"""Fixed schema of the wide customer table and the model feature lists.

Feature names and their order are fixed values: attribution and the model
vector depend on the order (base features first, then engineered ones).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# ---- fixed values: input columns of the customer table (27 incl. label) ----
CUSTOMER_FIELDS = [
    ("customer_id", T.StringType(), False),
    ("subscription_type", T.StringType(), True),
    ("monthly_revenue", T.DoubleType(), True),
    ("tenure_months", T.IntegerType(), True),
    ("country", T.StringType(), True),
    ("industry", T.StringType(), True),
    ("sessions_30d", T.IntegerType(), True),
    ("sessions_90d", T.IntegerType(), True),
    ("days_since_last_login", T.IntegerType(), True),
    ("days_since_last_core_action", T.IntegerType(), True),
    ("login_frequency_change", T.DoubleType(), True),
    ("session_duration_change", T.DoubleType(), True),
    ("ticket_count", T.IntegerType(), True),
    ("support_sentiment", T.DoubleType(), True),
    ("error_rate", T.DoubleType(), True),
    ("failed_api_calls", T.IntegerType(), True),
    ("rage_click_count", T.IntegerType(), True),
    ("billing_page_visits", T.IntegerType(), True),
    ("downgrade_page_visits", T.IntegerType(), True),
    ("invoice_download_frequency", T.IntegerType(), True),
    ("trial_expiry_days", T.IntegerType(), True),
    ("tier_capacity_utilization", T.DoubleType(), True),
    ("export_frequency", T.IntegerType(), True),
    ("api_usage", T.IntegerType(), True),
    ("api_limit_usage", T.DoubleType(), True),
    ("seat_limit_usage", T.DoubleType(), True),
    ("churned", T.IntegerType(), True),
]

CUSTOMER_SCHEMA = T.StructType([T.StructField(n, t, nullable) for n, t, nullable in CUSTOMER_FIELDS])
CUSTOMER_SCHEMA_NO_LABEL = T.StructType([f for f in CUSTOMER_SCHEMA.fields if f.name != "churned"])
REQUIRED_COLUMNS = [n for n, _, _ in CUSTOMER_FIELDS]

# ---- fixed values: model feature lists, in model order ----
BASE_FEATURES = [
    "sessions_30d",
    "sessions_90d",
    "days_since_last_login",
    "days_since_last_core_action",
    "login_frequency_change",
    "session_duration_change",
    "ticket_count",
    "support_sentiment",
    "error_rate",
    "failed_api_calls",
    "rage_click_count",
    "billing_page_visits",
    "downgrade_page_visits",
    "invoice_download_frequency",
    "tier_capacity_utilization",
    "export_frequency",
    "api_usage",
    "api_limit_usage",
    "seat_limit_usage",
    "tenure_months",
    "monthly_revenue",
]

ENGINEERED_FEATURES = [
    "velocity_30d_vs_90d",
    "engagement_decay_score",
    "friction_score",
    "pricing_sensitivity_score",
    "growth_pressure_score",
    "customer_health_score",
    "retention_risk_score",
    "support_ticket_sentiment",
    "ticket_density_30d",
    "subscription_tier",
    "tenure_bucket",
    "log_api_usage",
    "log_monthly_revenue",
]

MODEL_FEATURES = BASE_FEATURES + ENGINEERED_FEATURES

# ---- fixed values: the 15 columns the data-validation expectations require ----
EXPECTED_COLUMNS = [
    "customer_id",
    "subscription_type",
    "monthly_revenue",
    "tenure_months",
    "country",
    "industry",
    "sessions_30d",
    "sessions_90d",
    "days_since_last_login",
    "ticket_count",
    "support_sentiment",
    "billing_page_visits",
    "downgrade_page_visits",
    "tier_capacity_utilization",
    "churned",
]


class SchemaError(ValueError):
    pass


def missing_columns(df: DataFrame, require_label: bool = True, required=None) -> list[str]:
    req = list(required or REQUIRED_COLUMNS)
    if not require_label:
        req = [c for c in req if c != "churned"]
    have = set(df.columns)
    return [c for c in req if c not in have]


def validate_schema(df: DataFrame, require_label: bool = True, required=None) -> DataFrame:
    """Plan-time check: raise listing every missing column; label optional when scoring."""
    miss = missing_columns(df, require_label, required)
    if miss:
        raise SchemaError(f"missing required columns: {miss}")
    return df
