"""Attribution (M3-M10) for linear scores.

For a linear log-odds model ``z = b + sum w_i x_i`` the exact additive
attribution against a background mean is ``phi_i = w_i * (x_i - mean_i)``
(pure column arithmetic).  The background means are one aggregate row.  Per-customer top drivers are an in-row
``array_sort`` + ``slice`` over the feature structs: no shuffle, no window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import MODEL_FEATURES
from ..sources.mart import LOGIT_WEIGHTS

BASELINE_WEIGHTS = LOGIT_WEIGHTS
TOP_N = 5


def linear_attribution(df: DataFrame, weights: dict = BASELINE_WEIGHTS, background: DataFrame | None = None,
                       features: list[str] = MODEL_FEATURES) -> DataFrame:
    """M3: adds ``phi`` = array<struct<pos, feature, shap_value, feature_value>> in model feature order.

    The means of all weighted features are one aggregate row, read once.
    """
    bg = background if background is not None else df
    weighted = [f for f in features if weights.get(f)]
    row = bg.agg(F.struct(*[F.avg(F.col(f).cast("double")).alias(f) for f in weighted]).alias("m")) if weighted else None
    mean_row = row.scalar() if weighted else None
    means = {f: mean_row[f] for f in weighted}
    items = []
    for i, f in enumerate(features):
        x = F.coalesce(F.col(f).cast("double"), F.lit(0.0))
        w = weights.get(f, 0.0)
        phi = F.lit(w) * (x - means[f]) if w else F.lit(0.0)
        items.append(F.struct(F.lit(i).alias("pos"), F.lit(f).alias("feature"), phi.alias("shap_value"), x.alias("feature_value")))
    return df.withColumn("phi", F.array(*items))


def attributed(df: DataFrame, **kw) -> DataFrame:
    """``df`` with ``phi``: as it is if another attribution (M1) has given it, else by M3."""
    return df if "phi" in df.columns else linear_attribution(df, **kw)


def top_drivers(phi: Column, n: int = TOP_N) -> Column:
    """M4 / I4: top-n by |phi| desc; equal |phi| keep the reverse feature order (argsort reversed)."""
    ranked = F.array_sort(
        phi,
        lambda a, b: F.when(F.abs(a["shap_value"]) > F.abs(b["shap_value"]), -1)
        .when(F.abs(a["shap_value"]) < F.abs(b["shap_value"]), 1)
        .when(a["pos"] > b["pos"], -1)
        .when(a["pos"] < b["pos"], 1)
        .otherwise(0),
    )
    top = F.slice(ranked, 1, n)
    return F.transform(
        top,
        lambda d, i: F.struct(
            (i + 1).alias("rank"),
            d["feature"].alias("feature"),
            F.round(d["shap_value"], 4).alias("shap_value"),
            F.round(d["feature_value"], 4).alias("feature_value"),
            F.when(d["shap_value"] > 0, "increases").otherwise("decreases").alias("direction"),
        ),
    )


def explain(df: DataFrame, **kw) -> DataFrame:
    """M4: customer_id, p (4 dp), primary_driver, top_drivers array."""
    a = attributed(df, **kw)
    a = a.withColumn("top_drivers", top_drivers(F.col("phi")))
    return a.select(
        "customer_id",
        F.round("churn_probability", 4).alias("churn_probability"),
        F.col("top_drivers")[0]["feature"].alias("primary_driver"),
        "top_drivers",
    )


def _formatted(x: Column, pattern: str) -> Column:
    """A number by a decimal pattern: its exact value to the nearest, a tie to the even digit."""
    return F.call_function("format_number", x, F.lit(pattern))


def narrative(explained: DataFrame) -> DataFrame:
    """M5: text with the probability and one bullet per driver."""
    value = lambda d: _formatted(d["shap_value"], "+0.000;-0.000")
    bullets = F.array_join(
        F.transform(
            F.col("top_drivers"),
            lambda d: F.concat(F.lit("  • "), d["feature"], F.lit(" (SHAP="), value(d), F.lit(") — "), d["direction"], F.lit(" churn risk")),
        ),
        "\n",
    )
    percent = _formatted(F.col("churn_probability") * 100, "0")
    text = F.concat(
        F.lit("Customer "), F.col("customer_id"), F.lit(" has a "), percent, F.lit("% churn probability.\nTop drivers:\n"), bullets
    )
    return explained.select("customer_id", text.alias("narrative"))


def batch_explanations(df: DataFrame, threshold: float = 0.5, **kw) -> DataFrame:
    """M6: p >= threshold rows flattened to driver_k_feature / driver_k_shap."""
    e = explain(df.filter(F.col("churn_probability") >= threshold), **kw)
    cols = []
    for k in range(TOP_N):
        cols.append(F.col("top_drivers")[k]["feature"].alias(f"driver_{k + 1}_feature"))
        cols.append(F.col("top_drivers")[k]["shap_value"].alias(f"driver_{k + 1}_shap"))
    return e.select("customer_id", "churn_probability", "primary_driver", *cols)


def long_attribution(df: DataFrame, **kw) -> DataFrame:
    """Long table (customer_id, pos, feature, shap_value, feature_value)."""
    a = attributed(df, **kw)
    return a.select("customer_id", "churn_probability", F.inline("phi"))


def global_importance(df: DataFrame, **kw) -> DataFrame:
    """M7: mean |phi| per feature, descending (ties by position)."""
    return (
        long_attribution(df, **kw)
        .groupBy("pos", "feature")
        .agg(F.avg(F.abs("shap_value")).alias("mean_abs_shap"))
        .orderBy(F.desc("mean_abs_shap"), "pos")
        .select("feature", "mean_abs_shap")
    )


def above_median(importance: DataFrame) -> DataFrame:
    """M8: features whose importance exceeds the median importance (34 rows: exact median is tiny)."""
    med = importance.select(F.median("mean_abs_shap")).scalar()
    return importance.withColumn("above_median", F.col("mean_abs_shap") > med)


def dependence(df: DataFrame, features=("days_since_last_login", "support_sentiment"), **kw) -> DataFrame:
    """M9: (feature value, phi, p) for two features."""
    return long_attribution(df, **kw).filter(F.col("feature").isin(*features)).select(
        "customer_id", "feature", "feature_value", "shap_value", "churn_probability"
    )


# ---- fixed values: feature groups of the importance-by-group view ----
FEATURE_GROUPS = {
    "Engagement": ["engagement_decay_score", "velocity_30d_vs_90d", "sessions_30d", "login_frequency_change"],
    "Friction": ["friction_score", "ticket_count", "error_rate", "rage_click_count"],
    "Pricing": ["pricing_sensitivity_score", "billing_page_visits", "downgrade_page_visits"],
    "Growth": ["growth_pressure_score", "tier_capacity_utilization", "api_limit_usage"],
}


def importance_by_group(importance: DataFrame) -> DataFrame:
    """Join importance rows to the 4 feature groups (features in no group dropped), sum."""
    spark = importance.sparkSession
    groups = spark.createDataFrame(
        [(g, f) for g, fs in FEATURE_GROUPS.items() for f in fs], "feature_group string, feature string"
    )
    # the group table is configuration (a few dozen rows): broadcast
    return importance.join(F.broadcast(groups), "feature").groupBy("feature_group").agg(
        F.sum("mean_abs_shap").alias("importance")
    )
