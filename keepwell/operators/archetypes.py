"""Behavioural archetypes (E1-E8) and the archetype dimension.

Scores are clipped then rounded half-even to 4 dp *before* the argmax; the
argmax is an explicit ``when`` chain so ties go to the first of A, B, C, D.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import clip, col_or, neg, rint_to

# ---- fixed values: archetype dictionary (code, name, description, psychology, color) ----
ARCHETYPES = [
    ("A", "The Ghost", "Lost momentum and engagement — quietly drifting away.",
     "User lost momentum and engagement.", "#6c757d"),
    ("B", "Frustrated Professional", "Experiencing product friction and support issues.",
     "Product friction and support issues driving frustration.", "#dc3545"),
    ("C", "Price-Sensitive Optimizer", "Concerned about cost — actively evaluating alternatives.",
     "Concerned about pricing and ROI justification.", "#fd7e14"),
    ("D", "Outgrown User", "Hitting plan limits — ready for the next tier.",
     "Needs a larger plan but hasn't upgraded yet.", "#198754"),
]
ARCHETYPE_NAME = {a[0]: a[1] for a in ARCHETYPES}
SCORE_COLUMNS = ["score_ghost", "score_frustrated", "score_price_sensitive", "score_outgrown"]
CODES = ["A", "B", "C", "D"]

ARCHETYPE_DIM_SCHEMA = T.StructType(
    [
        T.StructField("archetype_id", T.IntegerType(), False),
        T.StructField("archetype_code", T.StringType(), False),
        T.StructField("archetype_name", T.StringType(), False),
        T.StructField("description", T.StringType(), False),
        T.StructField("psychology", T.StringType(), False),
        T.StructField("color_hex", T.StringType(), False),
    ]
)


def archetype_dim(spark: SparkSession) -> DataFrame:
    """4-row literal dimension (size fixed by construction, safe to broadcast)."""
    rows = [(i + 1, *a) for i, a in enumerate(ARCHETYPES)]
    return spark.createDataFrame(rows, ARCHETYPE_DIM_SCHEMA)


def name_of(code: Column) -> Column:
    m = F.create_map(*[x for k, v in ARCHETYPE_NAME.items() for x in (F.lit(k), F.lit(v))])
    return F.try_element_at(m, code)


def archetype_scores(df: DataFrame) -> dict[str, Column]:
    g = lambda name, d=0.0: col_or(df, name, d)
    ghost = (
        F.lit(0.40) * clip(g("engagement_decay_score"))
        + F.lit(0.25) * clip(g("days_since_last_login") / 90)
        + F.lit(0.20) * (1 - clip(g("velocity_30d_vs_90d", 1.0)))
        + F.lit(0.15) * neg(g("login_frequency_change"))
    )
    frustrated = (
        F.lit(0.35) * clip(g("friction_score"))
        + F.lit(0.25) * clip(g("ticket_count") / 20)
        + F.lit(0.20) * clip(g("error_rate"))
        + F.lit(0.20) * neg(g("support_sentiment"))
    )
    price = (
        F.lit(0.40) * clip(g("pricing_sensitivity_score"))
        + F.lit(0.30) * clip(g("billing_page_visits") / 20)
        + F.lit(0.30) * clip(g("downgrade_page_visits") / 10)
    )
    outgrown = (
        F.lit(0.40) * clip(g("growth_pressure_score"))
        + F.lit(0.30) * clip(g("tier_capacity_utilization"))
        + F.lit(0.30) * clip(g("api_limit_usage"))
    )
    return {
        "score_ghost": rint_to(clip(ghost), 4),
        "score_frustrated": rint_to(clip(frustrated), 4),
        "score_price_sensitive": rint_to(clip(price), 4),
        "score_outgrown": rint_to(clip(outgrown), 4),
    }


def classify(df: DataFrame) -> DataFrame:
    """Append the 4 scores, churn_archetype, archetype_confidence, archetype_name."""
    df = df.withColumns(archetype_scores(df))
    s = [F.col(c) for c in SCORE_COLUMNS]
    top = F.greatest(*s)
    arch = F.when(s[0] == top, "A").when(s[1] == top, "B").when(s[2] == top, "C").when(s[3] == top, "D")
    df = df.withColumns({"churn_archetype": arch, "archetype_confidence": rint_to(top, 4)})
    return df.withColumn("archetype_name", name_of(F.col("churn_archetype")))


def distribution(df: DataFrame) -> DataFrame:
    """count, mean p, mean mrr and name per archetype (classifies first when needed)."""
    if "churn_archetype" not in df.columns:
        df = classify(df)
    return (
        df.filter(F.col("churn_archetype").isNotNull())
        .groupBy("churn_archetype")
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.avg("churn_probability").alias("avg_churn_prob"),
            F.avg("monthly_revenue").alias("avg_monthly_revenue"),
        )
        .withColumn("archetype_name", name_of(F.col("churn_archetype")))
    )
