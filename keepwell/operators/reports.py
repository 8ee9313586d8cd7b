"""Report aggregates (F1-F32, F34), top-k lists (I2, I3, I5, I6) and the
executive report dataset (N1).

All aggregates are single ``groupBy``/``agg`` passes with map-side partial
aggregation, so a hot key (one archetype holding a third of the rows) costs
one partial row per task.  Null keys are dropped before grouping (pandas
semantics).  Medians use the distributed order statistics of
``keepwell.operators.ordered`` instead of a per-group value buffer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import rint_to, safe_div
from .archetypes import ARCHETYPE_NAME, name_of
from .value import CLV_TIER_ORDER

SCORE_COLUMNS_6 = [
    "engagement_decay_score",
    "friction_score",
    "pricing_sensitivity_score",
    "growth_pressure_score",
    "customer_health_score",
    "retention_risk_score",
]
PROFILE_METRICS = [
    "churn_probability",
    "monthly_revenue",
    "tenure_months",
    "engagement_decay_score",
    "friction_score",
    "pricing_sensitivity_score",
    "growth_pressure_score",
    "customer_health_score",
    "clv",
]
RADAR_SCORES = [
    "engagement_decay_score",
    "friction_score",
    "pricing_sensitivity_score",
    "growth_pressure_score",
    "retention_risk_score",
]
ARCHETYPE_SIGNAL = {
    "A": "engagement_decay_score",
    "B": "friction_score",
    "C": "pricing_sensitivity_score",
    "D": "growth_pressure_score",
}


def _nn(df: DataFrame, *keys: str) -> DataFrame:
    cond = None
    for k in keys:
        c = F.col(k).isNotNull()
        cond = c if cond is None else cond & c
    return df.filter(cond) if cond is not None else df


def archetype_counts(df: DataFrame) -> DataFrame:
    """archetype value counts, descending."""
    return (
        _nn(df, "churn_archetype")
        .groupBy(F.col("churn_archetype").alias("archetype"))
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), "archetype")
    )


def report_kpis(df: DataFrame) -> DataFrame:
    """n, saved, mean p, cost, net = saved*.70 - cost*1.20, roi = net/max(cost,1)*100."""
    k = df.agg(
        F.count(F.lit(1)).alias("customers"),
        F.coalesce(F.sum("expected_revenue_saved"), F.lit(0.0)).alias("total_revenue_saved"),
        F.avg("churn_probability").alias("avg_churn_probability"),
        F.coalesce(F.sum("action_cost_usd"), F.lit(0.0)).alias("total_cost"),
    )
    k = k.withColumn("net_profit", F.col("total_revenue_saved") * 0.70 - F.col("total_cost") * 1.20)
    return k.withColumn("report_roi_pct", F.col("net_profit") / F.greatest(F.col("total_cost"), F.lit(1.0)) * 100)


def mode_of(col: str) -> Column:
    """Most frequent value, ties -> smallest (pandas ``mode()[0]``)."""
    return F.mode(col, True)


def report_archetypes(df: DataFrame) -> DataFrame:
    """per archetype customers, mean p, sum saved, most common action."""
    return (
        _nn(df, "churn_archetype")
        .groupBy("churn_archetype")
        .agg(
            F.count(F.lit(1)).alias("customers"),
            F.avg("churn_probability").alias("avg_churn_probability"),
            F.sum("expected_revenue_saved").alias("revenue_saved"),
            mode_of("action").alias("top_action"),
        )
        .withColumn("archetype_name", F.coalesce(name_of(F.col("churn_archetype")), F.col("churn_archetype")))
    )


def urgency_share(df: DataFrame) -> DataFrame:
    """count and % of all rows per urgency (total as a scalar subquery, no global window)."""
    total = df.select(F.count(F.lit(1))).scalar()
    return (
        _nn(df, "urgency")
        .groupBy("urgency")
        .agg(F.count(F.lit(1)).alias("count"))
        .withColumn("pct_of_total", F.col("count") / total * 100)
    )


def action_summary(df: DataFrame) -> DataFrame:
    """per action count, sum saved, mean conversion (3 dp), by saved desc."""
    return (
        _nn(df, "action")
        .groupBy("action")
        .agg(
            F.count(F.lit(1)).alias("count"),
            rint_to(F.sum("expected_revenue_saved"), 3).alias("total_rev_saved"),
            rint_to(F.avg("expected_conversion_rate"), 3).alias("avg_conversion"),
        )
        .orderBy(F.desc("total_rev_saved"), "action")
    )


def kpi_row(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """F13 (+C4): one pass of conditional aggregates over all scored customers."""
    hr = F.col("churn_probability") >= threshold
    return df.agg(
        F.count(F.lit(1)).alias("customers"),
        F.count_if(hr).alias("high_risk_customers"),
        (F.count_if(hr) / F.count(F.lit(1))).alias("high_risk_share"),
        F.avg("churn_probability").alias("avg_churn_probability"),
        F.sum(F.when(hr, F.col("expected_revenue_saved"))).alias("revenue_saved"),
        F.avg(F.when(hr, F.col("campaign_roi"))).alias("avg_campaign_roi"),
        F.sum(F.when(hr, F.col("action_cost_usd"))).alias("campaign_cost"),
    )


def mrr_by_clv_tier(df: DataFrame) -> DataFrame:
    """F14."""
    return _nn(df, "clv_tier").groupBy("clv_tier").agg(F.sum("monthly_revenue").alias("monthly_revenue"))


def probability_histogram(df: DataFrame, bins: int = 50, col: str = "churn_probability") -> DataFrame:
    """fixed equal-width bins on [0, 1], last bin closed."""
    b = F.least(F.lit(bins), F.floor(F.col(col) * bins) + 1).cast("int")
    return _nn(df, col).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))


def archetype_action_summary(df: DataFrame) -> DataFrame:
    """F16."""
    return (
        _nn(df, "churn_archetype", "action")
        .groupBy("churn_archetype", "action")
        .agg(F.count(F.lit(1)).alias("count"), F.sum("expected_revenue_saved").alias("revenue_saved"))
        .orderBy(F.desc("count"), "churn_archetype", "action")
    )


def urgency_counts(df: DataFrame) -> DataFrame:
    """F17."""
    return _nn(df, "urgency").groupBy("urgency").agg(F.count(F.lit(1)).alias("count"))


def churn_rate_by_subscription(df: DataFrame) -> DataFrame:
    """mean label per subscription type, descending."""
    return (
        _nn(df, "subscription_type")
        .groupBy("subscription_type")
        .agg(F.avg("churned").alias("churn_rate"))
        .orderBy(F.desc("churn_rate"), "subscription_type")
    )


def equal_width_histogram(df: DataFrame, col: str, bins: int, by: list[str] | None = None) -> DataFrame:
    """np.histogram-style bins between the column's min and max (last bin closed).

    min/max are scalar subqueries (one small extra pass), not a join.
    """
    by = by or []
    stats = df.select(F.min(col).alias("mn"), F.max(col).alias("mx"))
    mn = stats.select("mn").scalar()
    mx = stats.select("mx").scalar()
    width = F.when(mx > mn, F.lit(float(bins)) / (mx - mn))
    idx = F.when(width.isNull(), F.lit(1)).otherwise(
        F.least(F.lit(bins), F.floor((F.col(col) - mn) * width) + 1)
    ).cast("int")
    return _nn(df, col).groupBy(*by, idx.alias("bin")).agg(F.count(F.lit(1)).alias("count"))


def label_correlations(df: DataFrame, cols=SCORE_COLUMNS_6, label: str = "churned") -> DataFrame:
    """Pearson of each score with the label, one ``agg``, unpivoted, sorted ascending."""
    row = df.agg(*[F.corr(F.col(c), F.col(label).cast("double")).alias(c) for c in cols])
    stacked = row.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("correlation")) for c in cols]))
    )
    return stacked.orderBy("correlation", "feature")


def mean_mrr_by_archetype(df: DataFrame) -> DataFrame:
    """F22."""
    return (
        _nn(df, "churn_archetype")
        .groupBy("churn_archetype")
        .agg(rint_to(F.avg("monthly_revenue"), 2).alias("avg_monthly_revenue"))
    )


def archetype_probability_and_scores(df: DataFrame) -> DataFrame:
    """mean p and count, plus the mean of the 4 archetype signals (3 dp)."""
    return (
        _nn(df, "churn_archetype")
        .groupBy("churn_archetype")
        .agg(
            rint_to(F.avg("churn_probability"), 3).alias("mean_churn_probability"),
            F.count(F.lit(1)).alias("count"),
            *[rint_to(F.avg(c), 3).alias(c) for c in SCORE_COLUMNS_6[:4]],
        )
    )


def archetype_profile(df: DataFrame, metrics=PROFILE_METRICS) -> DataFrame:
    """mean and exact median of 9 metrics per archetype (3 dp), long form.

    Medians come from the distributed order statistics (no per-group buffer).
    """
    from .ordered import grouped_quantile

    long = _nn(df, "churn_archetype").select(
        "churn_archetype",
        F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])),
    )
    long = long.filter(F.col("value").isNotNull())
    means = long.groupBy("churn_archetype", "metric").agg(rint_to(F.avg("value"), 3).alias("mean"))
    med = grouped_quantile(long, ["churn_archetype", "metric"], "value", 0.5, "median")
    return means.join(med.withColumn("median", rint_to(F.col("median"), 3)), ["churn_archetype", "metric"])


def archetype_radar(df: DataFrame) -> DataFrame:
    """mean of 5 scores per archetype."""
    return _nn(df, "churn_archetype").groupBy("churn_archetype").agg(*[F.avg(c).alias(c) for c in RADAR_SCORES])


def archetype_tier_pivot(df: DataFrame) -> DataFrame:
    """sum saved per archetype x CLV tier, missing -> 0, tiers Enterprise..Low (pivot values given)."""
    return (
        _nn(df, "churn_archetype")
        .groupBy("churn_archetype")
        .pivot("clv_tier", CLV_TIER_ORDER)
        .agg(F.sum("expected_revenue_saved"))
        .na.fill(0.0, CLV_TIER_ORDER)
    )


def action_share_in_archetype(df: DataFrame) -> DataFrame:
    """action counts as % of the archetype (group totals joined back, not a per-group window)."""
    c = _nn(df, "churn_archetype", "action").groupBy("churn_archetype", "action").agg(F.count(F.lit(1)).alias("count"))
    tot = c.groupBy("churn_archetype").agg(F.sum("count").alias("total"))
    return c.join(tot, "churn_archetype").select(
        "churn_archetype", "action", "count", (F.col("count") / F.col("total") * 100).alias("pct")
    )


def archetype_summary(df: DataFrame) -> DataFrame:
    """customers, means, sums and mode(action) per archetype (2 dp)."""
    return (
        _nn(df, "churn_archetype")
        .groupBy("churn_archetype")
        .agg(
            F.count("customer_id").alias("customers"),
            rint_to(F.avg("churn_probability"), 2).alias("avg_churn_prob"),
            rint_to(F.avg("monthly_revenue"), 2).alias("avg_mrr"),
            rint_to(F.sum("monthly_revenue"), 2).alias("total_mrr"),
            rint_to(F.avg("clv"), 2).alias("avg_clv"),
            rint_to(F.sum("expected_revenue_saved"), 2).alias("total_rev_saved"),
            rint_to(F.avg("expected_conversion_rate"), 2).alias("avg_conversion"),
            mode_of("action").alias("top_action"),
        )
        .withColumn("archetype_name", name_of(F.col("churn_archetype")))
    )


def archetype_density(df: DataFrame, bins: int = 50) -> DataFrame:
    """normalised 50-bin histogram on [0,1] of the 4 signal features per archetype."""
    feats = list(ARCHETYPE_SIGNAL.values())
    long = _nn(df, "churn_archetype").select(
        "churn_archetype",
        F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("value")) for f in feats])),
    ).filter(F.col("value").isNotNull())
    b = F.least(F.lit(bins), F.floor(F.col("value") * bins) + 1).cast("int")
    c = long.groupBy("churn_archetype", "feature", b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    tot = c.groupBy("churn_archetype", "feature").agg(F.sum("count").alias("n"))
    return c.join(tot, ["churn_archetype", "feature"]).select(
        "churn_archetype", "feature", "bin", "count", (F.col("count") / F.col("n") * bins).alias("density")
    )


def revenue_correlation(df: DataFrame) -> DataFrame:
    """F32: Pearson of monthly_revenue vs expected_revenue_saved."""
    return df.agg(F.corr("monthly_revenue", "expected_revenue_saved").alias("correlation"))


def high_risk_share(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """rows with p >= threshold, and their share of all."""
    hr = F.col("churn_probability") >= threshold
    return df.agg(
        F.count_if(hr).alias("high_risk_customers"),
        F.avg(hr.cast("int")).alias("high_risk_share"),
    )


def executive_summary(scored: DataFrame, decided: DataFrame) -> DataFrame:
    """(metric, value) rows from the impact totals plus two argmax picks."""
    from .impact import impact_totals

    t = impact_totals(decided)
    n_all = scored.select(F.count(F.lit(1))).scalar()
    top_arch = (
        _nn(decided, "churn_archetype")
        .groupBy("churn_archetype")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "churn_archetype")
        .limit(1)
        .select("churn_archetype")
    ).scalar()
    top_action = (
        _nn(decided, "action")
        .groupBy("action")
        .agg(F.sum("revenue_saved").alias("s"))
        .orderBy(F.desc("s"), "action")
        .limit(1)
        .select("action")
    ).scalar()
    num = lambda c: c.cast("double")
    none = F.lit(None).cast("string")
    kv = [
        ("Total Customers Analysed", num(n_all), none),
        ("High-Risk Customers", num(F.col("total_at_risk_users")), none),
        ("High-Risk Share %", F.col("total_at_risk_users") / n_all * 100, none),
        ("Annual MRR at Risk", F.col("total_at_risk_mrr") * 12, none),
        ("Expected Customers Retained", F.col("expected_users_retained"), none),
        ("Expected Revenue Saved (12mo)", F.col("expected_revenue_saved"), none),
        ("Total Campaign Cost", F.col("total_campaign_cost"), none),
        ("Net Incremental Profit", F.col("net_incremental_profit"), none),
        ("Campaign ROI %", F.col("roi_pct"), none),
        ("Payback Period (months)", F.col("payback_months"), none),
        ("Most Common Archetype", F.lit(None).cast("double"), top_arch),
        ("Highest-Revenue Action", F.lit(None).cast("double"), top_action),
    ]
    return t.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(i + 1).alias("pos"), F.lit(k).alias("metric"), v.alias("value"), txt.alias("value_text")
                    )
                    for i, (k, v, txt) in enumerate(kv)
                ]
            )
        )
    )


# ------------------------------------------------------------------ top-k


def top_by_saved(df: DataFrame, n: int = 10) -> DataFrame:
    """Largest n by expected_revenue_saved (TakeOrdered: per-task top-n, no full sort)."""
    if "expected_revenue_saved" not in df.columns:
        return df.orderBy("customer_id").limit(n)
    return df.orderBy(F.desc("expected_revenue_saved"), "customer_id").limit(n)


def priority_queue(df: DataFrame, n: int = 100) -> DataFrame:
    """First n by saved desc."""
    return top_by_saved(df, n).select(
        "customer_id", "archetype_name", "action", "urgency", "expected_revenue_saved", "clv_tier"
    )


def explorer(df: DataFrame, min_prob: float, archetypes: list[str], urgencies: list[str], limit: int = 200) -> DataFrame:
    """Probability >= x AND archetype IN AND urgency IN (skipped when absent), top ``limit``."""
    cond = (F.col("churn_probability") >= min_prob) & F.col("churn_archetype").isin(*archetypes)
    if "urgency" in df.columns:
        cond = cond & F.col("urgency").isin(*urgencies)
    cols = [
        c
        for c in [
            "customer_id", "subscription_type", "monthly_revenue", "tenure_months", "churn_probability",
            "churn_archetype", "archetype_name", "action", "urgency", "expected_revenue_saved", "clv_tier",
        ]
        if c in df.columns
    ]
    return df.filter(cond).orderBy(F.desc("churn_probability"), "customer_id").limit(limit).select(*cols)
