"""BI star schema (G1-G5) and its measures (G6-G14) in one aggregate pass.

The fact table is the decided (high-risk) customer table keyed by dimension
ids; dimensions are literal/config tables (4 archetypes, 13 actions) or
derived from the data (customers, dates).  The surrogate prediction id is a
hash of (customer_id, date_id): no global ``row_number`` (a single-task
window) is needed at scale.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.archetypes import archetype_dim
from ..operators.rules import load_rules, rules_frame
from ..operators.value import CLV_TIER_ORDER
from .batch import Stages


def run_date(stages: Stages):
    """Prediction date: the reference day of the data (latest order date), as a scalar subquery."""
    return stages.tables.orders.select(F.max(F.to_date("o_orderdate"))).scalar()


def dim_actions(spark: SparkSession) -> DataFrame:
    """12 rules + fallback, dense id by action code (13 config rows: the window is bounded)."""
    r = rules_frame(spark, load_rules())
    return r.select(
        F.dense_rank().over(Window.orderBy("action_code")).cast("int").alias("action_id"),
        "action_code",
        F.col("action").alias("action_name"),
        "channel",
        "urgency",
        "expected_conversion_rate",
        F.col("action_cost_usd").alias("base_cost_usd"),
    )


def dim_customers(decided: DataFrame) -> DataFrame:
    """G2."""
    return decided.select(
        "customer_id", "subscription_type", "monthly_revenue", "tenure_months", "country", "industry", "clv_tier"
    ).distinct()


def dim_date(stages: Stages) -> DataFrame:
    """One row per calendar day between the first and last order date."""
    o = stages.tables.orders.select(F.to_date("o_orderdate").alias("d"))
    lo = o.select(F.min("d")).scalar()
    hi = o.select(F.max("d")).scalar()
    days = stages.spark.range(1).select(F.explode(F.sequence(lo, hi)).alias("date"))
    return days.select(
        F.date_format("date", "yyyyMMdd").cast("int").alias("date_id"),
        "date",
        F.year("date").alias("year"),
        F.quarter("date").alias("quarter"),
        F.month("date").alias("month"),
        F.date_format("date", "MMMM").alias("month_name"),
        F.weekofyear("date").alias("week"),
        F.date_format("date", "EEEE").alias("day_of_week"),
    )


def fact_predictions(stages: Stages) -> DataFrame:
    """G1: 13 columns with 4 foreign keys; dims are 4 and 13 rows (config-bounded broadcasts)."""
    spark = stages.spark
    d = stages.decided
    arch = F.broadcast(archetype_dim(spark).select("archetype_id", F.col("archetype_code").alias("churn_archetype")))
    acts = F.broadcast(dim_actions(spark).select("action_id", "action_code"))
    date_id = F.date_format(run_date(stages), "yyyyMMdd").cast("int")
    f = d.join(arch, "churn_archetype", "left").join(acts, "action_code", "left").withColumn("date_id", date_id)
    return f.select(
        F.xxhash64("customer_id", "date_id").alias("prediction_id"),
        "customer_id",
        "archetype_id",
        "action_id",
        "date_id",
        "churn_probability",
        "churn_risk_level",
        "primary_driver",
        "expected_revenue_saved",
        "campaign_roi",
        "clv",
        "expected_conversion_rate",
        "action_cost_usd",
    )


def measures(fact: DataFrame, customers: DataFrame, actions: DataFrame) -> DataFrame:
    """G6-G10, G12-G14 in one aggregate over the fact joined to its (small) dimensions."""
    j = fact.join(customers.select("customer_id", "monthly_revenue"), "customer_id", "left").join(
        F.broadcast(actions.select("action_id", F.col("urgency").alias("action_urgency"))), "action_id", "left"
    )
    saved, cost = F.sum("expected_revenue_saved"), F.sum("action_cost_usd")
    return j.agg(
        saved.alias("total_revenue_saved"),
        F.avg("churn_probability").alias("avg_churn_probability"),
        F.count_if(F.col("churn_risk_level").isin("HIGH", "CRITICAL")).alias("high_risk_customers"),
        F.when(cost == 0, F.lit(0.0)).otherwise((saved - cost) / cost).alias("bi_campaign_roi"),
        F.sum(F.when(F.col("churn_probability") >= 0.5, F.col("monthly_revenue") * 12)).alias("revenue_at_risk"),
        (1 - F.avg("churn_probability")).alias("customer_health_index"),
        F.coalesce(F.sum(F.col("churn_probability") * F.col("expected_conversion_rate")) / F.count(F.lit(1)), F.lit(0.0)).alias(
            "predicted_retention_rate"
        ),
        F.avg(F.col("monthly_revenue") * 18).alias("weighted_avg_clv"),
        F.count_if(F.col("action_urgency") == "critical").alias("critical_actions"),
    )


def top_archetype(fact: DataFrame, customers: DataFrame) -> DataFrame:
    """Archetype with the largest revenue at risk (top-1 over the grouped result)."""
    j = fact.join(customers.select("customer_id", "monthly_revenue"), "customer_id", "left")
    g = j.groupBy("archetype_id").agg(
        F.sum(F.when(F.col("churn_probability") >= 0.5, F.col("monthly_revenue") * 12)).alias("revenue_at_risk")
    )
    return g.orderBy(F.desc("revenue_at_risk"), "archetype_id").limit(1)


# ------------------------------------------------------------------ G15: page queries

REACH = 0.85  # share of at-risk customers that a campaign reaches


def revenue_at_risk_by_subscription(fact: DataFrame, customers: DataFrame) -> DataFrame:
    """Yearly revenue of customers at p >= .5, by subscription."""
    j = fact.select("customer_id", "churn_probability").join(customers.select("customer_id", "subscription_type", "monthly_revenue"), "customer_id")
    at_risk = F.col("churn_probability") >= 0.5
    return j.groupBy("subscription_type").agg(
        F.count_if(at_risk).alias("customers_at_risk"), F.sum(F.when(at_risk, F.col("monthly_revenue") * 12)).alias("revenue_at_risk")
    )


def archetype_tier_matrix(decided: DataFrame) -> DataFrame:
    """Customers per archetype (rows) and CLV tier (columns, best first)."""
    counts = [F.count_if(F.col("clv_tier") == t).alias(t.lower()) for t in CLV_TIER_ORDER]
    return decided.filter(F.col("churn_archetype").isNotNull()).groupBy("churn_archetype").agg(*counts)


def riskiest_with_action(fact: DataFrame, actions: DataFrame, n: int = 20) -> DataFrame:
    """The n customers with the highest probability, with the action planned for them."""
    top = fact.orderBy(F.desc("churn_probability"), "customer_id").limit(n)
    return top.join(F.broadcast(actions.select("action_id", "action_name", "channel", "urgency")), "action_id", "left").select(
        "customer_id", "churn_probability", "churn_risk_level", "action_name", "channel", "urgency", "expected_revenue_saved"
    )


def roi_by_archetype(fact: DataFrame) -> DataFrame:
    """G8 for each archetype."""
    saved, cost = F.sum("expected_revenue_saved"), F.sum("action_cost_usd")
    return fact.groupBy("archetype_id").agg(
        saved.alias("revenue_saved"), cost.alias("cost"), F.when(cost == 0, F.lit(0.0)).otherwise((saved - cost) / cost).alias("roi")
    )


def funnel(fact: DataFrame, reach: float = REACH) -> DataFrame:
    """At risk, contacted, converted: expected customers of each step, in one conditional pass."""
    at_risk = F.col("churn_probability") >= 0.5
    steps = fact.agg(
        F.count_if(at_risk).cast("double").alias("at_risk"),
        (F.count_if(at_risk) * F.lit(reach)).alias("contacted"),
        (F.coalesce(F.sum(F.when(at_risk, F.col("expected_conversion_rate"))), F.lit(0.0)) * reach).alias("converted"),
    )
    names = ("at_risk", "contacted", "converted")
    return steps.select(F.inline(F.array(*[F.struct(F.lit(i + 1).alias("step"), F.lit(c).alias("stage"), F.col(c).alias("customers")) for i, c in enumerate(names)])))


def trend_by_date(fact: DataFrame, dates: DataFrame) -> DataFrame:
    """Mean probability and customers of each prediction day."""
    by_day = fact.groupBy("date_id").agg(F.avg("churn_probability").alias("avg_churn_probability"), F.count(F.lit(1)).alias("customers"))
    return by_day.join(dates.select("date_id", "year", "month", "week"), "date_id", "left")
