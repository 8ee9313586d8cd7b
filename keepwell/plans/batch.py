"""Batch plans: the full decision pipeline and the scoring chain.

Everything is one lazy plan: mart -> features -> score -> high-risk filter ->
archetypes -> value -> rules -> impact.  All stages after the mart are narrow
projections (no shuffle); the only shuffles are the mart's aggregations and
whatever final aggregate / sort a report asks for.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import archetypes, features, impact, rules, scoring, value
from ..session import materialize
from ..sources.mart import customer_mart
from ..sources.tables import Tables

# ---- fixed values: output columns of the recommendation sinks ----
PIPELINE_OUTPUT = [
    "customer_id",
    "subscription_type",
    "monthly_revenue",
    "tenure_months",
    "churn_probability",
    "primary_driver",
    "churn_archetype",
    "archetype_name",
    "action",
    "action_code",
    "channel",
    "urgency",
    "expected_conversion_rate",
    "action_cost_usd",
    "expected_revenue_saved",
    "campaign_roi",
    "clv",
    "clv_tier",
    "customer_health_score",
    "retention_risk_score",
]
SCORE_OUTPUT = PIPELINE_OUTPUT[:5] + ["churn_risk_level"] + PIPELINE_OUTPUT[5:]

HIGH_RISK = 0.50


def decision_chain(df: DataFrame, rule_set: rules.RuleSet | None = None) -> DataFrame:
    """classify -> CLV -> rules -> revenue/ROI -> per-customer impact."""
    df = archetypes.classify(df)
    df = value.add_clv(df)
    df = rules.decide(df, rule_set)
    return impact.per_customer(df)


def high_risk(df: DataFrame, threshold: float = HIGH_RISK) -> DataFrame:
    """C1."""
    return df.filter(F.col("churn_probability") >= threshold)


@dataclass
class Stages:
    """Lazily built stage frames over the test tables (B18 deterministic score, or a champion's)."""

    spark: SparkSession
    sf_dir: str
    threshold: float = HIGH_RISK
    materialized: bool = True
    #: A fitted pipeline from raw customers to probabilities; without one the deterministic score is used.
    champion: PipelineModel | None = None

    @cached_property
    def tables(self) -> Tables:
        return Tables(self.spark, self.sf_dir)

    @cached_property
    def mart(self) -> DataFrame:
        return materialize(customer_mart(self.tables)) if self.materialized else customer_mart(self.tables)

    @cached_property
    def features(self) -> DataFrame:
        return features.engineer(self.mart)

    @cached_property
    def scored(self) -> DataFrame:
        s = scoring.score_model(self.mart, self.champion) if self.champion else scoring.score_baseline(self.features)
        return s.withColumn("churn_risk_level", scoring.risk_level())

    @cached_property
    def high_risk(self) -> DataFrame:
        return high_risk(self.scored, self.threshold)

    @cached_property
    def decided_all(self) -> DataFrame:
        """Every scored customer through the decision chain, materialized once.

        All decision columns are row-wise, so the high-risk subset below is a
        filter on this table and equals running the chain on the subset.
        """
        d = decision_chain(self.scored.withColumn("primary_driver", F.lit("engagement_decay_score")))
        return materialize(d) if self.materialized else d

    @cached_property
    def archetyped_all(self) -> DataFrame:
        return self.decided_all

    @cached_property
    def decided(self) -> DataFrame:
        """High-risk customers through the whole decision chain (placeholder driver, M10)."""
        return high_risk(self.decided_all, self.threshold)


def recommendations(decided: DataFrame, with_risk_level: bool = True, sort: bool = True) -> DataFrame:
    """Present output columns, sorted by churn_probability desc (ties by id)."""
    cols = SCORE_OUTPUT if with_risk_level else PIPELINE_OUTPUT
    present = [c for c in cols if c in decided.columns]
    out = decided.select(*present)
    return out.orderBy(F.desc("churn_probability"), "customer_id") if sort else out
