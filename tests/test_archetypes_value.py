"""Archetype argmax ties and rounding, CLV golden cases and closed form vs the 36-term sum."""

from pyspark.sql import functions as F

from keepwell.operators.archetypes import classify
from keepwell.operators.value import add_clv, clv, clv_tier


def test_tie_goes_to_first_code(spark):
    # all four scores zero -> A; equal B and C -> B
    df = spark.createDataFrame([(0.0,)], "x double")
    assert classify(df).select("churn_archetype").first()[0] == "A"
    df = spark.createDataFrame([(0.0, 1.0, 0.0, 10, 0, 0.0, 0.0, 0.0, 0.0)],
        "friction_score double, pricing_sensitivity_score double, error_rate double, ticket_count int, "
        "billing_page_visits int, support_sentiment double, engagement_decay_score double, "
        "growth_pressure_score double, login_frequency_change double")
    r = classify(df).first()
    assert r["score_frustrated"] == 0.125 and r["churn_archetype"] in ("B", "C")


def test_ghost_row(spark):
    df = spark.createDataFrame([(80, 0, -0.9, 0.8, 0.0)],
        "days_since_last_login int, sessions_30d int, login_frequency_change double, engagement_decay_score double, "
        "velocity_30d_vs_90d double")
    assert classify(df).first()["churn_archetype"] == "A"


def test_clv_tiers_golden(spark):
    df = spark.createDataFrame([(10000.0,), (2000.0,), (800.0,), (100.0,)], "v double")
    got = [r[0] for r in df.select(clv_tier(F.col("v"))).collect()]
    assert got == ["Enterprise", "High", "Medium", "Low"]


def test_clv_closed_form_matches_loop(spark):
    rows = [(200.0, p) for p in (0.0, 0.1, 0.2, 0.5, 0.8, 0.99)]
    df = spark.createDataFrame(rows, "mrr double, p double").select("mrr", "p", clv(F.col("mrr"), F.col("p")).alias("c"))
    for r in df.collect():
        q = (1 - r["p"]) / (1 + 0.10 / 12)
        loop = round(sum(r["mrr"] * q**t for t in range(1, 37)), 2)
        assert abs(r["c"] - loop) <= 0.011
    v = {r["p"]: r["c"] for r in df.collect()}
    assert v[0.1] > v[0.8] and v[0.2] > 0


def test_clv_defaults_when_columns_absent(spark):
    out = add_clv(spark.createDataFrame([(1,)], "k int")).first()
    assert out["annualised_revenue"] == 1200.0 and out["clv"] > 0
