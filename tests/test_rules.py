"""Rule engine: every rule on both sides of its thresholds, missing features, nulls, fallback."""

from pyspark.sql import functions as F

from keepwell.operators.rules import load_rules, recommend


def _one(spark, row: dict, schema: str):
    return recommend(spark.createDataFrame([row], schema)).select("rule_id").first()["rule_id"]


FULL = (
    "churn_archetype string, engagement_decay_score double, days_since_last_login int, sessions_30d int, "
    "support_sentiment double, ticket_count int, error_rate double, friction_score double, rage_click_count int, "
    "downgrade_page_visits int, billing_page_visits int, pricing_sensitivity_score double, "
    "tier_capacity_utilization double, api_limit_usage double, seat_limit_usage double, growth_pressure_score double"
)
ZERO = dict(
    churn_archetype="A", engagement_decay_score=0.0, days_since_last_login=0, sessions_30d=100, support_sentiment=0.5,
    ticket_count=0, error_rate=0.0, friction_score=0.0, rage_click_count=0, downgrade_page_visits=0,
    billing_page_visits=0, pricing_sensitivity_score=0.0, tier_capacity_utilization=0.0, api_limit_usage=0.0,
    seat_limit_usage=0.0, growth_pressure_score=0.0,
)


def test_rule_table_loaded():
    rs = load_rules()
    assert [r.id for r in rs.rules] == ["A1", "A2", "A3", "B1", "B2", "B3", "C1", "C2", "C3", "D1", "D2", "D3"]
    assert rs.fallback["rule_id"] == "FALLBACK"


def test_each_rule_on_both_sides(spark):
    cases = [
        ("A", dict(engagement_decay_score=0.6, days_since_last_login=14), "A1"),
        ("A", dict(engagement_decay_score=0.59, days_since_last_login=14), "FALLBACK"),
        ("A", dict(engagement_decay_score=0.4, sessions_30d=5), "A2"),
        ("A", dict(engagement_decay_score=0.4, sessions_30d=6), "FALLBACK"),
        ("A", dict(days_since_last_login=21), "A3"),
        ("A", dict(days_since_last_login=20), "FALLBACK"),
        ("B", dict(support_sentiment=-0.2, ticket_count=3), "B1"),
        ("B", dict(support_sentiment=-0.19, ticket_count=3), "FALLBACK"),
        ("B", dict(error_rate=0.10, friction_score=0.5), "B2"),
        ("B", dict(error_rate=0.09, friction_score=0.5), "FALLBACK"),
        ("B", dict(rage_click_count=3), "B3"),
        ("C", dict(downgrade_page_visits=2, billing_page_visits=3), "C1"),
        ("C", dict(billing_page_visits=2, pricing_sensitivity_score=0.5), "C2"),
        ("C", dict(pricing_sensitivity_score=0.3), "C3"),
        ("C", dict(pricing_sensitivity_score=0.29), "FALLBACK"),
        ("D", dict(tier_capacity_utilization=0.85), "D1"),
        ("D", dict(api_limit_usage=0.8, seat_limit_usage=0.8), "D2"),
        ("D", dict(api_limit_usage=0.8, seat_limit_usage=0.79), "FALLBACK"),
        ("D", dict(growth_pressure_score=0.5), "D3"),
    ]
    for arch, over, want in cases:
        row = dict(ZERO, churn_archetype=arch, **over)
        assert _one(spark, row, FULL) == want, (arch, over)


def test_priority_first_match(spark):
    row = dict(ZERO, churn_archetype="A", engagement_decay_score=0.7, days_since_last_login=30, sessions_30d=1)
    assert _one(spark, row, FULL) == "A1"


def test_missing_feature_satisfies_condition(spark):
    # no sessions_30d column: A2's sessions_30d_lte test is skipped
    schema = "churn_archetype string, engagement_decay_score double, days_since_last_login int"
    assert _one(spark, dict(churn_archetype="A", engagement_decay_score=0.45, days_since_last_login=0), schema) == "A2"


def test_null_feature_fails_condition(spark):
    row = dict(ZERO, churn_archetype="D", tier_capacity_utilization=None)
    assert _one(spark, row, FULL) == "FALLBACK"


def test_missing_archetype_defaults_to_a(spark):
    # no archetype column -> "A"; A1's decay condition is skipped (column absent), login >= 14 holds
    df = spark.createDataFrame([(30,), (10,)], "days_since_last_login int")
    got = [r[0] for r in recommend(df).orderBy("days_since_last_login").select("rule_id").collect()]
    assert got == ["A2", "A1"]  # A2: both of its features absent -> true


def test_revenue_saved_golden(spark):
    from keepwell.operators.rules import add_revenue_impact

    df = spark.createDataFrame(
        [(0.8, 100.0, 0.25, 5.0), (0.0, 100.0, 0.25, 5.0)],
        "churn_probability double, monthly_revenue double, expected_conversion_rate double, action_cost_usd double",
    )
    got = [r["expected_revenue_saved"] for r in add_revenue_impact(df).orderBy(F.desc("churn_probability")).collect()]
    assert abs(got[0] - 240.0) < 0.01 and got[1] == 0.0
