"""Registered queries: one per inventory operator, each with its DuckDB oracle.

``QUERIES[name] = (spark_fn(spark, sf_dir) -> DataFrame, oracle_sql or None)``.
Every query reads the given tables (through the mart) so its work grows
with them.  Per-customer operators return ``customer_id`` + the operator's
output columns; S6 outputs are rounded half-even to 6 dp on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.exprs import rint_to
from .oracle import duck
from .oracle.duck import chain
from .plans.batch import Stages

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def register(name: str, sql: str | None):
    def deco(fn):
        QUERIES[name] = (fn, sql)
        return fn

    return deco


def r6(*cols: str) -> list:
    return [rint_to(F.col(c), 6).alias(c) for c in cols]


def s6(*cols: str) -> str:
    return ", ".join(f"round_even({c}, 6) AS {c}" for c in cols)


def st(spark: SparkSession, sf_dir: str) -> Stages:
    return Stages(spark, sf_dir)


# ------------------------------------------------------------------ A: sources

MART_COLS = [
    "c_custkey", "customer_id", "subscription_type", "monthly_revenue", "tenure_months", "country", "industry",
    "sessions_30d", "sessions_90d", "days_since_last_login", "days_since_last_core_action", "login_frequency_change",
    "session_duration_change", "ticket_count", "support_sentiment", "error_rate", "failed_api_calls",
    "rage_click_count", "billing_page_visits", "downgrade_page_visits", "invoice_download_frequency",
    "trial_expiry_days", "tier_capacity_utilization", "export_frequency", "api_usage", "api_limit_usage",
    "seat_limit_usage", "churned",
]


@register("a04_customer_mart", chain("mart", f"SELECT {', '.join(MART_COLS)} FROM mart"))
def a04_customer_mart(spark, sf_dir):
    return st(spark, sf_dir).mart.select(*MART_COLS)


# ------------------------------------------------------------------ B: features


def _feature_query(name: str, cols: list[str], rounded: bool = False):
    sql_cols = s6(*cols) if rounded else ", ".join(cols)

    @register(name, chain("feat", f"SELECT customer_id, {sql_cols} FROM feat"))
    def q(spark, sf_dir):
        spark_cols = r6(*cols) if rounded else cols
        return st(spark, sf_dir).features.select("customer_id", *spark_cols)

    return q


_feature_query("b01_velocity", ["velocity_30d_vs_90d"])
_feature_query("b02_engagement_decay", ["engagement_decay_score"])
_feature_query("b03_friction", ["friction_score"])
_feature_query("b04_pricing_sensitivity", ["pricing_sensitivity_score"])
_feature_query("b05_growth_pressure", ["growth_pressure_score"])
_feature_query("b06_customer_health", ["customer_health_score"])
_feature_query("b07_retention_risk", ["retention_risk_score"])
_feature_query("b08_support_ticket_sentiment", ["support_ticket_sentiment"])
_feature_query("b09_ticket_density", ["ticket_density_30d"])
_feature_query("b10_subscription_tier", ["subscription_tier"])
_feature_query("b11_tenure_bucket", ["tenure_bucket"])
_feature_query("b12_log_transforms", ["log_api_usage", "log_monthly_revenue"], rounded=True)

_EXACT_ENG = [
    "velocity_30d_vs_90d", "engagement_decay_score", "friction_score", "pricing_sensitivity_score",
    "growth_pressure_score", "customer_health_score", "retention_risk_score", "support_ticket_sentiment",
    "ticket_density_30d", "subscription_tier", "tenure_bucket",
]


@register(
    "b13_feature_transformer",
    chain("feat", f"SELECT customer_id, {', '.join(_EXACT_ENG)}, {s6('log_api_usage', 'log_monthly_revenue')} FROM feat"),
)
def b13_feature_transformer(spark, sf_dir):
    from .operators.features import FeatureEngineer

    t = st(spark, sf_dir)
    out = FeatureEngineer().transform(t.mart)
    return out.select("customer_id", *_EXACT_ENG, *r6("log_api_usage", "log_monthly_revenue"))


# ------------------------------------------------------------------ B: scores


@register("b18_baseline_score", chain("scored", f"SELECT customer_id, {s6('churn_probability')} FROM scored"))
def b18_baseline_score(spark, sf_dir):
    return st(spark, sf_dir).scored.select("customer_id", *r6("churn_probability"))


_HEUR_PARTS = [
    "0.25e0 * (days_since_last_login / 90e0)",
    "0.20e0 * (ticket_count / 20e0)",
    "0.15e0 * greatest(0e0, -support_sentiment)",
    "0.20e0 * (billing_page_visits / 20e0 + downgrade_page_visits / 10e0) / 2",
    "0.10e0 * greatest(0e0, 1 - sessions_30d / 30e0)",
]
_HEUR_P = (
    f"least(greatest({' + '.join(_HEUR_PARTS)} - 0.10e0 * (tenure_months / 84e0) + 0.1e0, 0.05e0), 0.97e0)"
)
_HEUR_LABEL = (
    "CASE WHEN heuristic_probability > 0.7e0 THEN 'CRITICAL' WHEN heuristic_probability > 0.5e0 THEN 'HIGH'"
    " WHEN heuristic_probability > 0.3e0 THEN 'MEDIUM' ELSE 'LOW' END"
)


@register("b19_heuristic_score", chain("mart", f"SELECT customer_id, {_HEUR_P} AS heuristic_probability FROM mart"))
def b19_heuristic_score(spark, sf_dir):
    from .operators.scoring import heuristic_probability

    return st(spark, sf_dir).mart.select("customer_id", heuristic_probability().alias("heuristic_probability"))


_DRIVER_NAMES = ["Days since login", "Support tickets", "Negative sentiment", "Billing page visits", "Low engagement"]
_B20_UNION = " UNION ALL ".join(
    f"SELECT customer_id, {i} AS pos, '{n}' AS driver, {e} AS impact FROM mart"
    for i, (n, e) in enumerate(zip(_DRIVER_NAMES, _HEUR_PARTS))
)


@register(
    "b20_heuristic_drivers",
    chain(
        "mart",
        f"SELECT customer_id, CAST(row_number() OVER (PARTITION BY customer_id ORDER BY impact DESC, pos) AS INT)"
        f" AS driver_rank, driver, impact FROM ({_B20_UNION}) u",
    ),
)
def b20_heuristic_drivers(spark, sf_dir):
    from .operators.scoring import heuristic_drivers

    return heuristic_drivers(st(spark, sf_dir).mart)


@register("b21_risk_level", chain("scored", "SELECT customer_id, churn_risk_level FROM scored2"))
def b21_risk_level(spark, sf_dir):
    return st(spark, sf_dir).scored.select("customer_id", "churn_risk_level")


@register(
    "b22_heuristic_label",
    chain(
        "mart",
        f"SELECT customer_id, heuristic_probability, {_HEUR_LABEL} AS heuristic_risk_label"
        f" FROM (SELECT customer_id, {_HEUR_P} AS heuristic_probability FROM mart) h",
    ),
)
def b22_heuristic_label(spark, sf_dir):
    from .operators.scoring import with_heuristic

    return with_heuristic(st(spark, sf_dir).mart).select("customer_id", "heuristic_probability", "heuristic_risk_label")


@register(
    "b23_display_currency",
    chain(
        "impacted",
        "SELECT customer_id, round_even(monthly_revenue * 83e0, 0) AS monthly_revenue_display,"
        " round_even(expected_revenue_saved * 83e0, 0) AS expected_revenue_saved_display,"
        " round_even(clv * 83e0, 0) AS clv_display, round_even(action_cost_usd * 83e0, 0) AS action_cost_display"
        " FROM impacted",
    ),
)
def b23_display_currency(spark, sf_dir):
    from .operators.scoring import display_currency

    d = st(spark, sf_dir).decided.select("customer_id", "monthly_revenue", "expected_revenue_saved", "clv", "action_cost_usd")
    return display_currency(d)


# ------------------------------------------------------------------ C: filters


@register(
    "c01_high_risk_filter",
    chain("scored", f"SELECT customer_id, {s6('churn_probability')} FROM scored WHERE churn_probability >= 0.5e0"),
)
def c01_high_risk_filter(spark, sf_dir):
    return st(spark, sf_dir).high_risk.select("customer_id", *r6("churn_probability"))


_EXPLORER_COLS = [
    "customer_id", "subscription_type", "monthly_revenue", "tenure_months", "churn_probability", "churn_archetype",
    "archetype_name", "action", "urgency", "expected_revenue_saved", "clv_tier",
]


@register(
    "c03_explorer_filter",
    chain(
        "impacted",
        f"SELECT {', '.join(c for c in _EXPLORER_COLS if c != 'churn_probability')}, {s6('churn_probability')}"
        " FROM impacted WHERE churn_probability >= 0.5e0 AND churn_archetype IN ('A','B','C','D')"
        " AND urgency IN ('critical','high') ORDER BY churn_probability DESC, customer_id LIMIT 200",
    ),
)
def c03_explorer_filter(spark, sf_dir):
    from .operators.reports import explorer

    out = explorer(st(spark, sf_dir).decided, 0.5, list("ABCD"), ["critical", "high"], limit=200)
    return out.select(*[c for c in out.columns if c != "churn_probability"], *r6("churn_probability"))


@register(
    "c08_high_risk_segment",
    chain(
        "scored",
        "SELECT count(*) AS customers, CAST(sum(CASE WHEN churn_risk_level IN ('HIGH','CRITICAL') THEN 1 ELSE 0 END)"
        " AS BIGINT) AS high_risk_customers FROM scored2",
    ),
)
def c08_high_risk_segment(spark, sf_dir):
    s = st(spark, sf_dir).scored
    return s.agg(
        F.count(F.lit(1)).alias("customers"),
        F.count_if(F.col("churn_risk_level").isin("HIGH", "CRITICAL")).alias("high_risk_customers"),
    )


@register(
    "c09_first_above_70",
    chain(
        "scored",
        f"SELECT customer_id, {s6('churn_probability')} FROM scored WHERE churn_probability >= 0.7e0"
        " ORDER BY customer_id LIMIT 1",
    ),
)
def c09_first_above_70(spark, sf_dir):
    s = st(spark, sf_dir).scored
    return s.filter(F.col("churn_probability") >= 0.7).orderBy("customer_id").limit(1).select(
        "customer_id", *r6("churn_probability")
    )


# ------------------------------------------------------------------ E: archetypes


def _arch_query(name: str, cols: list[str]):
    @register(name, chain("arch", f"SELECT customer_id, {', '.join(cols)} FROM arch", high_risk=False))
    def q(spark, sf_dir):
        return st(spark, sf_dir).archetyped_all.select("customer_id", *cols)

    return q


_arch_query("e01_score_ghost", ["score_ghost"])
_arch_query("e02_score_frustrated", ["score_frustrated"])
_arch_query("e03_score_price_sensitive", ["score_price_sensitive"])
_arch_query("e04_score_outgrown", ["score_outgrown"])
_arch_query("e05_score_rounding", ["score_ghost", "score_frustrated", "score_price_sensitive", "score_outgrown"])
_arch_query("e06_archetype_argmax", ["churn_archetype"])
_arch_query("e07_confidence_and_name", ["archetype_confidence", "archetype_name"])
_arch_query(
    "e08_classify",
    ["score_ghost", "score_frustrated", "score_price_sensitive", "score_outgrown", "churn_archetype",
     "archetype_confidence", "archetype_name"],
)

# ------------------------------------------------------------------ E: rules and value

_ACTION = ["rule_id", "action", "action_code", "channel", "urgency", "expected_conversion_rate", "action_cost_usd",
           "description"]


def _decided_query(name: str, cols: list[str], rounded: tuple = (), high_risk: bool = True):
    plain = [c for c in cols if c not in rounded]
    sql_cols = ", ".join(plain + ([s6(*rounded)] if rounded else []))

    @register(name, chain("impacted", f"SELECT customer_id, {sql_cols} FROM impacted", high_risk=high_risk))
    def q(spark, sf_dir):
        s = st(spark, sf_dir)
        d = s.decided if high_risk else s.decided_all
        return d.select("customer_id", *plain, *r6(*rounded))

    return q


_decided_query("e09_recommend", _ACTION)
_decided_query("e09_recommend_all_customers", _ACTION, high_risk=False)
_decided_query("e12_expected_revenue_saved", ["expected_revenue_saved"])
_decided_query("e13_campaign_roi", ["campaign_roi"])
_decided_query("e14_decision_pipeline", ["rule_id", "expected_revenue_saved", "campaign_roi"])
_decided_query("e15_clv", ["clv"], high_risk=False)
_decided_query("e16_clv_tier", ["clv_tier"], high_risk=False)
_decided_query("e17_clv_columns", ["clv", "clv_tier", "annualised_revenue"])
_decided_query(
    "e19_per_customer_impact",
    ["p_saved", "revenue_saved", "campaign_cost_total", "incremental_profit"],
    rounded=("p_saved", "revenue_saved", "campaign_cost_total", "incremental_profit"),
)


@register(
    "e10_rule_hits",
    chain("impacted", "SELECT rule_id, count(*) AS customers FROM impacted GROUP BY rule_id", high_risk=False),
)
def e10_rule_hits(spark, sf_dir):
    return st(spark, sf_dir).decided_all.groupBy("rule_id").agg(F.count(F.lit(1)).alias("customers"))


@register(
    "d03_rule_match_by_tables",
    chain("impacted", "SELECT customer_id, rule_id, action_code, urgency, expected_conversion_rate, action_cost_usd FROM impacted", high_risk=False),
)
def d03_rule_match_by_tables(spark, sf_dir):
    from .operators.archetypes import classify
    from .operators.rule_match import recommend_by_tables

    out = recommend_by_tables(classify(st(spark, sf_dir).scored))
    return out.select("customer_id", "rule_id", "action_code", "urgency", "expected_conversion_rate", "action_cost_usd")


@register(
    "e11_fallback_share",
    chain(
        "impacted",
        "SELECT count(*) AS customers, CAST(sum(CASE WHEN rule_id = 'FALLBACK' THEN 1 ELSE 0 END) AS BIGINT)"
        " AS fallback_customers, round_even(avg(CASE WHEN rule_id = 'FALLBACK' THEN 1e0 ELSE 0e0 END), 6)"
        " AS fallback_share FROM impacted",
    ),
)
def e11_fallback_share(spark, sf_dir):
    d = st(spark, sf_dir).decided
    fb = F.col("rule_id") == "FALLBACK"
    return d.agg(
        F.count(F.lit(1)).alias("customers"),
        F.count_if(fb).alias("fallback_customers"),
        rint_to(F.avg(F.when(fb, 1.0).otherwise(0.0)), 6).alias("fallback_share"),
    )


_Q18 = "((1e0 - churn_probability) / 1.008e0)"


@register(
    "e18_simple_clv",
    chain(
        "scored",
        f"SELECT customer_id, round_even(CASE WHEN {_Q18} = 1e0 THEN monthly_revenue * 36e0 ELSE monthly_revenue * {_Q18}"
        f" * (1e0 - pow({_Q18}, 36e0)) / (1e0 - {_Q18}) END, 6) AS clv_simple FROM scored",
    ),
)
def e18_simple_clv(spark, sf_dir):
    from .operators.value import clv_simple

    s = st(spark, sf_dir).scored
    return s.select("customer_id", rint_to(clv_simple(F.col("monthly_revenue"), F.col("churn_probability")), 6).alias("clv_simple"))


@register(
    "e20_recommendation_record",
    chain(
        "impacted",
        "SELECT customer_id, round(churn_probability, 4) AS churn_probability, churn_archetype, archetype_name,"
        " 'engagement_decay_score' AS primary_driver, action AS recommended_action, channel, urgency,"
        " expected_conversion_rate, expected_revenue_saved, clv, clv_tier FROM impacted",
        high_risk=False,
    ),
)
def e20_recommendation_record(spark, sf_dir):
    from .plans.serving import recommendation_record

    return recommendation_record(st(spark, sf_dir).decided_all)


@register(
    "e21_batch_prediction",
    chain(
        "scored",
        "SELECT customer_id, round(churn_probability, 4) AS churn_probability, churn_risk_level,"
        " (SELECT count(*) FROM scored2) AS count FROM scored2",
    ),
)
def e21_batch_prediction(spark, sf_dir):
    from .plans.serving import batch_prediction

    return batch_prediction(st(spark, sf_dir).scored)


# ------------------------------------------------------------------ A11 / I: sinks and sorts

_A11_COLS = [
    "customer_id", "subscription_type", "monthly_revenue", "tenure_months", "churn_risk_level",
    "primary_driver", "churn_archetype", "archetype_name", "action", "action_code", "channel", "urgency",
    "expected_conversion_rate", "action_cost_usd", "expected_revenue_saved", "campaign_roi", "clv", "clv_tier",
    "customer_health_score", "retention_risk_score",
]


@register(
    "a11_recommendations",
    chain(
        "impacted",
        f"SELECT {', '.join(c if c != 'primary_driver' else chr(39) + 'engagement_decay_score' + chr(39) + ' AS primary_driver' for c in _A11_COLS)},"
        f" {s6('churn_probability')} FROM impacted",
    ),
)
def a11_recommendations(spark, sf_dir):
    from .plans.batch import recommendations

    rec = recommendations(st(spark, sf_dir).decided)
    return rec.select(*[c for c in rec.columns if c != "churn_probability"], *r6("churn_probability"))


@register(
    "i01_global_sort",
    chain("impacted", f"SELECT customer_id, {s6('churn_probability')} FROM impacted"
          " ORDER BY churn_probability DESC, customer_id"),
)
def i01_global_sort(spark, sf_dir):
    d = st(spark, sf_dir).decided
    return d.orderBy(F.desc("churn_probability"), "customer_id").select("customer_id", *r6("churn_probability"))


_TOP10 = ["customer_id", "subscription_type", "monthly_revenue", "archetype_name", "action", "expected_revenue_saved"]


@register(
    "i02_top10_by_saved",
    chain(
        "impacted",
        f"SELECT {', '.join(_TOP10)}, {s6('churn_probability')} FROM impacted"
        " ORDER BY expected_revenue_saved DESC, customer_id LIMIT 10",
    ),
)
def i02_top10_by_saved(spark, sf_dir):
    from .operators.reports import top_by_saved

    t = top_by_saved(st(spark, sf_dir).decided, 10)
    return t.select(*_TOP10, *r6("churn_probability"))


@register(
    "i03_priority_queue",
    chain(
        "impacted",
        "SELECT customer_id, archetype_name, action, urgency, expected_revenue_saved, clv_tier FROM impacted"
        " ORDER BY expected_revenue_saved DESC, customer_id LIMIT 100",
    ),
)
def i03_priority_queue(spark, sf_dir):
    from .operators.reports import priority_queue

    return priority_queue(st(spark, sf_dir).decided, 100)


@register(
    "i06_top5_riskiest",
    chain("scored", f"SELECT customer_id, {s6('churn_probability')} FROM scored ORDER BY churn_probability DESC,"
          " customer_id LIMIT 5"),
)
def i06_top5_riskiest(spark, sf_dir):
    s = st(spark, sf_dir).scored
    return s.orderBy(F.desc("churn_probability"), "customer_id").limit(5).select("customer_id", *r6("churn_probability"))


# ------------------------------------------------------------------ F: aggregates


def _agg_query(name: str, stage: str, sql_body: str, build, rounded: tuple = (), high_risk: bool = True):
    """Register an aggregate: ``build(stages) -> DataFrame``; ``rounded`` columns get 6-dp half-even."""

    @register(name, chain(stage, sql_body, high_risk=high_risk))
    def q(spark, sf_dir):
        out = build(st(spark, sf_dir))
        if not rounded:
            return out
        return out.select(*[rint_to(F.col(c), 6).alias(c) if c in rounded else F.col(c) for c in out.columns])

    return q


def _rep(fn_name: str):
    from .operators import reports

    return getattr(reports, fn_name)


_NN_ARCH = "FROM impacted WHERE churn_archetype IS NOT NULL"

_agg_query(
    "f01_archetype_counts", "impacted",
    f"SELECT churn_archetype AS archetype, count(*) AS count {_NN_ARCH} GROUP BY churn_archetype",
    lambda s: _rep("archetype_counts")(s.decided),
)
_agg_query(
    "f02_archetype_distribution", "impacted",
    f"SELECT churn_archetype, count(*) AS count, round_even(avg(churn_probability), 6) AS avg_churn_prob,"
    f" round_even(avg(monthly_revenue), 6) AS avg_monthly_revenue, any_value(archetype_name) AS archetype_name"
    f" {_NN_ARCH} GROUP BY churn_archetype",
    lambda s: __import__("keepwell.operators.archetypes", fromlist=["x"]).distribution(s.decided),
    rounded=("avg_churn_prob", "avg_monthly_revenue"),
)
_agg_query(
    "f03_clv_summary", "impacted",
    "SELECT clv_tier, count(clv) AS count, round_even(avg(clv), 2) AS avg_clv, round_even(sum(clv), 2) AS total_clv,"
    " round_even(avg(monthly_revenue), 2) AS avg_mrr FROM impacted WHERE clv_tier IS NOT NULL GROUP BY clv_tier",
    lambda s: __import__("keepwell.operators.value", fromlist=["x"]).clv_summary(s.decided),
)

_TOT_SQL = """SELECT total_at_risk_users, total_at_risk_mrr, expected_users_retained, expected_revenue_saved,
  total_campaign_cost, net_incremental_profit,
  round_even(net_incremental_profit / greatest(total_campaign_cost, 1e0) * 100, 1) AS roi_pct,
  round_even(total_campaign_cost / greatest(mean_rev * 0.7e0, 1e0), 1) AS payback_months
FROM (SELECT count(*) AS total_at_risk_users, round_even(sum(monthly_revenue), 2) AS total_at_risk_mrr,
  round_even(sum(p_saved), 1) AS expected_users_retained, round_even(sum(revenue_saved), 2) AS expected_revenue_saved,
  round_even(sum(campaign_cost_total), 2) AS total_campaign_cost, round_even(sum(incremental_profit), 2) AS net_incremental_profit,
  avg(revenue_saved) AS mean_rev FROM impacted) t"""

_agg_query(
    "f04_impact_totals", "impacted", _TOT_SQL,
    lambda s: __import__("keepwell.operators.impact", fromlist=["x"]).impact_totals(s.decided),
)
_agg_query(
    "f05_impact_roi_pct", "impacted", f"SELECT roi_pct AS impact_roi_pct FROM ({_TOT_SQL}) x",
    lambda s: __import__("keepwell.operators.impact", fromlist=["x"]).impact_totals(s.decided).select(
        F.col("roi_pct").alias("impact_roi_pct")),
)
_agg_query(
    "f06_payback_months", "impacted", f"SELECT payback_months FROM ({_TOT_SQL}) x",
    lambda s: __import__("keepwell.operators.impact", fromlist=["x"]).impact_totals(s.decided).select("payback_months"),
)
_agg_query(
    "f07_impact_by_archetype", "impacted",
    "SELECT churn_archetype, count(*) AS users, round_even(sum(revenue_saved), 2) AS revenue_saved,"
    " round_even(sum(campaign_cost_total), 2) AS campaign_cost, round_even(sum(incremental_profit), 2) AS net_profit"
    f" {_NN_ARCH} GROUP BY churn_archetype",
    lambda s: __import__("keepwell.operators.impact", fromlist=["x"]).impact_by_archetype(s.decided),
)
_agg_query(
    "f08_impact_by_urgency", "impacted",
    "SELECT urgency, count(*) AS users, round_even(sum(revenue_saved), 2) AS revenue_saved,"
    " round_even(avg(expected_conversion_rate), 2) AS avg_conversion FROM impacted WHERE urgency IS NOT NULL"
    " GROUP BY urgency",
    lambda s: __import__("keepwell.operators.impact", fromlist=["x"]).impact_by_urgency(s.decided),
)
_agg_query(
    "f09_report_kpis", "impacted",
    "SELECT customers, round_even(saved, 6) AS total_revenue_saved, round_even(avg_p, 6) AS avg_churn_probability,"
    " round_even(cost, 6) AS total_cost, round_even(saved * 0.7e0 - cost * 1.2e0, 6) AS net_profit,"
    " round_even((saved * 0.7e0 - cost * 1.2e0) / greatest(cost, 1e0) * 100, 6) AS report_roi_pct"
    " FROM (SELECT count(*) AS customers, coalesce(sum(expected_revenue_saved), 0e0) AS saved,"
    " avg(churn_probability) AS avg_p, coalesce(sum(action_cost_usd), 0e0) AS cost FROM impacted) k",
    lambda s: _rep("report_kpis")(s.decided),
    rounded=("total_revenue_saved", "avg_churn_probability", "total_cost", "net_profit", "report_roi_pct"),
)

_MODE_SQL = """(SELECT churn_archetype, action AS top_action FROM (
  SELECT churn_archetype, action, row_number() OVER (PARTITION BY churn_archetype ORDER BY n DESC, action) AS rn
  FROM (SELECT churn_archetype, action, count(*) AS n FROM impacted WHERE churn_archetype IS NOT NULL AND action IS NOT NULL
        GROUP BY churn_archetype, action) c) x WHERE rn = 1)"""

_agg_query(
    "f10_report_archetypes", "impacted",
    "SELECT g.churn_archetype, customers, round_even(avg_p, 6) AS avg_churn_probability,"
    " round_even(saved, 6) AS revenue_saved, m.top_action, coalesce(g.nm, g.churn_archetype) AS archetype_name"
    " FROM (SELECT churn_archetype, count(*) AS customers, avg(churn_probability) AS avg_p,"
    " sum(expected_revenue_saved) AS saved, any_value(archetype_name) AS nm"
    f" {_NN_ARCH} GROUP BY churn_archetype) g LEFT JOIN {_MODE_SQL} m USING (churn_archetype)",
    lambda s: _rep("report_archetypes")(s.decided),
    rounded=("avg_churn_probability", "revenue_saved"),
)
_agg_query(
    "f11_urgency_share", "impacted",
    "SELECT urgency, count(*) AS count, round_even(count(*) / (SELECT count(*) FROM impacted) * 100e0, 6)"
    " AS pct_of_total FROM impacted WHERE urgency IS NOT NULL GROUP BY urgency",
    lambda s: _rep("urgency_share")(s.decided),
    rounded=("pct_of_total",),
)
_agg_query(
    "f12_action_summary", "impacted",
    "SELECT action, count(*) AS count, round_even(sum(expected_revenue_saved), 3) AS total_rev_saved,"
    " round_even(avg(expected_conversion_rate), 3) AS avg_conversion FROM impacted WHERE action IS NOT NULL"
    " GROUP BY action",
    lambda s: _rep("action_summary")(s.decided),
)
_agg_query(
    "f13_kpi_row", "impacted",
    "SELECT count(*) AS customers, count(*) FILTER (WHERE churn_probability >= 0.5e0) AS high_risk_customers,"
    " round_even(count(*) FILTER (WHERE churn_probability >= 0.5e0) / count(*), 6) AS high_risk_share,"
    " round_even(avg(churn_probability), 6) AS avg_churn_probability,"
    " round_even(sum(expected_revenue_saved) FILTER (WHERE churn_probability >= 0.5e0), 6) AS revenue_saved,"
    " round_even(avg(campaign_roi) FILTER (WHERE churn_probability >= 0.5e0), 6) AS avg_campaign_roi,"
    " round_even(sum(action_cost_usd) FILTER (WHERE churn_probability >= 0.5e0), 6) AS campaign_cost FROM impacted",
    lambda s: _rep("kpi_row")(s.decided_all),
    rounded=("high_risk_share", "avg_churn_probability", "revenue_saved", "avg_campaign_roi", "campaign_cost"),
    high_risk=False,
)
_agg_query(
    "f14_mrr_by_clv_tier", "impacted",
    "SELECT clv_tier, round_even(sum(monthly_revenue), 6) AS monthly_revenue FROM impacted"
    " WHERE clv_tier IS NOT NULL GROUP BY clv_tier",
    lambda s: _rep("mrr_by_clv_tier")(s.decided),
    rounded=("monthly_revenue",),
)
_agg_query(
    "f15_probability_histogram", "scored",
    "SELECT CAST(least(50, floor(churn_probability * 50) + 1) AS INT) AS bin, count(*) AS count FROM scored"
    " WHERE churn_probability IS NOT NULL GROUP BY 1",
    lambda s: _rep("probability_histogram")(s.scored),
)
_agg_query(
    "f16_archetype_action_summary", "impacted",
    "SELECT churn_archetype, action, count(*) AS count, round_even(sum(expected_revenue_saved), 6) AS revenue_saved"
    " FROM impacted WHERE churn_archetype IS NOT NULL AND action IS NOT NULL GROUP BY churn_archetype, action",
    lambda s: _rep("archetype_action_summary")(s.decided),
    rounded=("revenue_saved",),
)
_agg_query(
    "f17_urgency_counts", "impacted",
    "SELECT urgency, count(*) AS count FROM impacted WHERE urgency IS NOT NULL GROUP BY urgency",
    lambda s: _rep("urgency_counts")(s.decided),
)
_agg_query(
    "f19_churn_rate_by_subscription", "mart",
    "SELECT subscription_type, round_even(avg(churned), 6) AS churn_rate FROM mart"
    " WHERE subscription_type IS NOT NULL GROUP BY subscription_type",
    lambda s: _rep("churn_rate_by_subscription")(s.mart),
    rounded=("churn_rate",),
)


def _hist_sql(col: str, bins: int, by: str = "") -> str:
    by_sel = f"{by}, " if by else ""
    by_grp = f", {by}" if by else ""
    return (
        f"SELECT {by_sel}CAST(CASE WHEN s.mx > s.mn THEN least({bins}, floor(({col} - s.mn) * ({bins}e0 / (s.mx - s.mn))) + 1)"
        f" ELSE 1 END AS INT) AS bin, count(*) AS count FROM mart, (SELECT min({col}) AS mn, max({col}) AS mx FROM mart) s"
        f" WHERE {col} IS NOT NULL GROUP BY 1{by_grp}" if not by else
        f"SELECT {by}, CAST(CASE WHEN s.mx > s.mn THEN least({bins}, floor(({col} - s.mn) * ({bins}e0 / (s.mx - s.mn))) + 1)"
        f" ELSE 1 END AS INT) AS bin, count(*) AS count FROM mart, (SELECT min({col}) AS mn, max({col}) AS mx FROM mart) s"
        f" WHERE {col} IS NOT NULL GROUP BY 1, 2"
    )


_agg_query(
    "f20_mrr_histogram", "mart", _hist_sql("monthly_revenue", 50),
    lambda s: _rep("equal_width_histogram")(s.mart, "monthly_revenue", 50),
)
_agg_query(
    "f20_tenure_histogram_by_label", "mart", _hist_sql("tenure_months", 30, "churned"),
    lambda s: _rep("equal_width_histogram")(s.mart, "tenure_months", 30, ["churned"]),
)

_SC6 = ["engagement_decay_score", "friction_score", "pricing_sensitivity_score", "growth_pressure_score",
        "customer_health_score", "retention_risk_score"]

_agg_query(
    "f21_label_correlations", "feat",
    "SELECT feature, round_even(correlation, 6) AS correlation FROM ("
    + " UNION ALL ".join(f"SELECT '{c}' AS feature, corr({c}, CAST(churned AS DOUBLE)) AS correlation FROM feat" for c in _SC6)
    + ") u",
    lambda s: _rep("label_correlations")(s.features),
    rounded=("correlation",),
)
_agg_query(
    "f22_mean_mrr_by_archetype", "impacted",
    f"SELECT churn_archetype, round_even(avg(monthly_revenue), 2) AS avg_monthly_revenue {_NN_ARCH} GROUP BY 1",
    lambda s: _rep("mean_mrr_by_archetype")(s.decided),
)
_agg_query(
    "f23_archetype_probability_and_scores", "impacted",
    "SELECT churn_archetype, round_even(avg(churn_probability), 3) AS mean_churn_probability, count(*) AS count, "
    + ", ".join(f"round_even(avg({c}), 3) AS {c}" for c in _SC6[:4])
    + f" {_NN_ARCH} GROUP BY 1",
    lambda s: _rep("archetype_probability_and_scores")(s.decided),
)

_PROFILE = ["churn_probability", "monthly_revenue", "tenure_months", "engagement_decay_score", "friction_score",
            "pricing_sensitivity_score", "growth_pressure_score", "customer_health_score", "clv"]

_agg_query(
    "f24_archetype_profile", "impacted",
    "SELECT churn_archetype, metric, round_even(avg(value), 3) AS mean, round_even(quantile_cont(value, 0.5), 3) AS median"
    " FROM (" + " UNION ALL ".join(
        f"SELECT churn_archetype, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM impacted" for m in _PROFILE
    ) + ") u WHERE churn_archetype IS NOT NULL AND value IS NOT NULL GROUP BY 1, 2",
    lambda s: _rep("archetype_profile")(s.decided),
)

_RADAR = ["engagement_decay_score", "friction_score", "pricing_sensitivity_score", "growth_pressure_score",
          "retention_risk_score"]

_agg_query(
    "f25_archetype_radar", "impacted",
    "SELECT churn_archetype, " + ", ".join(f"round_even(avg({c}), 6) AS {c}" for c in _RADAR) + f" {_NN_ARCH} GROUP BY 1",
    lambda s: _rep("archetype_radar")(s.decided),
    rounded=tuple(_RADAR),
)
_agg_query(
    "f26_archetype_tier_pivot", "impacted",
    "SELECT churn_archetype, "
    + ", ".join(
        f"round_even(coalesce(sum(expected_revenue_saved) FILTER (WHERE clv_tier = '{t}'), 0e0), 6) AS {t}"
        for t in ["Enterprise", "High", "Medium", "Low"]
    )
    + f" {_NN_ARCH} GROUP BY 1",
    lambda s: _rep("archetype_tier_pivot")(s.decided),
    rounded=("Enterprise", "High", "Medium", "Low"),
)
_agg_query(
    "f27_action_share_in_archetype", "impacted",
    "SELECT churn_archetype, action, n AS count, round_even(n / sum(n) OVER (PARTITION BY churn_archetype) * 100, 6) AS pct"
    " FROM (SELECT churn_archetype, action, count(*) AS n FROM impacted WHERE churn_archetype IS NOT NULL"
    " AND action IS NOT NULL GROUP BY 1, 2) c",
    lambda s: _rep("action_share_in_archetype")(s.decided),
    rounded=("pct",),
)
_agg_query(
    "f28_archetype_summary", "impacted",
    "SELECT g.*, m.top_action FROM (SELECT churn_archetype, count(customer_id) AS customers,"
    " round_even(avg(churn_probability), 2) AS avg_churn_prob, round_even(avg(monthly_revenue), 2) AS avg_mrr,"
    " round_even(sum(monthly_revenue), 2) AS total_mrr, round_even(avg(clv), 2) AS avg_clv,"
    " round_even(sum(expected_revenue_saved), 2) AS total_rev_saved,"
    " round_even(avg(expected_conversion_rate), 2) AS avg_conversion, any_value(archetype_name) AS archetype_name"
    f" {_NN_ARCH} GROUP BY 1) g LEFT JOIN {_MODE_SQL} m USING (churn_archetype)",
    lambda s: _rep("archetype_summary")(s.decided),
)

_TOP_ARCH = ("(SELECT churn_archetype FROM impacted WHERE churn_archetype IS NOT NULL GROUP BY 1"
             " ORDER BY count(*) DESC, churn_archetype LIMIT 1)")
_TOP_ACTION = ("(SELECT action FROM impacted WHERE action IS NOT NULL GROUP BY 1"
               " ORDER BY sum(revenue_saved) DESC, action LIMIT 1)")
_EXEC = [
    ("Total Customers Analysed", "CAST((SELECT count(*) FROM scored2) AS DOUBLE)", "NULL"),
    ("High-Risk Customers", "CAST(total_at_risk_users AS DOUBLE)", "NULL"),
    ("High-Risk Share %", "total_at_risk_users / (SELECT count(*) FROM scored2) * 100", "NULL"),
    ("Annual MRR at Risk", "total_at_risk_mrr * 12", "NULL"),
    ("Expected Customers Retained", "expected_users_retained", "NULL"),
    ("Expected Revenue Saved (12mo)", "expected_revenue_saved", "NULL"),
    ("Total Campaign Cost", "total_campaign_cost", "NULL"),
    ("Net Incremental Profit", "net_incremental_profit", "NULL"),
    ("Campaign ROI %", "roi_pct", "NULL"),
    ("Payback Period (months)", "payback_months", "NULL"),
    ("Most Common Archetype", "CAST(NULL AS DOUBLE)", _TOP_ARCH),
    ("Highest-Revenue Action", "CAST(NULL AS DOUBLE)", _TOP_ACTION),
]
_agg_query(
    "f29_executive_summary", "impacted",
    " UNION ALL ".join(
        f"SELECT {i + 1} AS pos, '{k}' AS metric, round_even({v}, 6) AS value, CAST({t} AS VARCHAR) AS value_text"
        f" FROM ({_TOT_SQL}) x"
        for i, (k, v, t) in enumerate(_EXEC)
    ),
    lambda s: _rep("executive_summary")(s.scored, s.decided),
    rounded=("value",),
)
_agg_query(
    "f30_revenue_waterfall", "impacted",
    " UNION ALL ".join(
        f"SELECT {i} AS step, '{lbl}' AS label, round_even({v}, 6) AS value FROM (SELECT sum(monthly_revenue) AS mrr,"
        " round_even(sum(revenue_saved), 2) AS saved, round_even(sum(campaign_cost_total), 2) AS cost,"
        " round_even(sum(incremental_profit), 2) AS profit FROM impacted) t"
        for i, (lbl, v) in enumerate(
            [("MRR at Risk (12mo)", "mrr * 12"), ("Reached", "mrr * 12 * 0.85e0"), ("Revenue Saved", "saved"),
             ("Campaign Cost", "-cost"), ("Net Profit", "profit")], start=1)
    ),
    lambda s: __import__("keepwell.operators.impact", fromlist=["x"]).waterfall(s.decided),
    rounded=("value",),
)
_agg_query(
    "f31_archetype_density", "impacted",
    "SELECT c.churn_archetype, c.feature, c.bin, c.count, round_even(c.count / t.n * 50, 6) AS density FROM"
    " (SELECT churn_archetype, feature, CAST(least(50, floor(value * 50) + 1) AS INT) AS bin, count(*) AS count FROM ("
    + " UNION ALL ".join(f"SELECT churn_archetype, '{f}' AS feature, {f} AS value FROM impacted" for f in _SC6[:4])
    + ") u WHERE churn_archetype IS NOT NULL AND value IS NOT NULL GROUP BY 1, 2, 3) c JOIN"
    " (SELECT churn_archetype, feature, count(*) AS n FROM ("
    + " UNION ALL ".join(f"SELECT churn_archetype, '{f}' AS feature, {f} AS value FROM impacted" for f in _SC6[:4])
    + ") u WHERE churn_archetype IS NOT NULL AND value IS NOT NULL GROUP BY 1, 2) t USING (churn_archetype, feature)",
    lambda s: _rep("archetype_density")(s.decided),
    rounded=("density",),
)
_agg_query(
    "f32_revenue_correlation", "impacted",
    "SELECT round_even(corr(monthly_revenue, expected_revenue_saved), 6) AS correlation FROM impacted",
    lambda s: _rep("revenue_correlation")(s.decided),
    rounded=("correlation",),
)
_agg_query(
    "f34_high_risk_share", "scored",
    "SELECT count(*) FILTER (WHERE churn_probability >= 0.5e0) AS high_risk_customers,"
    " round_even(avg(CASE WHEN churn_probability >= 0.5e0 THEN 1 ELSE 0 END), 6) AS high_risk_share FROM scored",
    lambda s: _rep("high_risk_share")(s.scored),
    rounded=("high_risk_share",),
)

# ------------------------------------------------------------------ H: scenarios

_agg_query(
    "h01_scenario", "impacted",
    "SELECT round_even(rev, 6) AS revenue_saved, round_even(cost, 6) AS campaign_cost, round_even(profit, 6) AS net_profit,"
    " round_even(profit / greatest(cost, 1e0) * 100, 6) AS roi_pct FROM (SELECT"
    " sum(churn_probability * (expected_conversion_rate * 1e0) * 0.85e0 * monthly_revenue * 12) AS rev,"
    " sum(action_cost_usd * 1.2e0) AS cost,"
    " sum(churn_probability * (expected_conversion_rate * 1e0) * 0.85e0 * monthly_revenue * 12 * 0.7e0 - action_cost_usd * 1.2e0)"
    " AS profit FROM impacted) t",
    lambda s: __import__("keepwell.operators.impact", fromlist=["x"]).scenario(s.decided),
    rounded=("revenue_saved", "campaign_cost", "net_profit", "roi_pct"),
)
_agg_query(
    "h02_conversion_sensitivity", "impacted",
    "SELECT CAST(i AS INT) AS point, round_even(0.3e0 + i * 0.1e0, 6) AS multiplier,"
    " round_even((pcm * (0.3e0 + i * 0.1e0) * 0.85e0 * 12 * 0.7e0 - cost) / greatest(cost, 1e0) * 100, 6) AS roi_pct"
    " FROM (SELECT sum(churn_probability * expected_conversion_rate * monthly_revenue) AS pcm,"
    " sum(action_cost_usd * 1.2e0) AS cost FROM impacted) t, range(18) r(i)",
    lambda s: __import__("keepwell.operators.impact", fromlist=["x"]).conversion_sensitivity(s.decided),
    rounded=("multiplier", "roi_pct"),
)
_agg_query(
    "h03_conversion_reach_grid", "impacted",
    "SELECT round_even(c, 6) AS conversion, reach, round_even(round_even(pm * c * reach * 12 * 0.7e0 - cost_raw, 2)"
    " / greatest(round_even(cost_raw, 2), 1e0) * 100, 1) AS roi_pct"
    " FROM (SELECT sum(churn_probability * monthly_revenue) AS pm, sum(action_cost_usd * 1.2e0) AS cost_raw FROM impacted) t,"
    " (SELECT 0.05e0 + i * 0.05e0 AS c FROM range(9) r(i)) cg, (VALUES (0.6e0), (0.75e0), (0.85e0), (1e0)) rg(reach)",
    lambda s: __import__("keepwell.operators.impact", fromlist=["x"]).conversion_reach_sensitivity(s.decided),
    rounded=("conversion",),
)


# ------------------------------------------------------------------ J: drift and quality

from .oracle.duck import monitoring_chain  # noqa: E402
from .schema import MODEL_FEATURES  # noqa: E402


def _mon(s: Stages):
    from .operators import drift
    from .plans.monitoring import batches

    ref, prod = batches(s)
    return drift, ref, prod


@register(
    "f33_column_profile",
    monitoring_chain(
        MODEL_FEATURES,
        "SELECT side, feature, rows, n, round_even(mean, 6) AS mean, round_even(std, 6) AS std, min, max,"
        " round_even(null_pct, 6) AS null_pct FROM prof",
    ),
)
def f33_column_profile(spark, sf_dir):
    drift, ref, prod = _mon(st(spark, sf_dir))
    p = drift.column_profile(drift.both_sides(ref, prod, MODEL_FEATURES))
    return p.select("side", "feature", "rows", "n", *r6("mean", "std"), "min", "max", *r6("null_pct"))


@register("c07_null_filter", monitoring_chain(MODEL_FEATURES, "SELECT side, feature, count(*) AS values FROM vals GROUP BY 1, 2"))
def c07_null_filter(spark, sf_dir):
    drift, ref, prod = _mon(st(spark, sf_dir))
    lf = drift.both_sides(ref, prod, MODEL_FEATURES)
    return lf.filter(F.col("value").isNotNull()).groupBy("side", "feature").agg(F.count(F.lit(1)).alias("values"))


@register("j01_psi", monitoring_chain(MODEL_FEATURES, "SELECT feature, psi FROM psi"))
def j01_psi(spark, sf_dir):
    drift, ref, prod = _mon(st(spark, sf_dir))
    return drift.psi_table(drift.both_sides(ref, prod, MODEL_FEATURES))


@register("j02_psi_label", monitoring_chain(MODEL_FEATURES, "SELECT feature, psi_label FROM fdrift"))
def j02_psi_label(spark, sf_dir):
    drift, ref, prod = _mon(st(spark, sf_dir))
    p = drift.psi_table(drift.both_sides(ref, prod, MODEL_FEATURES))
    return p.select("feature", drift.psi_label(F.col("psi")).alias("psi_label"))


@register("j03_ks_statistic", monitoring_chain(MODEL_FEATURES, "SELECT feature, ks_statistic FROM ks"))
def j03_ks_statistic(spark, sf_dir):
    drift, ref, prod = _mon(st(spark, sf_dir))
    return drift.ks_table(drift.both_sides(ref, prod, MODEL_FEATURES)).select("feature", "ks_statistic")


@register("j04_ks_pvalue", monitoring_chain(MODEL_FEATURES, "SELECT feature, ks_pvalue FROM ks"))
def j04_ks_pvalue(spark, sf_dir):
    drift, ref, prod = _mon(st(spark, sf_dir))
    return drift.ks_table(drift.both_sides(ref, prod, MODEL_FEATURES)).select("feature", "ks_pvalue")


_EXACT_SQL = """SELECT z.feature, CASE WHEN n_ref < 5 OR n_prod < 5 OR k = 0 THEN 1e0 ELSE round(least(1e0, 2 * (
  SELECT sum(CASE WHEN i % 2 = 1 THEN 1 ELSE -1 END * exp(2 * lgamma(n_ref + 1e0) - lgamma(n_ref - i * k + 1e0) - lgamma(n_ref + i * k + 1e0)))
  FROM range(1, CAST(n_ref // greatest(k, 1) AS BIGINT) + 1) t(i))), 4) END AS ks_pvalue
FROM (SELECT feature, n_ref, n_prod, CAST(round(coalesce(d, 0) * n_ref) AS BIGINT) AS k FROM sizes LEFT JOIN ksd USING (feature)) z"""


# Both batches hold all customers, so the sides are equally large, for which the count of paths has a closed form.
@register("j04_ks_exact_pvalue", monitoring_chain(MODEL_FEATURES, _EXACT_SQL))
def j04_ks_exact_pvalue(spark, sf_dir):
    drift, ref, prod = _mon(st(spark, sf_dir))
    return drift.ks_table(drift.both_sides(ref, prod, MODEL_FEATURES), exact=True).select("feature", "ks_pvalue")


@register("j05_feature_drift", monitoring_chain(MODEL_FEATURES, "SELECT * FROM fdrift"))
def j05_feature_drift(spark, sf_dir):
    drift, ref, prod = _mon(st(spark, sf_dir))
    return drift.feature_drift(ref, prod, MODEL_FEATURES)


@register("j06_prediction_drift", monitoring_chain(MODEL_FEATURES, "SELECT * FROM pdrift"))
def j06_prediction_drift(spark, sf_dir):
    drift, ref, prod = _mon(st(spark, sf_dir))
    return drift.prediction_drift(ref.select("churn_probability"), prod.select("churn_probability"))


@register("j07_data_quality", monitoring_chain(MODEL_FEATURES, "SELECT * FROM quality"))
def j07_data_quality(spark, sf_dir):
    drift, ref, prod = _mon(st(spark, sf_dir))
    return drift.data_quality(ref, prod, MODEL_FEATURES)


_STATUS_SQL = """SELECT n_major, n_drifted, quality_fails, prediction_drift,
  CASE WHEN n_major >= 5 OR prediction_drift THEN '🚨 RETRAIN REQUIRED'
       WHEN n_major >= 2 OR quality_fails >= 3 THEN '⚠️ MONITOR CLOSELY' ELSE '✅ HEALTHY' END AS overall_status,
  CASE WHEN n_major >= 5 OR prediction_drift THEN printf('%d features show major drift. Trigger model retraining pipeline immediately.', n_major)
       WHEN n_major >= 2 OR quality_fails >= 3 THEN printf('%d features drifting, %d quality issues. Schedule retraining within 2 weeks.', n_major, quality_fails)
       ELSE 'Model performing within expected parameters. Next review in 30 days.' END AS recommendation
FROM (SELECT count(*) FILTER (WHERE psi >= 0.2e0) AS n_major, count(*) FILTER (WHERE drift_detected) AS n_drifted,
  (SELECT count(*) FILTER (WHERE NOT quality_ok) FROM quality) AS quality_fails,
  (SELECT bool_or(drift_detected) FROM pdrift) AS prediction_drift FROM fdrift) s"""


@register("j08_overall_status", monitoring_chain(MODEL_FEATURES, _STATUS_SQL))
def j08_overall_status(spark, sf_dir):
    drift, ref, prod = _mon(st(spark, sf_dir))
    both = drift.counted(drift.both_sides(ref, prod, MODEL_FEATURES))
    fd = drift.feature_drift(ref, prod, MODEL_FEATURES, both)
    dq = drift.data_quality(ref, prod, MODEL_FEATURES, both)
    pdr = drift.prediction_drift(ref.select("churn_probability"), prod.select("churn_probability"))
    return drift.overall_status(fd, dq, pdr)


@register(
    "j09_monitoring_run",
    monitoring_chain(
        MODEL_FEATURES,
        f"SELECT x.*, (SELECT count(*) FROM refc) AS n_reference, (SELECT count(*) FROM prodc) AS n_production"
        f" FROM ({_STATUS_SQL}) x",
    ),
)
def j09_monitoring_run(spark, sf_dir):
    from .plans.monitoring import monitor

    out = monitor(st(spark, sf_dir))
    return out["summary"].drop("run_ts")


@register(
    "j10_drift_report",
    monitoring_chain(
        MODEL_FEATURES,
        "SELECT feature, psi, psi_label AS status, ks_statistic AS ks_stat, ks_pvalue AS ks_pval, ref_mean, prod_mean,"
        " drift_detected AS drift FROM fdrift ORDER BY psi DESC, feature",
    ),
)
def j10_drift_report(spark, sf_dir):
    drift, ref, prod = _mon(st(spark, sf_dir))
    return drift.drift_report(drift.feature_drift(ref, prod, MODEL_FEATURES))


# ------------------------------------------------------------------ L: expectations

_L_SQL = """SELECT "check", coalesce(passed, FALSE) AS passed, round_even(CAST(observed AS DOUBLE), 6) AS observed FROM (
SELECT unnest([
 {'check': 'L01_required_columns', 'passed': TRUE, 'observed': 0e0},
 {'check': 'L02_customer_id_unique', 'passed': ids = rows, 'observed': CAST(rows - ids AS DOUBLE)},
 {'check': 'L03_label_binary', 'passed': bad_label = 0, 'observed': CAST(bad_label AS DOUBLE)},
 {'check': 'L04_churn_rate_in_range', 'passed': churn_rate BETWEEN 0.05e0 AND 0.45e0, 'observed': churn_rate},
 {'check': 'L05_mrr_positive', 'passed': bad_mrr = 0, 'observed': CAST(bad_mrr AS DOUBLE)},
 {'check': 'L06_tenure_at_least_1', 'passed': bad_tenure = 0, 'observed': CAST(bad_tenure AS DOUBLE)},
 {'check': 'L07_subscription_types_valid', 'passed': bad_sub = 0, 'observed': CAST(bad_sub AS DOUBLE)},
 {'check': 'L08_sentiment_in_range', 'passed': bad_sent = 0, 'observed': CAST(bad_sent AS DOUBLE)},
 {'check': 'L09_no_null_critical', 'passed': nulls = 0, 'observed': CAST(nulls AS DOUBLE)},
 {'check': 'L10_sessions_non_negative', 'passed': bad_sess = 0, 'observed': CAST(bad_sess AS DOUBLE)},
 {'check': 'L11_capacity_in_range', 'passed': bad_cap = 0, 'observed': CAST(bad_cap AS DOUBLE)},
 {'check': 'L12_enough_rows', 'passed': rows >= 100, 'observed': CAST(rows AS DOUBLE)},
 {'check': 'L13_label_minority', 'passed': churn_rate < 0.5e0, 'observed': churn_rate},
 {'check': 'L14_starter_below_enterprise_mrr', 'passed': s_mrr < e_mrr, 'observed': e_mrr - s_mrr},
 {'check': 'L15_countries', 'passed': countries >= 5, 'observed': CAST(countries AS DOUBLE)},
 {'check': 'L16_industries', 'passed': industries >= 5, 'observed': CAST(industries AS DOUBLE)}
], recursive := true)
FROM (SELECT count(*) AS rows, count(DISTINCT customer_id) AS ids,
  count(*) FILTER (WHERE NOT coalesce(churned IN (0, 1), FALSE)) AS bad_label, avg(churned) AS churn_rate,
  count(*) FILTER (WHERE NOT coalesce(monthly_revenue > 0, FALSE)) AS bad_mrr,
  count(*) FILTER (WHERE NOT coalesce(tenure_months >= 1, FALSE)) AS bad_tenure,
  count(*) FILTER (WHERE NOT coalesce(subscription_type IN ('Starter','Professional','Business','Enterprise'), FALSE)) AS bad_sub,
  count(*) FILTER (WHERE NOT coalesce(support_sentiment BETWEEN -1 AND 1, FALSE)) AS bad_sent,
  count(*) FILTER (WHERE customer_id IS NULL OR monthly_revenue IS NULL OR churned IS NULL) AS nulls,
  count(*) FILTER (WHERE NOT coalesce(sessions_30d >= 0 AND sessions_90d >= 0, FALSE)) AS bad_sess,
  count(*) FILTER (WHERE NOT coalesce(tier_capacity_utilization BETWEEN 0 AND 1, FALSE)) AS bad_cap,
  avg(monthly_revenue) FILTER (WHERE subscription_type = 'Starter') AS s_mrr,
  avg(monthly_revenue) FILTER (WHERE subscription_type = 'Enterprise') AS e_mrr,
  count(DISTINCT country) AS countries, count(DISTINCT industry) AS industries FROM mart) st) u"""


@register("l01_l16_expectations", chain("mart", _L_SQL))
def l01_l16_expectations(spark, sf_dir):
    from .operators.expectations import expectations

    e = expectations(st(spark, sf_dir).mart)
    return e.select("check", "passed", rint_to(F.col("observed"), 6).alias("observed"))


# ------------------------------------------------------------------ K: metrics and training

_K8_SQL = """SELECT tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 4) AS accuracy, round(pr, 4) AS precision,
  round(rc, 4) AS recall, round(CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0e0 END, 4) AS f1
FROM (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0e0 END AS pr, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0e0 END AS rc
FROM (SELECT count(*) FILTER (WHERE churned = 1 AND churn_probability >= 0.5e0) AS tp,
  count(*) FILTER (WHERE churned <> 1 AND churn_probability >= 0.5e0) AS fp,
  count(*) FILTER (WHERE churned = 1 AND churn_probability < 0.5e0) AS fn,
  count(*) FILTER (WHERE churned <> 1 AND churn_probability < 0.5e0) AS tn FROM scored) c) m"""


@register("k08_threshold_metrics", chain("scored", _K8_SQL))
def k08_threshold_metrics(spark, sf_dir):
    from .operators.metrics import threshold_metrics

    return threshold_metrics(st(spark, sf_dir).scored)


_PER_SCORE = ("(SELECT churn_probability AS s, count(*) FILTER (WHERE churned = 1) AS pos,"
              " count(*) FILTER (WHERE churned <> 1) AS neg FROM scored GROUP BY 1)")


@register(
    "k09_roc_auc",
    chain(
        "scored",
        "SELECT round_even(sum(pos * (cn - neg + neg / 2e0)) / (sum(pos) * sum(neg)), 6) AS roc_auc FROM"
        f" (SELECT *, sum(neg) OVER (ORDER BY s ROWS UNBOUNDED PRECEDING) AS cn FROM {_PER_SCORE} c) x",
    ),
)
def k09_roc_auc(spark, sf_dir):
    from .operators.metrics import roc_auc

    return roc_auc(st(spark, sf_dir).scored).select(rint_to(F.col("roc_auc"), 6).alias("roc_auc"))


@register(
    "k10_pr_auc",
    chain(
        "scored",
        "SELECT round_even(sum(pos / (SELECT count(*) FILTER (WHERE churned = 1) FROM scored) * cp / (cp + cn)), 6) AS pr_auc"
        f" FROM (SELECT *, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn FROM {_PER_SCORE} c"
        " WINDOW w AS (ORDER BY s DESC ROWS UNBOUNDED PRECEDING)) x",
    ),
)
def k10_pr_auc(spark, sf_dir):
    from .operators.metrics import average_precision

    return average_precision(st(spark, sf_dir).scored).select(rint_to(F.col("pr_auc"), 6).alias("pr_auc"))


@register(
    "k02_class_weights",
    chain("mart", "SELECT churned, round_even((SELECT count(*) FROM mart) / (2e0 * count(*)), 6) AS weight FROM mart GROUP BY 1"),
)
def k02_class_weights(spark, sf_dir):
    from .operators.train import class_weights

    w = class_weights(st(spark, sf_dir).mart)
    return w.select("churned", rint_to(F.col("weight"), 6).alias("weight"))


@register(
    "k01_stratified_split",
    chain("mart", "SELECT churned, is_test, CASE WHEN is_test THEN CAST(ceil(n * 0.2e0) AS BIGINT) ELSE n - CAST(ceil(n * 0.2e0) AS BIGINT) END AS rows"
          " FROM (SELECT churned, count(*) AS n FROM mart GROUP BY churned) c, (VALUES (TRUE), (FALSE)) v(is_test)"),
)
def k01_stratified_split(spark, sf_dir):
    from .operators.train import stratified_split

    s = stratified_split(st(spark, sf_dir).mart)
    return s.groupBy("churned", "is_test").agg(F.count(F.lit(1)).alias("rows"))


@register("k12_model_comparison", None)
def k12_model_comparison(spark, sf_dir):
    from .operators.train import compare_models

    table, _, _, _ = compare_models(st(spark, sf_dir).features, cv_folds=5)
    return table


@register("k18_quality_gates", None)
def k18_quality_gates(spark, sf_dir):
    from .operators.train import compare_models, quality_gates

    _, _, _, best = compare_models(st(spark, sf_dir).features)
    rows = [(g, bool(p), float(o) if o is not None else None) for g, p, o in quality_gates(best)]
    return spark.createDataFrame(rows, "gate string, passed boolean, observed double")


# ------------------------------------------------------------------ M: attribution (linear, exact)

from .operators.explain import BASELINE_WEIGHTS  # noqa: E402

_W_SQL = {k: repr(v) + ("e0" if "e" not in repr(v) else "") for k, v in BASELINE_WEIGHTS.items()}
_W_SQL["billing_page_visits"] = "(1.5e0 / 5)"
_W_SQL["downgrade_page_visits"] = "(1.2e0 / 3)"
_BGM = "bgm AS (SELECT " + ", ".join(f"avg(CAST({f} AS DOUBLE)) AS m_{f}" for f in BASELINE_WEIGHTS) + " FROM scored2)"
_ATT = "att AS (" + " UNION ALL ".join(
    f"SELECT customer_id, churn_probability, {i} AS pos, '{f}' AS feature, "
    + (f"{_W_SQL[f]} * (coalesce(CAST({f} AS DOUBLE), 0e0) - m_{f})" if f in BASELINE_WEIGHTS else "0e0")
    + f" AS shap_value, coalesce(CAST({f} AS DOUBLE), 0e0) AS feature_value FROM impacted, bgm"
    for i, f in enumerate(MODEL_FEATURES)
) + ")"
_TOPK = ("topk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY abs(shap_value) DESC,"
         " pos DESC) AS rank FROM att) x WHERE rank <= 5)")
_IMP = "imp AS (SELECT pos, feature, avg(abs(shap_value)) AS mean_abs_shap FROM att GROUP BY pos, feature)"


def _m_chain(body: str) -> str:
    base = chain("impacted", "SELECT 1").removesuffix("\nSELECT 1").rstrip()
    return base + f",\n{_BGM},\n{_ATT},\n{_TOPK},\n{_IMP}\n" + body


def _att(s: Stages):
    from .operators import explain

    return explain, s.decided, s.scored


@register("m03_linear_attribution", _m_chain("SELECT customer_id, feature, round_even(shap_value, 6) AS shap_value FROM att"))
def m03_linear_attribution(spark, sf_dir):
    ex, d, bg = _att(st(spark, sf_dir))
    la = ex.long_attribution(d, background=bg)
    return la.select("customer_id", "feature", rint_to(F.col("shap_value"), 6).alias("shap_value"))


_M4_SQL = ("SELECT customer_id, CAST(rank AS INT) AS rank, feature, round(shap_value, 4) AS shap_value,"
           " round(feature_value, 4) AS feature_value,"
           " CASE WHEN shap_value > 0 THEN 'increases' ELSE 'decreases' END AS direction FROM topk")


@register("m04_customer_explanation", _m_chain(_M4_SQL))
def m04_customer_explanation(spark, sf_dir):
    ex, d, bg = _att(st(spark, sf_dir))
    e = ex.explain(d, background=bg)
    return e.select("customer_id", F.inline("top_drivers")).select(
        "customer_id", "rank", "feature", "shap_value", "feature_value", "direction"
    )


@register("i04_top_k_drivers", _m_chain("SELECT customer_id, CAST(rank AS INT) AS rank, feature FROM topk"))
def i04_top_k_drivers(spark, sf_dir):
    ex, d, bg = _att(st(spark, sf_dir))
    return ex.explain(d, background=bg).select("customer_id", F.inline("top_drivers")).select("customer_id", "rank", "feature")


_BULLET = ("'  • ' || feature || ' (SHAP=' || printf('%+.3f', round(shap_value, 4)) || ') — '"
           " || CASE WHEN shap_value > 0 THEN 'increases' ELSE 'decreases' END || ' churn risk'")


@register(
    "m05_narrative",
    _m_chain(f"SELECT customer_id, 'Customer ' || customer_id || ' has a ' || printf('%.0f', round(any_value(churn_probability), 4) * 100)"
             f" || '% churn probability.' || chr(10) || 'Top drivers:' || chr(10) || string_agg({_BULLET}, chr(10) ORDER BY rank)"
             " AS narrative FROM topk GROUP BY customer_id"),
)
def m05_narrative(spark, sf_dir):
    ex, d, bg = _att(st(spark, sf_dir))
    return ex.narrative(ex.explain(d, background=bg))


_M6_SQL = (
    "SELECT customer_id, round(any_value(churn_probability), 4) AS churn_probability,"
    " any_value(feature) FILTER (WHERE rank = 1) AS primary_driver, "
    + ", ".join(
        f"any_value(feature) FILTER (WHERE rank = {k}) AS driver_{k}_feature,"
        f" round(any_value(shap_value) FILTER (WHERE rank = {k}), 4) AS driver_{k}_shap"
        for k in range(1, 6)
    )
    + " FROM topk GROUP BY customer_id"
)


@register("m06_batch_explanation", _m_chain(_M6_SQL))
def m06_batch_explanation(spark, sf_dir):
    ex, d, bg = _att(st(spark, sf_dir))
    return ex.batch_explanations(d, 0.5, background=bg)


@register("m07_global_importance", _m_chain("SELECT feature, round_even(mean_abs_shap, 6) AS mean_abs_shap FROM imp"))
def m07_global_importance(spark, sf_dir):
    ex, d, bg = _att(st(spark, sf_dir))
    g = ex.global_importance(d, background=bg)
    return g.select("feature", rint_to(F.col("mean_abs_shap"), 6).alias("mean_abs_shap"))


@register(
    "m08_above_median",
    _m_chain("SELECT feature, round_even(mean_abs_shap, 6) AS mean_abs_shap,"
             " mean_abs_shap > (SELECT median(mean_abs_shap) FROM imp) AS above_median FROM imp"),
)
def m08_above_median(spark, sf_dir):
    ex, d, bg = _att(st(spark, sf_dir))
    a = ex.above_median(ex.global_importance(d, background=bg))
    return a.select("feature", rint_to(F.col("mean_abs_shap"), 6).alias("mean_abs_shap"), "above_median")


@register(
    "i05_top10_importance",
    _m_chain("SELECT feature, round_even(mean_abs_shap, 6) AS mean_abs_shap FROM imp ORDER BY mean_abs_shap DESC, pos LIMIT 10"),
)
def i05_top10_importance(spark, sf_dir):
    ex, d, bg = _att(st(spark, sf_dir))
    g = ex.global_importance(d, background=bg).limit(10)
    return g.select("feature", rint_to(F.col("mean_abs_shap"), 6).alias("mean_abs_shap"))


@register(
    "m09_dependence",
    _m_chain("SELECT customer_id, feature, feature_value, round_even(shap_value, 6) AS shap_value,"
             " round_even(churn_probability, 6) AS churn_probability FROM att"
             " WHERE feature IN ('days_since_last_login', 'support_sentiment')"),
)
def m09_dependence(spark, sf_dir):
    ex, d, bg = _att(st(spark, sf_dir))
    x = ex.dependence(d, background=bg)
    return x.select("customer_id", "feature", "feature_value", *r6("shap_value", "churn_probability"))


@register("m10_placeholder_driver", chain("impacted", "SELECT customer_id, 'engagement_decay_score' AS primary_driver FROM impacted"))
def m10_placeholder_driver(spark, sf_dir):
    return st(spark, sf_dir).decided.select("customer_id", "primary_driver")


_GROUPS_SQL = "(VALUES " + ", ".join(
    f"('{g}', '{f}')" for g, fs in __import__("keepwell.operators.explain", fromlist=["x"]).FEATURE_GROUPS.items() for f in fs
) + ") grp(feature_group, feature)"


@register(
    "f18_importance_by_group",
    _m_chain(f"SELECT feature_group, round_even(sum(mean_abs_shap), 6) AS importance FROM imp JOIN {_GROUPS_SQL} USING (feature)"
             " GROUP BY feature_group"),
)
def f18_importance_by_group(spark, sf_dir):
    ex, d, bg = _att(st(spark, sf_dir))
    g = ex.importance_by_group(ex.global_importance(d, background=bg))
    return g.select("feature_group", rint_to(F.col("importance"), 6).alias("importance"))


@register(
    "d01_driver_left_join",
    _m_chain("SELECT i.customer_id, t.feature AS primary_driver FROM impacted i LEFT JOIN (SELECT customer_id, feature"
             " FROM topk WHERE rank = 1) t USING (customer_id)"),
)
def d01_driver_left_join(spark, sf_dir):
    ex, d, bg = _att(st(spark, sf_dir))
    drivers = ex.batch_explanations(d, 0.0, background=bg).select("customer_id", "primary_driver")
    return d.select("customer_id").join(drivers, "customer_id", "left")


# ------------------------------------------------------------------ G: star schema and measures

_ARCH_VALUES = "(VALUES (1, 'A'), (2, 'B'), (3, 'C'), (4, 'D')) av(archetype_id, churn_archetype)"


def _actions_sql() -> str:
    from .operators.rules import load_rules

    rs = load_rules()
    rows = [(r.action_code, r.action, r.channel, r.urgency, r.expected_conversion_rate, r.cost_usd) for r in rs.rules]
    f = rs.fallback
    rows.append((f["action_code"], f["action"], f["channel"], f["urgency"], float(f["expected_conversion_rate"]), float(f["cost_usd"])))
    vals = ", ".join(
        "(" + ", ".join(("'" + str(x).replace("'", "''") + "'") if isinstance(x, str) else f"CAST({x!r} AS DOUBLE)" for x in r) + ")"
        for r in rows
    )
    return (f"(SELECT CAST(dense_rank() OVER (ORDER BY action_code) AS INT) AS action_id, * FROM (VALUES {vals})"
            " t(action_code, action_name, channel, urgency, expected_conversion_rate, base_cost_usd))")


_FACT_SQL = (
    f"fact AS (SELECT i.customer_id, av.archetype_id, ac.action_id,"
    f" CAST(strftime((SELECT max(CAST(o_orderdate AS DATE)) FROM orders), '%Y%m%d') AS INT) AS date_id,"
    f" i.churn_probability, i.churn_risk_level, 'engagement_decay_score' AS primary_driver, i.expected_revenue_saved,"
    f" i.campaign_roi, i.clv, i.expected_conversion_rate, i.action_cost_usd, i.monthly_revenue"
    f" FROM impacted i LEFT JOIN {_ARCH_VALUES} USING (churn_archetype) LEFT JOIN {_actions_sql()} ac ON ac.action_code = i.action_code)"
)


def _g_chain(body: str) -> str:
    base = chain("impacted", "SELECT 1").removesuffix("\nSELECT 1").rstrip()
    return base + ",\n" + _FACT_SQL + "\n" + body


_FACT_COLS = ["customer_id", "archetype_id", "action_id", "date_id", "churn_risk_level", "primary_driver",
              "expected_revenue_saved", "campaign_roi", "clv", "expected_conversion_rate", "action_cost_usd"]


@register("g01_fact_churn_predictions", _g_chain(f"SELECT {', '.join(_FACT_COLS)}, {s6('churn_probability')} FROM fact"))
def g01_fact_churn_predictions(spark, sf_dir):
    from .plans.star import fact_predictions

    f = fact_predictions(st(spark, sf_dir))
    return f.select(*_FACT_COLS, *r6("churn_probability"))


@register(
    "g02_dim_customers",
    chain("impacted", "SELECT DISTINCT customer_id, subscription_type, monthly_revenue, tenure_months, country, industry,"
          " clv_tier FROM impacted"),
)
def g02_dim_customers(spark, sf_dir):
    from .plans.star import dim_customers

    return dim_customers(st(spark, sf_dir).decided)


@register(
    "g05_dim_date",
    chain(
        "mart",
        "SELECT CAST(strftime(d, '%Y%m%d') AS INT) AS date_id, CAST(CAST(d AS DATE) AS VARCHAR) AS date, CAST(year(d) AS INT) AS year,"
        " CAST(quarter(d) AS INT) AS quarter, CAST(month(d) AS INT) AS month, strftime(d, '%B') AS month_name,"
        " CAST(weekofyear(d) AS INT) AS week, strftime(d, '%A') AS day_of_week FROM (SELECT unnest(generate_series("
        "(SELECT min(CAST(o_orderdate AS DATE)) FROM orders), (SELECT max(CAST(o_orderdate AS DATE)) FROM orders),"
        " INTERVAL 1 DAY)) AS d) s",
    ),
)
def g05_dim_date(spark, sf_dir):
    from .plans.star import dim_date

    d = dim_date(st(spark, sf_dir))
    return d.withColumn("date", F.col("date").cast("string"))


_G_MEASURES = (
    "SELECT round_even(sum(expected_revenue_saved), 6) AS total_revenue_saved,"
    " round_even(avg(churn_probability), 6) AS avg_churn_probability,"
    " count(*) FILTER (WHERE churn_risk_level IN ('HIGH', 'CRITICAL')) AS high_risk_customers,"
    " round_even(CASE WHEN sum(action_cost_usd) = 0 THEN 0e0 ELSE (sum(expected_revenue_saved) - sum(action_cost_usd))"
    " / sum(action_cost_usd) END, 6) AS bi_campaign_roi,"
    " round_even(sum(monthly_revenue * 12) FILTER (WHERE churn_probability >= 0.5e0), 6) AS revenue_at_risk,"
    " round_even(1 - avg(churn_probability), 6) AS customer_health_index,"
    " round_even(coalesce(sum(churn_probability * fact.expected_conversion_rate) / count(*), 0e0), 6) AS predicted_retention_rate,"
    " round_even(avg(monthly_revenue * 18), 6) AS weighted_avg_clv,"
    " count(*) FILTER (WHERE a.urgency = 'critical') AS critical_actions"
    f" FROM fact LEFT JOIN {_actions_sql()} a USING (action_id)"
)
_G_COLS = ("total_revenue_saved", "avg_churn_probability", "bi_campaign_roi", "revenue_at_risk", "customer_health_index",
           "predicted_retention_rate", "weighted_avg_clv")


@register("g06_g14_bi_measures", _g_chain(_G_MEASURES))
def g06_g14_bi_measures(spark, sf_dir):
    from .plans.star import dim_actions, dim_customers, fact_predictions, measures

    s = st(spark, sf_dir)
    m = measures(fact_predictions(s), dim_customers(s.decided), dim_actions(spark))
    return m.select(*[rint_to(F.col(c), 6).alias(c) if c in _G_COLS else F.col(c) for c in m.columns])


@register(
    "g11_top_archetype",
    _g_chain("SELECT archetype_id, round_even(sum(monthly_revenue * 12) FILTER (WHERE churn_probability >= 0.5e0), 6)"
             " AS revenue_at_risk FROM fact GROUP BY archetype_id ORDER BY revenue_at_risk DESC, archetype_id LIMIT 1"),
)
def g11_top_archetype(spark, sf_dir):
    from .plans.star import dim_customers, fact_predictions, top_archetype

    s = st(spark, sf_dir)
    t = top_archetype(fact_predictions(s), dim_customers(s.decided))
    return t.select("archetype_id", rint_to(F.col("revenue_at_risk"), 6).alias("revenue_at_risk"))


@register("k11_cross_validation", None)
def k11_cross_validation(spark, sf_dir):
    from .operators.train import cross_validation

    return cross_validation(st(spark, sf_dir).features)


# ------------------------------------------------------------------ K, M: the trained champion


def _training(spark, sf_dir, **how):
    from .plans.training import Training

    return Training(st(spark, sf_dir), **how)


@register("k13_champion", None)
def k13_champion(spark, sf_dir):
    # A boosted champion is tuned by random search before it is saved; its metadata are those of the comparison.
    return _training(spark, sf_dir, tune=True).metadata()


@register("k16_champion_scores", None)
def k16_champion_scores(spark, sf_dir):
    return _training(spark, sf_dir).scoring().scored.select("customer_id", "churn_probability", "churn_risk_level")


@register("k16_champion_recommendations", None)
def k16_champion_recommendations(spark, sf_dir):
    return _training(spark, sf_dir).recommendations()


@register("k20_run_log", None)
def k20_run_log(spark, sf_dir):
    return _training(spark, sf_dir).log()


def _one_model(spark, sf_dir, name: str):
    """(its high-risk customers with their vector, the model, the training side) of one model of the zoo."""
    from .operators.scoring import score_model
    from .operators.train import Comparison, fit_together
    from .session import materialize

    features = st(spark, sf_dir).features
    comparison = Comparison(features, folds=0)
    model = fit_together({name: comparison.jobs(False)[name, None]})[name]
    # Read several times, and kept apart from the long expressions of the features.
    vectors = materialize(comparison.scaler.transform(features).select("customer_id", "features"))
    high = score_model(vectors, model).filter(F.col("churn_probability") >= 0.5)
    return high, model, comparison.train


@register("m01_tree_attribution", None)
def m01_tree_attribution(spark, sf_dir):
    from .operators.tree_attribution import tree_attribution

    high, model, _ = _one_model(spark, sf_dir, "gbt_a")
    return tree_attribution(high, model).select("customer_id", "churn_probability", "base_value", F.inline("phi"))


@register("m02_sampled_attribution", None)
def m02_sampled_attribution(spark, sf_dir):
    from .operators.sampled_attribution import background_rows, sampled_attribution

    high, model, train = _one_model(spark, sf_dir, "logistic_regression")
    return sampled_attribution(high, model, background_rows(train))


# ------------------------------------------------------------------ N: the report as a dataset

_REPORT = {
    "kpis": (
        "''", ["customers", "total_revenue_saved", "avg_churn_probability", "total_cost", "net_profit", "report_roi_pct"], [],
        "SELECT *, saved AS total_revenue_saved, saved * 0.7e0 - cost * 1.2e0 AS net_profit, cost AS total_cost,"
        " (saved * 0.7e0 - cost * 1.2e0) / greatest(cost, 1e0) * 100 AS report_roi_pct FROM (SELECT count(*) AS customers,"
        " coalesce(sum(expected_revenue_saved), 0e0) AS saved, avg(churn_probability) AS avg_churn_probability,"
        " coalesce(sum(action_cost_usd), 0e0) AS cost FROM impacted) k",
    ),
    "archetypes": (
        "churn_archetype", ["customers", "avg_churn_probability", "revenue_saved"], ["top_action", "archetype_name"],
        "SELECT churn_archetype, customers, avg_churn_probability, revenue_saved, top_action, archetype_name FROM (SELECT churn_archetype,"
        " count(*) AS customers, avg(churn_probability) AS avg_churn_probability, sum(expected_revenue_saved) AS revenue_saved,"
        f" any_value(archetype_name) AS archetype_name {_NN_ARCH} GROUP BY churn_archetype) g LEFT JOIN {_MODE_SQL} m USING (churn_archetype)",
    ),
    "urgency": (
        "urgency", ["count", "pct_of_total"], [],
        "SELECT urgency, count(*) AS count, count(*) / (SELECT count(*) FROM impacted) * 100e0 AS pct_of_total FROM impacted"
        " WHERE urgency IS NOT NULL GROUP BY urgency",
    ),
    "top_customers": (
        "customer_id", ["monthly_revenue", "churn_probability", "expected_revenue_saved"], ["subscription_type", "archetype_name", "action"],
        "SELECT * FROM impacted ORDER BY expected_revenue_saved DESC, customer_id LIMIT 10",
    ),
    "importance": ("feature", ["mean_abs_shap"], [], "SELECT * FROM imp ORDER BY mean_abs_shap DESC, pos LIMIT 10"),
    "actions": (
        "action", ["count", "total_rev_saved", "avg_conversion"], [],
        "SELECT action, count(*) AS count, round_even(sum(expected_revenue_saved), 3) AS total_rev_saved,"
        " round_even(avg(expected_conversion_rate), 3) AS avg_conversion FROM impacted WHERE action IS NOT NULL GROUP BY action",
    ),
}


def _report_sql(section: str) -> str:
    item, numbers, texts, body = _REPORT[section]
    parts = [f"{{'metric': '{c}', 'value': round_even(CAST({c} AS DOUBLE), 6), 'text': CAST(NULL AS VARCHAR)}}" for c in numbers]
    parts += [f"{{'metric': '{c}', 'value': CAST(NULL AS DOUBLE), 'text': {c}}}" for c in texts]
    return f"SELECT '{section}' AS section, {item} AS item, unnest([{', '.join(parts)}], recursive := true) FROM ({body}) t_{section}"


@register("n01_report", _m_chain(" UNION ALL ".join(f"SELECT * FROM ({_report_sql(x)}) s_{x}" for x in _REPORT)))
def n01_report(spark, sf_dir):
    """The report of this run, written and read back, as one long table."""
    from functools import reduce
    from uuid import uuid4

    from .plans.report import read_report, report_tables, write_report
    from .session import ensure_checkpoint_dir

    folder = f"{ensure_checkpoint_dir(spark)}/report-{uuid4().hex}"
    version = write_report(report_tables(st(spark, sf_dir)), folder)
    parts = []
    for section, table in read_report(spark, folder, version).items():
        item, numbers, texts, _ = _REPORT[section]
        none = F.lit(None)
        cells = [F.struct(F.lit(c).alias("metric"), rint_to(F.col(c).cast("double"), 6).alias("value"), none.cast("string").alias("text")) for c in numbers]
        cells += [F.struct(F.lit(c).alias("metric"), none.cast("double").alias("value"), F.col(c).alias("text")) for c in texts]
        name = F.lit("") if item == "''" else F.col(item)
        parts.append(table.select(F.lit(section).alias("section"), name.alias("item"), F.inline(F.array(*cells))))
    return reduce(DataFrame.unionByName, parts)


# ------------------------------------------------------------------ G15: page queries


def _star(spark, sf_dir):
    from .plans import star

    s = st(spark, sf_dir)
    return star, s, star.fact_predictions(s)


@register(
    "g15_revenue_at_risk_by_subscription",
    _g_chain("SELECT i.subscription_type, count(*) FILTER (WHERE f.churn_probability >= 0.5e0) AS customers_at_risk,"
             " round_even(sum(i.monthly_revenue * 12) FILTER (WHERE f.churn_probability >= 0.5e0), 6) AS revenue_at_risk"
             " FROM fact f JOIN impacted i USING (customer_id) GROUP BY i.subscription_type"),
)
def g15_revenue_at_risk_by_subscription(spark, sf_dir):
    star, s, fact = _star(spark, sf_dir)
    out = star.revenue_at_risk_by_subscription(fact, star.dim_customers(s.decided))
    return out.select("subscription_type", "customers_at_risk", *r6("revenue_at_risk"))


@register(
    "g15_archetype_tier_matrix",
    chain("impacted", "SELECT churn_archetype, " + ", ".join(f"count(*) FILTER (WHERE clv_tier = '{t}') AS {t.lower()}" for t in ("Enterprise", "High", "Medium", "Low"))
          + " FROM impacted WHERE churn_archetype IS NOT NULL GROUP BY churn_archetype"),
)
def g15_archetype_tier_matrix(spark, sf_dir):
    from .plans.star import archetype_tier_matrix

    return archetype_tier_matrix(st(spark, sf_dir).decided)


@register(
    "g15_riskiest_with_action",
    _g_chain("SELECT customer_id, round_even(churn_probability, 6) AS churn_probability, churn_risk_level, a.action_name, a.channel, a.urgency,"
             f" expected_revenue_saved FROM (SELECT * FROM fact ORDER BY churn_probability DESC, customer_id LIMIT 20) f LEFT JOIN {_actions_sql()} a USING (action_id)"),
)
def g15_riskiest_with_action(spark, sf_dir):
    star, _, fact = _star(spark, sf_dir)
    out = star.riskiest_with_action(fact, star.dim_actions(spark))
    return out.withColumn("churn_probability", rint_to(F.col("churn_probability"), 6))


@register(
    "g15_roi_by_archetype",
    _g_chain("SELECT archetype_id, round_even(sum(expected_revenue_saved), 6) AS revenue_saved, round_even(sum(action_cost_usd), 6) AS cost,"
             " round_even(CASE WHEN sum(action_cost_usd) = 0 THEN 0e0 ELSE (sum(expected_revenue_saved) - sum(action_cost_usd)) / sum(action_cost_usd) END, 6)"
             " AS roi FROM fact GROUP BY archetype_id"),
)
def g15_roi_by_archetype(spark, sf_dir):
    star, _, fact = _star(spark, sf_dir)
    return star.roi_by_archetype(fact).select("archetype_id", *r6("revenue_saved", "cost", "roi"))


@register(
    "g15_funnel",
    _g_chain("SELECT step, stage, round_even(customers, 6) AS customers FROM (SELECT unnest([{'step': 1, 'stage': 'at_risk', 'customers': CAST(n AS DOUBLE)},"
             " {'step': 2, 'stage': 'contacted', 'customers': n * 0.85e0}, {'step': 3, 'stage': 'converted', 'customers': c * 0.85e0}], recursive := true)"
             " FROM (SELECT count(*) AS n, coalesce(sum(expected_conversion_rate), 0e0) AS c FROM fact WHERE churn_probability >= 0.5e0) s) t"),
)
def g15_funnel(spark, sf_dir):
    star, _, fact = _star(spark, sf_dir)
    return star.funnel(fact).select("step", "stage", *r6("customers"))


@register(
    "g15_trend_by_date",
    _g_chain("SELECT date_id, round_even(avg(churn_probability), 6) AS avg_churn_probability, count(*) AS customers, CAST(date_id // 10000 AS INT) AS year,"
             " CAST(date_id // 100 % 100 AS INT) AS month, CAST(weekofyear(strptime(CAST(date_id AS VARCHAR), '%Y%m%d')) AS INT) AS week FROM fact GROUP BY date_id"),
)
def g15_trend_by_date(spark, sf_dir):
    star, s, fact = _star(spark, sf_dir)
    return star.trend_by_date(fact, star.dim_date(s)).withColumn("avg_churn_probability", rint_to(F.col("avg_churn_probability"), 6))


# ------------------------------------------------------------------ A: round trips through sources and sinks


def _folder(spark, name: str) -> str:
    from uuid import uuid4

    from .session import ensure_checkpoint_dir

    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid4().hex}"


_CUSTOMER_COLS = MART_COLS[1:]


@register("a01_csv_round_trip", chain("mart", f"SELECT {', '.join(_CUSTOMER_COLS)} FROM mart"))
def a01_csv_round_trip(spark, sf_dir):
    """The raw snapshot as CSV, read back by the checked reader."""
    from .sources.readers import read_checked, write_table

    path = _folder(spark, "customers-csv")
    write_table(st(spark, sf_dir).mart.select(*_CUSTOMER_COLS), path, "csv")
    return read_checked(spark, path).accepted.select(*_CUSTOMER_COLS)


_BROKEN = "CASE WHEN c_custkey % 11 = 0 THEN 'malformed' WHEN c_custkey % 7 = 0 THEN 'customer_id is missing' ELSE 'accepted' END"


@register("a08_bad_records", chain("mart", f"SELECT {_BROKEN} AS reason, count(*) AS records FROM mart GROUP BY 1"))
def a08_bad_records(spark, sf_dir):
    """JSON records of which every 11th is broken and every 7th has no id: counts of the accepted and the rejected ones."""
    from .sources.readers import read_checked

    path = _folder(spark, "customers-json")
    mart = st(spark, sf_dir).mart
    record = F.to_json(F.struct(*[F.when(F.col("c_custkey") % 7 != 0, F.col(c)).alias(c) if c == "customer_id" else F.col(c) for c in _CUSTOMER_COLS]))
    broken = F.when(F.col("c_custkey") % 11 == 0, F.concat(F.lit("{"), record)).otherwise(record)
    mart.select(broken.alias("value")).write.text(path)
    return read_checked(spark, path, "json").counts()


@register(
    "a08_records_with_defaults",
    chain("mart", "SELECT customer_id, CASE WHEN c_custkey % 5 = 0 THEN 8 ELSE sessions_30d END AS sessions_30d,"
          " CASE WHEN c_custkey % 3 = 0 THEN 199e0 ELSE monthly_revenue END AS monthly_revenue, ticket_count FROM mart"),
)
def a08_records_with_defaults(spark, sf_dir):
    from .sources.readers import read_records_json

    path = _folder(spark, "records-json")
    holes = {"sessions_30d": F.when(F.col("c_custkey") % 5 != 0, F.col("sessions_30d")), "monthly_revenue": F.when(F.col("c_custkey") % 3 != 0, F.col("monthly_revenue"))}
    st(spark, sf_dir).mart.withColumns(holes).select(*_CUSTOMER_COLS).write.json(path)
    return read_records_json(spark, path).select("customer_id", "sessions_30d", "monthly_revenue", "ticket_count")


def _sink_query(name: str, of: str, write):
    """The rows of query ``of`` through a sink and back."""
    rows_of, sql = QUERIES[of]

    @register(name, sql)
    def q(spark, sf_dir):
        from .sources.readers import read_table

        rows, path = rows_of(spark, sf_dir), _folder(spark, name)
        write(rows, path)
        return read_table(spark, path).select(*rows.columns)


def _write_parquet(rows, path):
    from .sources.readers import write_table

    write_table(rows, path)


def _write_stamped(rows, path):
    from .sources.readers import write_stamped

    write_stamped(rows, path)


_sink_query("a10_engineered_features_sink", "b13_feature_transformer", _write_parquet)
_sink_query("a12_explanation_sink", "m06_batch_explanation", _write_parquet)
_sink_query("a12_importance_sink", "m07_global_importance", _write_parquet)
_sink_query("a13_drift_report_sink", "j10_drift_report", _write_stamped)
