"""Independent DuckDB SQL for the correctness check.

Each stage is one CTE written directly in DuckDB's dialect (``e0`` literals
so every fraction is DOUBLE, ``round_even`` for half-even rounding, explicit
tie-break keys).  ``chain(stage, body)`` returns ``WITH <all stages up to
stage> <body>``.
"""

from __future__ import annotations

from ..operators.rules import SUFFIX_OPS, load_rules


def clip(x: str, lo: str = "0e0", hi: str = "1e0") -> str:
    return f"(CASE WHEN ({x}) IS NULL THEN NULL ELSE greatest({lo}, least({hi}, {x})) END)"


def neg(x: str) -> str:
    return f"(CASE WHEN ({x}) < 0 THEN -({x}) ELSE 0e0 END)"


def r(x: str, d: int) -> str:
    return f"round_even({x}, {d})"


MART = """
ref_day AS (SELECT max(CAST(o_orderdate AS DATE)) AS d FROM orders),
ord AS (
  SELECT o_orderkey, o_custkey AS k, o_orderstatus AS st, o_orderpriority AS pr,
         datediff('day', CAST(o_orderdate AS DATE), r.d) AS age
  FROM orders CROSS JOIN ref_day r),
o AS (
  SELECT k, min(age) AS rec, min(CASE WHEN st = 'F' THEN age END) AS rec_core,
         sum(CASE WHEN pr = '1-URGENT' THEN 1 ELSE 0 END) AS urgent,
         sum(CASE WHEN pr = '5-LOW' THEN 1 ELSE 0 END) AS low
  FROM ord GROUP BY k),
l AS (
  SELECT k, count(*) AS n,
         sum(CASE WHEN age < 365 THEN 1 ELSE 0 END) AS n1,
         sum(CASE WHEN age < 1095 THEN 1 ELSE 0 END) AS n3,
         sum(CASE WHEN age < 730 THEN 1 ELSE 0 END) AS n2,
         sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS ret,
         sum(CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 1 ELSE 0 END) AS ret_open,
         sum(CASE WHEN l_discount >= 0.085e0 THEN 1 ELSE 0 END) AS disc9,
         sum(CASE WHEN l_discount >= 0.095e0 THEN 1 ELSE 0 END) AS disc10,
         sum(CASE WHEN l_tax >= 0.045e0 THEN 1 ELSE 0 END) AS taxed,
         sum(CASE WHEN l_quantity >= 45e0 THEN 1 ELSE 0 END) AS bulk,
         CAST(sum(l_quantity) AS BIGINT) AS qty
  FROM ord JOIN lineitem ON l_orderkey = o_orderkey GROUP BY k),
e AS (
  SELECT user_id AS k, count(*) AS n,
         sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS err,
         sum(CASE WHEN event_type = 'click' AND value < 5e0 THEN 1 ELSE 0 END) AS rage
  FROM events GROUP BY user_id),
mart0 AS (
SELECT c_custkey,
  concat('CUST-', lpad(CAST(c_custkey + 1 AS VARCHAR), CAST(greatest(6, length(CAST(c_custkey + 1 AS VARCHAR))) AS INTEGER), '0')) AS customer_id,
  CASE WHEN c_acctbal < 3400e0 THEN 'Starter' WHEN c_acctbal < 6700e0 THEN 'Professional'
       WHEN c_acctbal < 8900e0 THEN 'Business' ELSE 'Enterprise' END AS subscription_type,
  CASE WHEN c_acctbal < 3400e0 THEN 29e0 + (c_custkey * 7919 % 5001) / 100e0
       WHEN c_acctbal < 6700e0 THEN 99e0 + (c_custkey * 7919 % 20001) / 100e0
       WHEN c_acctbal < 8900e0 THEN 399e0 + (c_custkey * 7919 % 60001) / 100e0
       ELSE 1500e0 + (c_custkey * 7919 % 350001) / 100e0 END AS monthly_revenue,
  CAST(1 + (c_custkey * 31 % 84) AS INT) AS tenure_months,
  n_name AS country, c_mktsegment AS industry,
  CAST(least(120, coalesce(l.n1, 0)) AS INT) AS sessions_30d,
  CAST(least(300, coalesce(l.n3, 0)) AS INT) AS sessions_90d,
  CAST(least(90, floor(coalesce(o.rec, 2400) / 12e0)) AS INT) AS days_since_last_login,
  CAST(least(90, floor(coalesce(o.rec_core, 2400) / 24e0)) AS INT) AS days_since_last_core_action,
  CASE WHEN coalesce(l.n2, 0) = 0 THEN 0e0
       ELSE (2 * l.n1 - l.n2) / CAST(l.n2 AS DOUBLE) END AS login_frequency_change,
  (c_custkey * 13 % 201 - 100) / 100e0 AS session_duration_change,
  CAST(least(20, coalesce(o.urgent, 0) * CASE WHEN c_custkey % 6 = 1 THEN 5 ELSE 1 END) AS INT) AS ticket_count,
  greatest(-1e0, (coalesce(l.n, 0) - 3e0 * coalesce(l.ret, 0)) / greatest(1, coalesce(l.n, 0))
    - CASE WHEN c_custkey % 6 = 1 THEN 0.75e0 ELSE 0e0 END) AS support_sentiment,
  CASE WHEN c_custkey % 12 = 1 THEN 0.75e0
       WHEN coalesce(e.n, 0) = 0 THEN (c_custkey % 31) / 100e0
       ELSE e.err / CAST(e.n AS DOUBLE) END AS error_rate,
  CAST(least(50, coalesce(l.ret_open, 0) * CASE WHEN c_custkey % 12 = 1 THEN 4 ELSE 1 END) AS INT) AS failed_api_calls,
  CAST(least(30, CASE WHEN c_custkey % 12 = 1 THEN 24 ELSE coalesce(e.rage, c_custkey % 4) END) AS INT) AS rage_click_count,
  CAST(least(20, CASE WHEN c_custkey % 6 = 2 THEN 2 * coalesce(l.disc9, 0) ELSE floor(coalesce(l.disc10, 0) / 2e0) END) AS INT) AS billing_page_visits,
  CAST(least(10, CASE WHEN c_custkey % 6 = 2 THEN 2 * coalesce(l.disc10, 0) ELSE floor(coalesce(l.disc10, 0) / 4e0) END) AS INT) AS downgrade_page_visits,
  CAST(least(12, coalesce(o.low, 0)) AS INT) AS invoice_download_frequency,
  CAST(CASE WHEN c_custkey % 5 = 0 THEN c_custkey % 15 ELSE -1 END AS INT) AS trial_expiry_days,
  least(1e0, coalesce(l.n, 0) / CASE WHEN c_custkey % 6 = 3 THEN 40e0 ELSE 90e0 END) AS tier_capacity_utilization,
  CAST(least(40, coalesce(l.bulk, 0)) AS INT) AS export_frequency,
  CAST(least(10000, coalesce(l.qty, 0)) AS INT) AS api_usage,
  least(1e0, coalesce(l.qty, 0) / CASE WHEN c_custkey % 6 = 3 THEN 1200e0 ELSE 4000e0 END) AS api_limit_usage,
  least(1e0, coalesce(l.taxed, 0) / CAST(greatest(1, coalesce(l.n, 0)) AS DOUBLE)
    * CASE WHEN c_custkey % 6 = 3 THEN 2e0 ELSE 1e0 END) AS seat_limit_usage
FROM customer JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN o ON o.k = c_custkey LEFT JOIN l ON l.k = c_custkey LEFT JOIN e ON e.k = c_custkey),
"""

LOGIT = (
    "(-2.5e0 + 0.04e0 * days_since_last_login + 0.03e0 * days_since_last_core_action"
    " - 0.015e0 * sessions_30d + 0.08e0 * ticket_count - 1.2e0 * support_sentiment"
    " + 1.5e0 * billing_page_visits / 5 + 1.2e0 * downgrade_page_visits / 3 + 0.6e0 * error_rate"
    " - 0.01e0 * tenure_months + 0.5e0 * login_frequency_change * -1)"
)

LABELLED = f"""
mart AS (
  SELECT *, CAST(CASE WHEN {LOGIT} + ((c_custkey * 6151 % 1001) - 500) / 200e0 > 2.2e0 THEN 1 ELSE 0 END AS INT) AS churned
  FROM mart0),
"""

_vel_raw = "CASE WHEN sessions_90d > 0 THEN sessions_30d / (sessions_90d / 3e0 + 1e-6) ELSE 0e0 END"

FEATURES = f"""
f1 AS (SELECT *, {clip(_vel_raw, '0e0', '5e0')} AS velocity_30d_vs_90d FROM mart),
f2 AS (SELECT *,
  {clip(f"0.35e0 * (days_since_last_login / 90e0) + 0.35e0 * (days_since_last_core_action / 90e0) + 0.15e0 * (1 - {clip('velocity_30d_vs_90d')}) + 0.15e0 * {neg('login_frequency_change')}")} AS engagement_decay_score,
  {clip(f"0.30e0 * {clip('ticket_count / 20e0')} + 0.25e0 * error_rate + 0.20e0 * {clip('failed_api_calls / 50e0')} + 0.15e0 * {clip('rage_click_count / 30e0')} + 0.10e0 * {neg('support_sentiment')}")} AS friction_score,
  {clip(f"0.35e0 * {clip('billing_page_visits / 20e0')} + 0.35e0 * {clip('downgrade_page_visits / 10e0')} + 0.20e0 * {clip('invoice_download_frequency / 12e0')} + 0.10e0 * (CASE WHEN trial_expiry_days >= 0 THEN (14 - {clip('trial_expiry_days', '0e0', '14e0')}) / 14e0 ELSE 0e0 END)")} AS pricing_sensitivity_score,
  {clip(f"0.35e0 * tier_capacity_utilization + 0.25e0 * api_limit_usage + 0.25e0 * seat_limit_usage + 0.15e0 * {clip('export_frequency / 40e0')}")} AS growth_pressure_score
  FROM f1),
f3 AS (SELECT *,
  {clip(f"0.30e0 * (1 - engagement_decay_score) + 0.25e0 * (1 - friction_score) + 0.25e0 * (1 - pricing_sensitivity_score) + 0.20e0 * {clip('sessions_30d / 120e0')}")} AS customer_health_score
  FROM f2),
feat AS (SELECT *,
  {clip("0.30e0 * engagement_decay_score + 0.25e0 * friction_score + 0.25e0 * pricing_sensitivity_score + 0.20e0 * (1 - customer_health_score)")} AS retention_risk_score,
  support_sentiment AS support_ticket_sentiment,
  ticket_count AS ticket_density_30d,
  CAST(CASE subscription_type WHEN 'Starter' THEN 0 WHEN 'Professional' THEN 1 WHEN 'Business' THEN 2
       WHEN 'Enterprise' THEN 3 ELSE 0 END AS INT) AS subscription_tier,
  CAST(CASE WHEN tenure_months > 0 AND tenure_months <= 3 THEN 0 WHEN tenure_months > 3 AND tenure_months <= 12 THEN 1
       WHEN tenure_months > 12 AND tenure_months <= 24 THEN 2 WHEN tenure_months > 24 AND tenure_months <= 84 THEN 3
       END AS INT) AS tenure_bucket,
  ln(1 + api_usage) AS log_api_usage,
  ln(1 + monthly_revenue) AS log_monthly_revenue
  FROM f3),
"""

SCORED = f"""
scored AS (SELECT *, 1e0 / (1e0 + exp(-{LOGIT})) AS churn_probability FROM feat),
scored2 AS (SELECT *, CASE WHEN churn_probability >= 0.75e0 THEN 'CRITICAL' WHEN churn_probability >= 0.5e0 THEN 'HIGH'
  WHEN churn_probability >= 0.3e0 THEN 'MEDIUM' ELSE 'LOW' END AS churn_risk_level FROM scored),
"""

_ghost = (
    f"0.40e0 * {clip('engagement_decay_score')} + 0.25e0 * {clip('days_since_last_login / 90e0')}"
    f" + 0.20e0 * (1 - {clip('velocity_30d_vs_90d')}) + 0.15e0 * {neg('login_frequency_change')}"
)
_frus = (
    f"0.35e0 * {clip('friction_score')} + 0.25e0 * {clip('ticket_count / 20e0')}"
    f" + 0.20e0 * {clip('error_rate')} + 0.20e0 * {neg('support_sentiment')}"
)
_price = (
    f"0.40e0 * {clip('pricing_sensitivity_score')} + 0.30e0 * {clip('billing_page_visits / 20e0')}"
    f" + 0.30e0 * {clip('downgrade_page_visits / 10e0')}"
)
_out = (
    f"0.40e0 * {clip('growth_pressure_score')} + 0.30e0 * {clip('tier_capacity_utilization')}"
    f" + 0.30e0 * {clip('api_limit_usage')}"
)

ARCH = f"""
a0 AS (SELECT *,
  {r(clip(_ghost), 4)} AS score_ghost,
  {r(clip(_frus), 4)} AS score_frustrated,
  {r(clip(_price), 4)} AS score_price_sensitive,
  {r(clip(_out), 4)} AS score_outgrown
  FROM {{src}}),
a1 AS (SELECT *, greatest(score_ghost, score_frustrated, score_price_sensitive, score_outgrown) AS _top FROM a0),
arch AS (SELECT * EXCLUDE (_top),
  CASE WHEN score_ghost = _top THEN 'A' WHEN score_frustrated = _top THEN 'B'
       WHEN score_price_sensitive = _top THEN 'C' WHEN score_outgrown = _top THEN 'D' END AS churn_archetype,
  round_even(_top, 4) AS archetype_confidence,
  CASE WHEN score_ghost = _top THEN 'The Ghost' WHEN score_frustrated = _top THEN 'Frustrated Professional'
       WHEN score_price_sensitive = _top THEN 'Price-Sensitive Optimizer' WHEN score_outgrown = _top THEN 'Outgrown User' END
       AS archetype_name
  FROM a1),
"""

_q = "((1e0 - churn_probability) / (1e0 + 0.1e0 / 12))"
CLV = f"""
v0 AS (SELECT *, round(CASE WHEN {_q} = 1e0 THEN monthly_revenue * 36e0
    ELSE monthly_revenue * {_q} * (1e0 - pow({_q}, 36e0)) / (1e0 - {_q}) END, 2) AS clv FROM arch),
valued AS (SELECT *,
  CASE WHEN clv >= 5000e0 THEN 'Enterprise' WHEN clv >= 1500e0 THEN 'High' WHEN clv >= 500e0 THEN 'Medium'
       WHEN clv >= 0e0 THEN 'Low' ELSE 'Low' END AS clv_tier,
  round_even(monthly_revenue * 12, 2) AS annualised_revenue
  FROM v0),
"""


def _sql_lit(v) -> str:
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return f"{float(v)!r}e0".replace("e0e0", "e0") if "e" not in repr(float(v)) else repr(float(v))


def _cond_sql(key: str, threshold, columns: set[str]) -> str:
    ops = {"_gte": ">=", "_lte": "<=", "_eq": "=", "_gt": ">", "_lt": "<"}
    for suffix, _ in SUFFIX_OPS:
        if key.endswith(suffix):
            feat = key[: -len(suffix)]
            if feat not in columns:
                return "TRUE"
            return f"coalesce({feat} {ops[suffix]} {float(threshold)!r}e0 AND NOT isnan(CAST({feat} AS DOUBLE)), FALSE)"
    return "FALSE"


def rules_sql(columns: set[str]) -> str:
    rs = load_rules()
    whens = []
    for a in rs.archetypes():
        for rule in rs.ordered(a):
            conds = " AND ".join([_cond_sql(k, v, columns) for k, v in rule.conditions.items()] or ["TRUE"])
            whens.append(f"WHEN churn_archetype = '{a}' AND {conds} THEN '{rule.id}'")
    case = "CASE " + " ".join(whens) + " ELSE 'FALLBACK' END"
    rows = []
    for rule in rs.rules:
        rows.append(rule.values())
    rows.append(rs.fallback_values())
    vals = ",\n    ".join(
        "(" + ", ".join(_q_lit(x) for x in row) + ")" for row in rows
    )
    return f"""
rt AS (SELECT * FROM (VALUES
    {vals}) t(rule_id, action, action_code, channel, urgency, expected_conversion_rate, action_cost_usd, description)),
n0 AS (SELECT *, {case} AS rule_id FROM valued),
nba AS (SELECT n0.*, rt.action, rt.action_code, rt.channel, rt.urgency, rt.expected_conversion_rate,
               rt.action_cost_usd, rt.description FROM n0 JOIN rt USING (rule_id)),
dec AS (SELECT *,
  round(churn_probability * expected_conversion_rate * monthly_revenue * 12, 2) AS expected_revenue_saved
  FROM nba),
decided AS (SELECT *,
  round_even((expected_revenue_saved - action_cost_usd) / greatest(action_cost_usd, 0.01e0), 2) AS campaign_roi
  FROM dec),
imp0 AS (SELECT *, churn_probability * expected_conversion_rate * 0.85e0 AS p_saved FROM decided),
imp1 AS (SELECT *, p_saved * monthly_revenue * 12 AS revenue_saved, action_cost_usd * 1.2e0 AS campaign_cost_total FROM imp0),
impacted AS (SELECT *, revenue_saved * 0.7e0 - campaign_cost_total AS incremental_profit FROM imp1),
"""


def _q_lit(x) -> str:
    if isinstance(x, str):
        return "'" + x.replace("'", "''") + "'"
    return f"CAST({float(x)!r} AS DOUBLE)"


# columns present when the rules run (mart + features + scores + archetypes + value)
_RULE_COLUMNS = None


def _rule_columns() -> set[str]:
    from ..schema import CUSTOMER_FIELDS, ENGINEERED_FEATURES

    base = {n for n, _, _ in CUSTOMER_FIELDS} | set(ENGINEERED_FEATURES)
    return base | {
        "c_custkey",
        "churn_probability",
        "churn_risk_level",
        "score_ghost",
        "score_frustrated",
        "score_price_sensitive",
        "score_outgrown",
        "churn_archetype",
        "archetype_confidence",
        "archetype_name",
        "clv",
        "clv_tier",
        "annualised_revenue",
    }


STAGES = ["mart", "feat", "scored", "arch", "valued", "impacted"]


def chain(stage: str, body: str, high_risk: bool = True, threshold: float = 0.5) -> str:
    """``WITH`` all CTEs up to ``stage`` followed by ``body``.

    Archetypes / value / rules run on the high-risk rows (p >= threshold) when
    ``high_risk`` (the decision pipeline), else on every scored customer.
    """
    parts = [MART, LABELLED]
    idx = STAGES.index(stage)
    if idx >= 1:
        parts.append(FEATURES)
    if idx >= 2:
        parts.append(SCORED)
    if idx >= 3:
        src = f"hr" if high_risk else "scored2"
        if high_risk:
            parts.append(f"hr AS (SELECT * FROM scored2 WHERE churn_probability >= {threshold!r}e0),\n")
        parts.append(ARCH.replace("{src}", src))
    if idx >= 4:
        parts.append(CLV)
    if idx >= 5:
        parts.append(rules_sql(_rule_columns()))
    text = "".join(parts).rstrip().rstrip(",")
    return "WITH " + text.strip() + "\n" + body


def _ks_p(d: str, n: str, m: str) -> str:
    en = f"({n} * {m} / ({n} + {m}))"
    lam = f"((sqrt({en}) + 0.12e0 + 0.11e0 / sqrt({en})) * {d})"
    series = (
        f"list_sum(list_transform(range(1, 101), lambda k: (CASE WHEN k % 2 = 1 THEN 1e0 ELSE -1e0 END)"
        f" * exp(-2e0 * k * k * {lam} * {lam})))"
    )
    return f"(CASE WHEN {d} <= 0 THEN 1e0 ELSE least(1e0, greatest(0e0, 2e0 * {series})) END)"


def _psi_label(x: str) -> str:
    return (
        f"CASE WHEN {x} < 0.1e0 THEN '✅ No Drift' WHEN {x} < 0.2e0 THEN '⚠️ Minor Drift' ELSE '🚨 Major Drift' END"
    )


def drift_ctes(features: list[str], lf_name: str = "lf", suffix: str = "") -> str:
    """PSI / KS / profile CTEs over a long form named ``lf_name`` (side, feature, value)."""
    s = suffix
    q = ", ".join(f"quantile_cont(value, {i / 10!r})" for i in range(11))
    return f"""
vals{s} AS (SELECT side, feature, value FROM {lf_name} WHERE value IS NOT NULL AND NOT isnan(value)),
sizes{s} AS (SELECT feature, count(*) FILTER (WHERE side = 'ref') AS n_ref, count(*) FILTER (WHERE side = 'prod') AS n_prod
  FROM vals{s} GROUP BY feature),
edges{s} AS (SELECT feature, list_sort(list_distinct([{q}])) AS edges FROM vals{s} WHERE side = 'ref' GROUP BY feature),
binned{s} AS (SELECT v.feature, v.side, len(e.edges) - 1 AS nb,
  CASE WHEN v.value = e.edges[len(e.edges)] THEN len(e.edges) - 2
       ELSE len(list_filter(e.edges, lambda x: x <= v.value)) - 1 END AS bin
  FROM vals{s} v JOIN edges{s} e USING (feature)),
counts{s} AS (SELECT feature, bin, count(*) FILTER (WHERE side = 'ref') AS c_ref, count(*) FILTER (WHERE side = 'prod') AS c_prod
  FROM binned{s} WHERE bin >= 0 AND bin < nb GROUP BY feature, bin),
allb{s} AS (SELECT feature, n_ref, n_prod, unnest(range(0, len(edges) - 1)) AS bin
  FROM edges{s} JOIN sizes{s} USING (feature) WHERE len(edges) >= 2),
terms{s} AS (SELECT feature, (p - r) * ln(p / r) AS t FROM (
  SELECT a.feature, greatest(coalesce(c.c_ref, 0) / a.n_ref, 1e-6) AS r, greatest(coalesce(c.c_prod, 0) / a.n_prod, 1e-6) AS p
  FROM allb{s} a LEFT JOIN counts{s} c USING (feature, bin) WHERE a.n_ref > 0 AND a.n_prod > 0) x),
psi{s} AS (SELECT z.feature, coalesce(round(sum(t), 4), 0e0) AS psi FROM sizes{s} z LEFT JOIN terms{s} USING (feature) GROUP BY z.feature),
pv{s} AS (SELECT feature, value, count(*) FILTER (WHERE side = 'ref') AS c_ref, count(*) FILTER (WHERE side = 'prod') AS c_prod
  FROM vals{s} GROUP BY feature, value),
cum{s} AS (SELECT feature, sum(c_ref) OVER w AS cr, sum(c_prod) OVER w AS cp FROM pv{s}
  WINDOW w AS (PARTITION BY feature ORDER BY value ROWS UNBOUNDED PRECEDING)),
ksd{s} AS (SELECT feature, max(abs(cr / n_ref - cp / n_prod)) AS d FROM cum{s} JOIN sizes{s} USING (feature) GROUP BY feature),
ks{s} AS (SELECT z.feature,
  CASE WHEN n_ref < 5 OR n_prod < 5 THEN 0e0 ELSE round(d, 4) END AS ks_statistic,
  CASE WHEN n_ref < 5 OR n_prod < 5 THEN 1e0 ELSE round({_ks_p('d', 'n_ref', 'n_prod')}, 4) END AS ks_pvalue
  FROM sizes{s} z LEFT JOIN ksd{s} USING (feature)),
prof{s} AS (SELECT side, feature, count(*) AS rows, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS std,
  min(value) AS min, max(value) AS max, 1 - count(value) / count(*) AS null_pct
  FROM (SELECT side, feature, CASE WHEN isnan(value) THEN NULL ELSE value END AS value FROM {lf_name}) u GROUP BY side, feature),
"""


def _lf(features: list[str], ref: str, prod: str) -> str:
    parts = []
    for side, src in (("ref", ref), ("prod", prod)):
        for f in features:
            parts.append(f"SELECT '{side}' AS side, '{f}' AS feature, TRY_CAST({f} AS DOUBLE) AS value FROM {src}")
    return " UNION ALL ".join(parts)


def monitoring_chain(features: list[str], body: str) -> str:
    """All customers scored as of 730 days before the last order (events: first 15 days) vs now, then drift CTEs."""
    base = chain("scored", "SELECT 1").removesuffix("\nSELECT 1").rstrip()
    stages = base.removeprefix("WITH")
    extra = f""",
orders_early AS (SELECT * FROM orders
  WHERE CAST(o_orderdate AS DATE) <= (SELECT max(CAST(o_orderdate AS DATE)) FROM orders) - 730),
events_early AS (SELECT * FROM events WHERE CAST(ts AS DATE) < (SELECT min(CAST(ts AS DATE)) FROM events) + 15),
refc AS (WITH orders AS (SELECT * FROM orders_early), events AS (SELECT * FROM events_early), {stages}
  SELECT * FROM scored2),
prodc AS (SELECT * FROM scored2),
lf AS ({_lf(features, 'refc', 'prodc')}),
lfp AS ({_lf(['churn_probability'], 'refc', 'prodc')}),
{drift_ctes(features, 'lf')}{drift_ctes(['churn_probability'], 'lfp', '_p')}
fdrift AS (SELECT feature, psi, {_psi_label('psi')} AS psi_label, ks_statistic, ks_pvalue,
  round(r.mean, 4) AS ref_mean, round(p.mean, 4) AS prod_mean, round(r.std, 4) AS ref_std, round(p.std, 4) AS prod_std,
  (psi >= 0.2e0 OR ks_pvalue < 0.05e0) AS drift_detected
  FROM psi JOIN ks USING (feature) JOIN (SELECT * FROM prof WHERE side = 'ref') r USING (feature)
  JOIN (SELECT * FROM prof WHERE side = 'prod') p USING (feature)),
pdrift AS (SELECT (SELECT round(avg(value), 4) FROM lfp WHERE side = 'ref') AS ref_mean_score,
  (SELECT round(avg(value), 4) FROM lfp WHERE side = 'prod') AS prod_mean_score,
  psi, {_psi_label('psi')} AS psi_label, ks_statistic, ks_pvalue, psi >= 0.2e0 AS drift_detected
  FROM psi_p JOIN ks_p USING (feature)),
rq AS (SELECT feature, null_pct AS r_null, min AS r_min, max AS r_max, std AS r_std FROM prof WHERE side = 'ref'),
pq AS (SELECT feature, null_pct AS p_null, min AS p_min, max AS p_max, n AS p_n FROM prof WHERE side = 'prod'),
oor AS (SELECT v.feature, avg(CASE WHEN v.value < rq.r_min - 3 * rq.r_std OR v.value > rq.r_max + 3 * rq.r_std THEN 1e0 ELSE 0e0 END) AS oor
  FROM vals v JOIN rq USING (feature) WHERE v.side = 'prod' GROUP BY v.feature),
quality AS (SELECT feature, round(r_null, 4) AS ref_null_pct, round(p_null, 4) AS prod_null_pct,
  round(p_null - r_null, 4) AS null_increase, round(r_min, 4) AS ref_min, round(r_max, 4) AS ref_max,
  round(p_min, 4) AS prod_min, round(p_max, 4) AS prod_max,
  round(CASE WHEN p_n > 0 THEN oor ELSE 1e0 END, 4) AS out_of_range_pct,
  (p_null - r_null < 0.1e0 AND (CASE WHEN p_n > 0 THEN oor ELSE 1e0 END) < 0.05e0) AS quality_ok
  FROM rq JOIN pq USING (feature) LEFT JOIN oor USING (feature))
"""
    return base + extra + body
