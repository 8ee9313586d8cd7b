"""Next-best-action rules.

The rule table is configuration (13 rows with the fallback), so it is parsed
on the driver once and compiled into ONE nested ``CASE`` expression that
returns a struct: first matching rule of the row's archetype in ascending
priority, else the fallback.  No join, no shuffle, no per-row Python; the
cost is independent of the data size.

A condition whose feature is absent from the frame is true (decided at plan
time from ``df.columns``); a present feature that is null/NaN makes the
condition false; an unknown operator suffix makes the rule false.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from functools import reduce

import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import col_or, rint_to

DEFAULT_RULES_PATH = os.path.join(os.path.dirname(__file__), "..", "config", "default_rules.yaml")

# ---- fixed values: operator suffixes, tried in this order ----
SUFFIX_OPS = (
    ("_gte", lambda x, t: x >= t),
    ("_lte", lambda x, t: x <= t),
    ("_eq", lambda x, t: x == t),
    ("_gt", lambda x, t: x > t),
    ("_lt", lambda x, t: x < t),
)

ACTION_FIELDS = [
    ("rule_id", T.StringType()),
    ("action", T.StringType()),
    ("action_code", T.StringType()),
    ("channel", T.StringType()),
    ("urgency", T.StringType()),
    ("expected_conversion_rate", T.DoubleType()),
    ("action_cost_usd", T.DoubleType()),
    ("description", T.StringType()),
]
ACTION_COLUMNS = [n for n, _ in ACTION_FIELDS]


@dataclass
class Rule:
    id: str
    name: str
    archetype: str
    priority: int
    conditions: dict
    action: str
    action_code: str
    channel: str
    urgency: str
    expected_conversion_rate: float
    cost_usd: float
    description: str

    def values(self) -> tuple:
        return (
            self.id,
            self.action,
            self.action_code,
            self.channel,
            self.urgency,
            float(self.expected_conversion_rate),
            float(self.cost_usd),
            self.description,
        )


@dataclass
class RuleSet:
    rules: list[Rule]
    fallback: dict
    thresholds: dict = field(default_factory=dict)

    def ordered(self, archetype: str) -> list[Rule]:
        # stable sort: equal priority keeps file order
        return sorted([r for r in self.rules if r.archetype == archetype], key=lambda r: r.priority)

    def archetypes(self) -> list[str]:
        seen: list[str] = []
        for r in self.rules:
            if r.archetype not in seen:
                seen.append(r.archetype)
        return seen

    def fallback_values(self) -> tuple:
        f = self.fallback
        return (
            f["rule_id"],
            f["action"],
            f["action_code"],
            f["channel"],
            f["urgency"],
            float(f["expected_conversion_rate"]),
            float(f["cost_usd"]),
            f["description"],
        )


def load_rules(path: str | None = None) -> RuleSet:
    """YAML -> RuleSet (parsed once on the driver)."""
    with open(path or DEFAULT_RULES_PATH) as fh:
        cfg = yaml.safe_load(fh)
    rules = [
        Rule(
            id=str(r["id"]),
            name=r.get("name", ""),
            archetype=str(r["archetype"]),
            priority=int(r["priority"]),
            conditions=dict(r.get("conditions") or {}),
            action=r["action"],
            action_code=r["action_code"],
            channel=r["channel"],
            urgency=r["urgency"],
            expected_conversion_rate=float(r["expected_conversion_rate"]),
            cost_usd=float(r["cost_usd"]),
            description=r.get("description", ""),
        )
        for r in cfg.get("rules", [])
    ]
    return RuleSet(rules=rules, fallback=dict(cfg["fallback"]), thresholds=dict(cfg.get("thresholds") or {}))


def _lit_sql(v) -> str:
    if isinstance(v, str):
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, int):
        return str(v)
    return f"{float(v)!r}D"


def condition_sql(columns: list[str], key: str, threshold) -> str:
    """C6 for one ``feature_op: threshold`` entry, as a Spark SQL predicate."""
    ops = {"_gte": ">=", "_lte": "<=", "_eq": "=", "_gt": ">", "_lt": "<"}
    for suffix, _ in SUFFIX_OPS:
        if key.endswith(suffix):
            feature = key[: -len(suffix)]
            if feature not in columns:
                return "true"
            x = f"`{feature}`"
            if isinstance(threshold, str):
                return f"coalesce({x} {ops[suffix]} {_lit_sql(threshold)}, false)"
            # null and NaN compare false, as in the row-wise original
            return f"coalesce({x} {ops[suffix]} {_lit_sql(threshold)} AND NOT isnan(CAST({x} AS DOUBLE)), false)"
    return "false"


def condition(columns: list[str], key: str, threshold) -> Column:
    return F.expr(condition_sql(columns, key, threshold))


def predicate_sql(columns: list[str], conditions: dict) -> str:
    return " AND ".join([condition_sql(columns, k, v) for k, v in conditions.items()] or ["true"])


def predicate(columns: list[str], conditions: dict) -> Column:
    return F.expr(predicate_sql(columns, conditions))


def _struct_sql(values: tuple) -> str:
    parts = []
    for (n, t), v in zip(ACTION_FIELDS, values):
        lit = _lit_sql(float(v)) if isinstance(t, T.DoubleType) else _lit_sql(v)
        parts.append(f"'{n}', {lit}")
    return "named_struct(" + ", ".join(parts) + ")"


def match_sql(columns: list[str], rules: RuleSet, archetype_col: str = "churn_archetype") -> str:
    """D3 compiled once: ``CASE WHEN <archetype> AND <conditions> THEN struct ... ELSE fallback END``."""
    arch = f"`{archetype_col}`" if archetype_col in columns else "'A'"
    whens = []
    for a in rules.archetypes():
        for r in rules.ordered(a):
            whens.append(
                f"WHEN {arch} = {_lit_sql(a)} AND {predicate_sql(columns, r.conditions)} THEN {_struct_sql(r.values())}"
            )
    fb = _struct_sql(rules.fallback_values())
    return f"CASE {' '.join(whens)} ELSE {fb} END" if whens else fb


def match_expr(df: DataFrame, rules: RuleSet, archetype_col: str = "churn_archetype") -> Column:
    """D3: first matching rule as a struct column (one parsed CASE expression)."""
    return F.expr(match_sql(df.columns, rules, archetype_col))


def recommend(df: DataFrame, rules: RuleSet | None = None, archetype_col: str = "churn_archetype") -> DataFrame:
    """Append rule_id, action, action_code, channel, urgency, rate, cost, description."""
    rules = rules or load_rules()
    rec = match_expr(df, rules, archetype_col).alias("_rec")
    return df.select("*", rec).select(*[F.col(c) for c in df.columns], *[F.col(f"_rec.{n}").alias(n) for n in ACTION_COLUMNS])


def expected_revenue_saved(p: Column, mrr: Column, conversion: Column, months: int = 12) -> Column:
    """``round(p * conversion * mrr * months, 2)`` (no reach factor)."""
    return F.round(p * conversion * mrr * months, 2)


def add_revenue_impact(df: DataFrame) -> DataFrame:
    """E12 + E13 with the row defaults p .5, mrr 100, conversion .1."""
    p = col_or(df, "churn_probability", 0.5)
    mrr = col_or(df, "monthly_revenue", 100.0)
    conv = col_or(df, "expected_conversion_rate", 0.1)
    df = df.withColumn("expected_revenue_saved", expected_revenue_saved(p, mrr, conv))
    cost = F.col("action_cost_usd")
    roi = (F.col("expected_revenue_saved") - cost) / F.greatest(cost, F.lit(0.01))
    return df.withColumn("campaign_roi", rint_to(roi, 2))


def decide(df: DataFrame, rules: RuleSet | None = None) -> DataFrame:
    """Rules -> revenue saved -> ROI."""
    return add_revenue_impact(recommend(df, rules))


def rules_frame(spark: SparkSession, rules: RuleSet | None = None) -> DataFrame:
    """Rule table as rows (id, archetype, priority, file position, action fields) incl. fallback."""
    rules = rules or load_rules()
    schema = T.StructType(
        [
            T.StructField("archetype", T.StringType()),
            T.StructField("priority", T.IntegerType()),
            T.StructField("position", T.IntegerType()),
        ]
        + [T.StructField(n, t) for n, t in ACTION_FIELDS]
    )
    rows = [(r.archetype, r.priority, i, *r.values()) for i, r in enumerate(rules.rules)]
    rows.append((None, None, len(rules.rules), *rules.fallback_values()))
    return spark.createDataFrame(rows, schema)


def conditions_frame(spark: SparkSession, rules: RuleSet | None = None) -> DataFrame:
    """Conditions exploded to (position, rule_id, feature, op, threshold, threshold_text).

    Text thresholds are in the last column; an unknown operator is null.
    """
    rules = rules or load_rules()
    rows = []
    for position, r in enumerate(rules.rules):
        for k, v in r.conditions.items():
            op = next((s[1:] for s, _ in SUFFIX_OPS if k.endswith(s)), None)
            feat = k[: -(len(op) + 1)] if op else k
            text = v if isinstance(v, str) else None
            rows.append((position, r.id, feat, op, None if text is not None else float(v), text))
    schema = "position int, rule_id string, feature string, op string, threshold double, threshold_text string"
    return spark.createDataFrame(rows, schema)
