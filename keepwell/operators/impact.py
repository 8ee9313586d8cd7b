"""Campaign economics: per-customer impact (E19), report totals (F4-F8) and
scenario sweeps (H1-H3).

Totals, by-archetype and by-urgency figures come out of ONE aggregation with
``GROUPING SETS ((), (churn_archetype), (urgency))``.  Sweeps aggregate the
table once to a handful of sums and then evaluate every grid point from those
sums: the grid (18 or 36 points, fixed by construction) is a literal table
and the data is never rescanned per point.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import col_or, rint_to


@dataclass(frozen=True)
class ImpactAssumptions:
    # ---- fixed values: default campaign assumptions ----
    campaign_reach_rate: float = 0.85
    base_churn_without_intervention: float = 0.18  # declared, unused by the formulas
    months_retained: int = 12
    discount_rate_annual: float = 0.10  # declared, unused by the formulas
    overhead_multiplier: float = 1.20
    incremental_margin: float = 0.70


DEFAULTS = ImpactAssumptions()


def per_customer(df: DataFrame, a: ImpactAssumptions = DEFAULTS) -> DataFrame:
    """p_saved, revenue_saved, campaign_cost_total, incremental_profit."""
    p = col_or(df, "churn_probability", 0.5)
    mrr = col_or(df, "monthly_revenue", 100.0)
    conv = col_or(df, "expected_conversion_rate", 0.1)
    cost = col_or(df, "action_cost_usd", 5.0)
    df = df.withColumn("p_saved", p * conv * F.lit(a.campaign_reach_rate))
    df = df.withColumns(
        {
            "revenue_saved": F.col("p_saved") * mrr * F.lit(a.months_retained),
            "campaign_cost_total": cost * F.lit(a.overhead_multiplier),
        }
    )
    return df.withColumn(
        "incremental_profit", F.col("revenue_saved") * F.lit(a.incremental_margin) - F.col("campaign_cost_total")
    )


_SUMS = {"p_saved": "p_saved", "revenue_saved": "revenue_saved", "cost": "campaign_cost_total", "profit": "incremental_profit"}


def _grouped(df: DataFrame, a: ImpactAssumptions, totals_only: bool = False) -> DataFrame:
    if "revenue_saved" not in df.columns:
        df = per_customer(df, a)
    keys = [k for k in ("churn_archetype", "urgency") if k in df.columns]
    if "urgency" not in df.columns:
        df = df.withColumn("urgency", F.lit(None).cast("string"))
    if "churn_archetype" not in df.columns:
        df = df.withColumn("churn_archetype", F.lit(None).cast("string"))
    sets = [[]] + [[F.col(k)] for k in keys]
    conv = col_or(df, "expected_conversion_rate", 0.1)
    mrr = col_or(df, "monthly_revenue", 100.0)
    sums = [
        F.count(F.lit(1)).alias("rows"),
        *[F.coalesce(F.sum(c), F.lit(0.0)).alias(n) for n, c in (("mrr", mrr), *((x, F.col(y)) for x, y in _SUMS.items()))],
        F.avg("revenue_saved").alias("mean_revenue_saved"),
        F.avg(conv).alias("avg_conversion"),
    ]
    if totals_only:
        return df.agg(*sums).withColumn("gid", F.lit(3))
    return df.groupingSets(sets, "churn_archetype", "urgency").agg(F.grouping_id().alias("gid"), *sums)


def _totals_from(g: DataFrame, a: ImpactAssumptions) -> DataFrame:
    t = g.filter(F.col("gid") == 3).select(
        F.col("rows").alias("total_at_risk_users"),
        rint_to(F.col("mrr"), 2).alias("total_at_risk_mrr"),
        rint_to(F.col("p_saved"), 1).alias("expected_users_retained"),
        rint_to(F.col("revenue_saved"), 2).alias("expected_revenue_saved"),
        rint_to(F.col("cost"), 2).alias("total_campaign_cost"),
        rint_to(F.col("profit"), 2).alias("net_incremental_profit"),
        F.col("mean_revenue_saved"),
    )
    t = t.withColumn(
        "roi_pct",
        rint_to(F.col("net_incremental_profit") / F.greatest(F.col("total_campaign_cost"), F.lit(1.0)) * 100, 1),
    )
    t = t.withColumn(
        "payback_months",
        rint_to(
            F.col("total_campaign_cost")
            / F.greatest(F.col("mean_revenue_saved") * F.lit(a.incremental_margin), F.lit(1.0)),
            1,
        ),
    )
    return t.drop("mean_revenue_saved")


def impact_totals(df: DataFrame, a: ImpactAssumptions = DEFAULTS) -> DataFrame:
    """One row of rounded totals, roi_pct and payback_months.

    An empty input yields one row of zeros; use ``impact_report`` for all
    three tables from one pass.
    """
    return _totals_from(_grouped(df, a, totals_only=True), a)


def impact_by_archetype(df: DataFrame, a: ImpactAssumptions = DEFAULTS) -> DataFrame:
    """users, revenue_saved, campaign_cost, net_profit per archetype (null keys dropped)."""
    g = _grouped(df, a)
    return g.filter((F.col("gid") == 1) & F.col("churn_archetype").isNotNull()).select(
        "churn_archetype",
        F.col("rows").alias("users"),
        rint_to(F.col("revenue_saved"), 2).alias("revenue_saved"),
        rint_to(F.col("cost"), 2).alias("campaign_cost"),
        rint_to(F.col("profit"), 2).alias("net_profit"),
    )


def impact_by_urgency(df: DataFrame, a: ImpactAssumptions = DEFAULTS) -> DataFrame:
    """F8: users, revenue_saved, avg_conversion per urgency (null keys dropped)."""
    g = _grouped(df, a)
    return g.filter((F.col("gid") == 2) & F.col("urgency").isNotNull()).select(
        "urgency",
        F.col("rows").alias("users"),
        rint_to(F.col("revenue_saved"), 2).alias("revenue_saved"),
        rint_to(F.col("avg_conversion"), 2).alias("avg_conversion"),
    )


def impact_report(df: DataFrame, a: ImpactAssumptions = DEFAULTS, persist: bool = True):
    """All three impact tables from ONE aggregation pass (the grouped result is tiny)."""
    g = _grouped(df, a)
    if persist:
        g = g.persist()
    totals = _totals_from(g, a)
    by_arch = g.filter((F.col("gid") == 1) & F.col("churn_archetype").isNotNull()).select(
        "churn_archetype",
        F.col("rows").alias("users"),
        rint_to(F.col("revenue_saved"), 2).alias("revenue_saved"),
        rint_to(F.col("cost"), 2).alias("campaign_cost"),
        rint_to(F.col("profit"), 2).alias("net_profit"),
    )
    by_urg = g.filter((F.col("gid") == 2) & F.col("urgency").isNotNull()).select(
        "urgency",
        F.col("rows").alias("users"),
        rint_to(F.col("revenue_saved"), 2).alias("revenue_saved"),
        rint_to(F.col("avg_conversion"), 2).alias("avg_conversion"),
    )
    return totals, by_arch, by_urg


# ---------------------------------------------------------------- scenarios


@dataclass(frozen=True)
class Scenario:
    # ---- fixed values: default scenario sliders ----
    reach_rate: float = 0.85
    conversion_multiplier: float = 1.0
    months: int = 12
    margin: float = 0.70
    overhead: float = 1.2


def scenario(df: DataFrame, s: Scenario = Scenario()) -> DataFrame:
    """H1: revenue, cost, profit, ROI % (unrounded) of one scenario; cost defaults to 5."""
    p = col_or(df, "churn_probability", 0.5)
    mrr = col_or(df, "monthly_revenue", 100.0)
    conv = F.col("expected_conversion_rate")
    cost = col_or(df, "action_cost_usd", 5.0)
    p_saved = p * (conv * F.lit(s.conversion_multiplier)) * F.lit(s.reach_rate)
    rev = p_saved * mrr * F.lit(s.months)
    cost_sim = cost * F.lit(s.overhead)
    agg = df.agg(
        F.sum(rev).alias("revenue_saved"),
        F.sum(cost_sim).alias("campaign_cost"),
        F.sum(rev * F.lit(s.margin) - cost_sim).alias("net_profit"),
    )
    return agg.withColumn("roi_pct", F.col("net_profit") / F.greatest(F.col("campaign_cost"), F.lit(1.0)) * 100)


def _points(n: int, start: float, step: float) -> list[float]:
    # np.arange semantics: start + i * step, evaluated in double precision
    return [start + i * step for i in range(n)]


def conversion_sensitivity(df: DataFrame, s: Scenario = Scenario()) -> DataFrame:
    """H2: ROI % for conversion multipliers .3, .4, ... 2.0; cost fixed at the scenario total.

    One pass computes two sums; the 18 grid points are exploded from that
    single row (no join, no rescan).
    """
    p = col_or(df, "churn_probability", 0.5)
    mrr = col_or(df, "monthly_revenue", 100.0)
    cost = col_or(df, "action_cost_usd", 5.0)
    sums = df.agg(
        F.sum(p * F.col("expected_conversion_rate") * mrr).alias("pcm"),
        F.sum(cost * F.lit(s.overhead)).alias("cost"),
    )
    pts = F.array(*[F.lit(x) for x in _points(18, 0.3, 0.1)])
    j = sums.select("pcm", "cost", F.posexplode(pts).alias("point", "multiplier"))
    rev = F.col("pcm") * F.col("multiplier") * F.lit(s.reach_rate) * F.lit(s.months)
    return j.select(
        "point",
        "multiplier",
        ((rev * F.lit(s.margin) - F.col("cost")) / F.greatest(F.col("cost"), F.lit(1.0)) * 100).alias("roi_pct"),
    )


REACH_GRID = (0.60, 0.75, 0.85, 1.00)  # fixed values: reach rates of the 2-D sweep


def conversion_reach_sensitivity(df: DataFrame, a: ImpactAssumptions = DEFAULTS) -> DataFrame:
    """H3: ROI % (report definition, rounded totals) over conversion .05..45 x reach grid.

    The swept conversion replaces every rule's rate.  One pass, 36 points
    exploded from the single aggregate row.
    """
    p = col_or(df, "churn_probability", 0.5)
    mrr = col_or(df, "monthly_revenue", 100.0)
    cost = col_or(df, "action_cost_usd", 5.0)
    sums = df.agg(F.sum(p * mrr).alias("pm"), F.sum(cost * F.lit(a.overhead_multiplier)).alias("cost_raw"))
    conv = F.array(*[F.lit(x) for x in _points(9, 0.05, 0.05)])
    reach = F.array(*[F.lit(x) for x in REACH_GRID])
    g = sums.select("*", F.explode(conv).alias("conversion")).select("*", F.explode(reach).alias("reach"))
    rev = F.col("pm") * F.col("conversion") * F.col("reach") * F.lit(a.months_retained)
    cost_r = rint_to(F.col("cost_raw"), 2)
    profit_r = rint_to(rev * F.lit(a.incremental_margin) - F.col("cost_raw"), 2)
    return g.select(
        "conversion",
        "reach",
        rint_to(profit_r / F.greatest(cost_r, F.lit(1.0)) * 100, 1).alias("roi_pct"),
    )


def waterfall(df: DataFrame, a: ImpactAssumptions = DEFAULTS) -> DataFrame:
    """(step, label, value): annual MRR at risk, reached, saved, -cost, net profit."""
    if "revenue_saved" not in df.columns:
        df = per_customer(df, a)
    t = df.agg(
        F.sum(col_or(df, "monthly_revenue", 100.0)).alias("mrr"),
        rint_to(F.sum("revenue_saved"), 2).alias("saved"),
        rint_to(F.sum("campaign_cost_total"), 2).alias("cost"),
        rint_to(F.sum("incremental_profit"), 2).alias("profit"),
    )
    annual = F.col("mrr") * 12
    return t.select(
        F.inline(
            F.array(
                F.struct(F.lit(1).alias("step"), F.lit("MRR at Risk (12mo)").alias("label"), annual.alias("value")),
                *[
                    F.struct(F.lit(i).alias("step"), F.lit(lbl).alias("label"), v.alias("value"))
                    for i, lbl, v in (
                        (2, "Reached", annual * F.lit(a.campaign_reach_rate)),
                        (3, "Revenue Saved", F.col("saved")),
                        (4, "Campaign Cost", -F.col("cost")),
                        (5, "Net Profit", F.col("profit")),
                    )
                ],
            )
        )
    )
