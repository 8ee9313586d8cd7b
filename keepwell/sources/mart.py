"""Customer mart: the 27-column wide customer table derived from the TPC-H-like tables.

One row per ``customer`` row. The derivation is deterministic so that an
independent SQL engine can recompute every column (see ``keepwell.oracle``).

Plan shape (designed for a lineitem of billions of rows):

* ``lineitem`` is pre-aggregated per ``l_orderkey`` first.  The partial
  (map-side) aggregate collapses the ~4 lines of an order before the shuffle,
  and the final aggregate leaves the result hash-partitioned on the order key,
  so the following join with ``orders`` only shuffles ``orders``.
* ``orders`` + per-order line counts are aggregated once per customer key;
  both the order-level and the line-level figures come out of this single
  ``groupBy`` (no second pass over orders).
* ``events`` is aggregated per ``user_id`` with map-side combine, so a user
  that owns a third of all events still ships one partial row per task.
* The three per-customer aggregates and ``customer`` all meet on the
  customer key: sort-merge joins on one hash partitioning, no skew (keys are
  unique after aggregation).  ``nation`` (25 rows by the TPC-H spec) is left
  to the size-based broadcast threshold.
* The reference day is a scalar subquery (``DataFrame.scalar``), not a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import Tables

# ---- fixed values: deterministic derivation constants of the mart ----
ACCTBAL_CUTS = (3400.0, 6700.0, 8900.0)  # Starter / Professional / Business / Enterprise
MRR_BASE = {"Starter": 29.0, "Professional": 99.0, "Business": 399.0, "Enterprise": 1500.0}
MRR_SPREAD = {"Starter": 5001, "Professional": 20001, "Business": 60001, "Enterprise": 350001}
LABEL_CUT = 2.2


def _i(c: Column) -> Column:
    return c.cast("int")


def _padded(digits: Column) -> Column:
    """At least six digits; longer numbers stay whole."""
    return F.when(F.length(digits) < 6, F.lpad(digits, 6, "0")).otherwise(digits)


# ---- fixed values: the generator's noise-free churn logit, weight by column ----
LOGIT_BASE = -2.5
LOGIT_WEIGHTS = {
    "days_since_last_login": 0.04,
    "days_since_last_core_action": 0.03,
    "sessions_30d": -0.015,
    "ticket_count": 0.08,
    "support_sentiment": -1.2,
    "billing_page_visits": 0.3,
    "downgrade_page_visits": 0.4,
    "error_rate": 0.6,
    "tenure_months": -0.01,
    "login_frequency_change": -0.5,
}


def label_logit(c=F.col) -> Column:
    """Noise-free churn logit of the synthetic generator (deterministic score B18 input)."""
    return sum((F.lit(w) * c(name) for name, w in LOGIT_WEIGHTS.items()), F.lit(LOGIT_BASE))


def customer_aggregates(t: Tables) -> DataFrame:
    """Per customer key: order recency/priority counts and line-level counts."""
    orders = t.orders.select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", F.to_date("o_orderdate").alias("odate")
    )
    ref_day = t.orders.select(F.max(F.to_date("o_orderdate"))).scalar()

    li = t.lineitem
    per_order = li.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("ln"),
        F.count_if(F.col("l_returnflag") == "R").alias("lret"),
        F.count_if((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O")).alias("lret_open"),
        F.count_if(F.col("l_discount") >= 0.085).alias("ldisc9"),
        F.count_if(F.col("l_discount") >= 0.095).alias("ldisc10"),
        F.count_if(F.col("l_tax") >= 0.045).alias("ltaxed"),
        F.count_if(F.col("l_quantity") >= 45.0).alias("lbulk"),
        F.sum("l_quantity").alias("lqty"),
    )

    joined = orders.join(per_order, orders.o_orderkey == per_order.l_orderkey, "left").withColumn(
        "age", F.datediff(ref_day, F.col("odate"))
    )
    ln = F.coalesce(F.col("ln"), F.lit(0))

    def lines_if(cond: Column) -> Column:
        return F.sum(F.when(cond, ln).otherwise(F.lit(0)))

    return joined.groupBy(F.col("o_custkey").alias("k")).agg(
        F.min("age").alias("rec"),
        F.min(F.when(F.col("o_orderstatus") == "F", F.col("age"))).alias("rec_core"),
        F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"),
        F.count_if(F.col("o_orderpriority") == "5-LOW").alias("low"),
        F.sum(ln).alias("n"),
        lines_if(F.col("age") < 365).alias("n1"),
        lines_if(F.col("age") < 730).alias("n2"),
        lines_if(F.col("age") < 1095).alias("n3"),
        F.sum(F.coalesce("lret", F.lit(0))).alias("ret"),
        F.sum(F.coalesce("lret_open", F.lit(0))).alias("ret_open"),
        F.sum(F.coalesce("ldisc9", F.lit(0))).alias("disc9"),
        F.sum(F.coalesce("ldisc10", F.lit(0))).alias("disc10"),
        F.sum(F.coalesce("ltaxed", F.lit(0))).alias("taxed"),
        F.sum(F.coalesce("lbulk", F.lit(0))).alias("bulk"),
        F.sum(F.coalesce("lqty", F.lit(0.0))).cast("bigint").alias("qty"),
    )


def event_aggregates(t: Tables) -> DataFrame:
    ev = t.events.select("user_id", "event_type", "value")
    return ev.groupBy(F.col("user_id").alias("k")).agg(
        F.count(F.lit(1)).alias("en"),
        F.count_if(F.col("event_type") == "error").alias("err"),
        F.count_if((F.col("event_type") == "click") & (F.col("value") < 5.0)).alias("rage"),
    )


def customer_mart(t: Tables, with_label: bool = True, keep_key: bool = True) -> DataFrame:
    """The wide customer table (FIXTURES M) with the optional ``churned`` label."""
    cust = t.customer.select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    nation = t.nation.select("n_nationkey", "n_name")
    ca = customer_aggregates(t)
    ea = event_aggregates(t)

    base = (
        cust.join(nation, cust.c_nationkey == nation.n_nationkey, "inner")
        .join(ca, F.col("c_custkey") == ca.k, "left")
        .drop("k")
        .join(ea, F.col("c_custkey") == ea.k, "left")
        .drop("k")
    )

    key = F.col("c_custkey")
    bal = F.col("c_acctbal")
    z = lambda name: F.coalesce(F.col(name), F.lit(0))
    p6 = key % 6
    p12 = key % 12

    def by_tier(values: dict) -> Column:
        return (
            F.when(bal < ACCTBAL_CUTS[0], values["Starter"])
            .when(bal < ACCTBAL_CUTS[1], values["Professional"])
            .when(bal < ACCTBAL_CUTS[2], values["Business"])
            .otherwise(values["Enterprise"])
        )

    mrr = (
        F.when(bal < ACCTBAL_CUTS[0], F.lit(MRR_BASE["Starter"]) + (key * 7919 % MRR_SPREAD["Starter"]) / 100.0)
        .when(bal < ACCTBAL_CUTS[1], F.lit(MRR_BASE["Professional"]) + (key * 7919 % MRR_SPREAD["Professional"]) / 100.0)
        .when(bal < ACCTBAL_CUTS[2], F.lit(MRR_BASE["Business"]) + (key * 7919 % MRR_SPREAD["Business"]) / 100.0)
        .otherwise(F.lit(MRR_BASE["Enterprise"]) + (key * 7919 % MRR_SPREAD["Enterprise"]) / 100.0)
    )
    n = z("n")
    cols = [
        F.concat(F.lit("CUST-"), _padded((key + 1).cast("string"))).alias("customer_id"),
        by_tier({k: F.lit(k) for k in MRR_BASE}).alias("subscription_type"),
        mrr.alias("monthly_revenue"),
        _i(F.lit(1) + (key * 31 % 84)).alias("tenure_months"),
        F.col("n_name").alias("country"),
        F.col("c_mktsegment").alias("industry"),
        _i(F.least(F.lit(120), z("n1"))).alias("sessions_30d"),
        _i(F.least(F.lit(300), z("n3"))).alias("sessions_90d"),
        _i(F.least(F.lit(90), F.floor(F.coalesce(F.col("rec"), F.lit(2400)) / 12.0))).alias("days_since_last_login"),
        _i(F.least(F.lit(90), F.floor(F.coalesce(F.col("rec_core"), F.lit(2400)) / 24.0))).alias(
            "days_since_last_core_action"
        ),
        F.when(z("n2") == 0, F.lit(0.0))
        .otherwise((2 * F.col("n1") - F.col("n2")) / F.col("n2").cast("double"))
        .alias("login_frequency_change"),
        ((key * 13 % 201 - 100) / 100.0).alias("session_duration_change"),
        _i(F.least(F.lit(20), z("urgent") * F.when(p6 == 1, 5).otherwise(1))).alias("ticket_count"),
        F.greatest(
            F.lit(-1.0),
            (n - F.lit(3.0) * z("ret")) / F.greatest(F.lit(1), n) - F.when(p6 == 1, F.lit(0.75)).otherwise(F.lit(0.0)),
        ).alias("support_sentiment"),
        F.when(p12 == 1, F.lit(0.75))
        .when(z("en") == 0, (key % 31) / 100.0)
        .otherwise(F.col("err") / F.col("en").cast("double"))
        .alias("error_rate"),
        _i(F.least(F.lit(50), z("ret_open") * F.when(p12 == 1, 4).otherwise(1))).alias("failed_api_calls"),
        _i(F.least(F.lit(30), F.when(p12 == 1, F.lit(24)).otherwise(F.coalesce(F.col("rage"), key % 4)))).alias(
            "rage_click_count"
        ),
        _i(
            F.least(F.lit(20), F.when(p6 == 2, 2 * z("disc9")).otherwise(F.floor(z("disc10") / 2.0)))
        ).alias("billing_page_visits"),
        _i(
            F.least(F.lit(10), F.when(p6 == 2, 2 * z("disc10")).otherwise(F.floor(z("disc10") / 4.0)))
        ).alias("downgrade_page_visits"),
        _i(F.least(F.lit(12), z("low"))).alias("invoice_download_frequency"),
        _i(F.when(key % 5 == 0, key % 15).otherwise(F.lit(-1))).alias("trial_expiry_days"),
        F.least(F.lit(1.0), n / F.when(p6 == 3, F.lit(40.0)).otherwise(F.lit(90.0))).alias("tier_capacity_utilization"),
        _i(F.least(F.lit(40), z("bulk"))).alias("export_frequency"),
        _i(F.least(F.lit(10000), z("qty"))).alias("api_usage"),
        F.least(F.lit(1.0), z("qty") / F.when(p6 == 3, F.lit(1200.0)).otherwise(F.lit(4000.0))).alias(
            "api_limit_usage"
        ),
        F.least(
            F.lit(1.0),
            z("taxed") / F.greatest(F.lit(1), n).cast("double") * F.when(p6 == 3, F.lit(2.0)).otherwise(F.lit(1.0)),
        ).alias("seat_limit_usage"),
    ]
    out = base.select(key, *cols)
    if with_label:
        noise = ((key * 6151 % 1001) - 500) / 200.0
        out = out.withColumn("churned", F.when(label_logit() + noise > LABEL_CUT, 1).otherwise(0).cast("int"))
    if not keep_key:
        out = out.drop("c_custkey")
    return out
