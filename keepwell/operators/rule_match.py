"""D3 for rule sets of any size: rules and conditions as tables, matched inside each row.

The compiled ``CASE`` of ``rules.match_sql`` grows with the rule set until it
is too large for one generated method.  Here the rules of an archetype, in the
order of priority and then file position, are one array of conditions, which
meets the customers by archetype.  A rule applies if none of its conditions
fails (relational division); the first that does is taken, and later ones are
not looked at.  No customer becomes more than one row, and a frequent
archetype is spread like all other rows, as the arrays are broadcast.

Arrays of at most ``RULES_PER_PASS`` rules are broadcast at once; a larger set
is matched in several passes in the order of priority, each for what is still
without a rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import ACTION_COLUMNS, RuleSet, conditions_frame, load_rules, rules_frame

RULES_PER_PASS = 20_000


def _failed(condition: Column, values: Column, texts: Column) -> Column:
    """Whether a condition on a present feature does not hold; null and NaN hold nothing."""
    x, t, op = F.get(values, condition["feature"]), condition["threshold"], condition["op"]
    s, u = F.get(texts, condition["feature"]), condition["threshold_text"]
    number = (
        F.when(op == "gte", x >= t).when(op == "lte", x <= t).when(op == "eq", x == t).when(op == "gt", x > t).when(op == "lt", x < t)
    )
    text = (
        F.when(op == "gte", s >= u).when(op == "lte", s <= u).when(op == "eq", s == u).when(op == "gt", s > u).when(op == "lt", s < u)
    )
    return ~F.coalesce(F.when(u.isNotNull(), text).otherwise(number & ~F.isnan(x)), F.lit(False))


def match_rules(df: DataFrame, rules: DataFrame, conditions: DataFrame, archetype_col: str = "churn_archetype") -> DataFrame:
    """``df`` with ``position``, that of the first rule of the row's archetype that applies; null if none does.

    ``rules`` has archetype, priority and position (unique); ``conditions``
    has position, feature, op (null for an unknown one) and threshold or
    threshold_text.  A condition on a feature that ``df`` lacks holds; a rule
    with an unknown operator never applies; one without conditions always
    does.  Equal priorities go by position.  Text thresholds compare with the
    feature as text.
    """
    mentioned = [r["feature"] for r in conditions.filter(F.col("feature").isin(df.columns)).select("feature").distinct().collect()]
    names = sorted(mentioned)  # at most the columns of df
    number = {n: i for i, n in enumerate(names)}
    kinds = dict(df.dtypes)
    values = F.array(*[F.col(n).try_cast("double") if kinds[n] == "string" else F.col(n).cast("double") for n in names]).cast("array<double>")
    texts = F.array(*[F.col(n).cast("string") for n in names]).cast("array<string>")
    place = F.create_map(*[F.lit(x) for n, i in number.items() for x in (n, i)]) if names else None
    present = conditions.filter(F.col("op").isNull() | F.col("feature").isin(names))
    feature = F.coalesce(F.try_element_at(place, F.col("feature")), F.lit(-1)) if names else F.lit(-1)
    parts = F.collect_list(F.struct(feature.alias("feature"), "op", "threshold", "threshold_text"))
    by_rule = rules.join(present.groupBy("position").agg(parts.alias("conditions")), "position", "left")
    n = rules.filter(F.col("archetype").isNotNull()).count()
    # A pass holds whole priorities, those before the next pass's.
    ranked = by_rule.filter(F.col("archetype").isNotNull())
    passes = max(1, -(-n // RULES_PER_PASS))
    edges = []
    if passes > 1:
        shares = F.array(*[F.lit(k / passes) for k in range(1, passes)])
        edges = sorted(set(ranked.agg(F.percentile_approx("priority", shares)).first()[0]))
    archetype = F.col(archetype_col) if archetype_col in df.columns else F.lit("A")
    out = df.withColumns({"_values": values, "_texts": texts, "_archetype": archetype, "position": F.lit(None).cast("int")})
    for low, high in zip([None, *edges], [*edges, None], strict=True):
        part = ranked
        if low is not None:
            part = part.filter(F.col("priority") > low)
        if high is not None:
            part = part.filter(F.col("priority") <= high)
        arrays = part.groupBy(F.col("archetype").alias("_of")).agg(
            F.array_sort(F.collect_list(F.struct("priority", "position", F.coalesce("conditions", F.array()).alias("conditions")))).alias("_rules")
        )
        joined = out.join(F.broadcast(arrays), F.col("_archetype") == F.col("_of"), "left")
        fails = lambda rule: F.exists(rule["conditions"], lambda c: _failed(c, F.col("_values"), F.col("_texts")))
        first = F.aggregate(
            "_rules", F.lit(None).cast("int"), lambda found, rule: F.when(found.isNotNull(), found).when(~fails(rule), rule["position"])
        )
        out = joined.withColumn("position", F.coalesce("position", first)).drop("_of", "_rules")
    return out.drop("_values", "_texts", "_archetype")


def recommend_by_tables(df: DataFrame, rules: RuleSet | None = None, archetype_col: str = "churn_archetype") -> DataFrame:
    """E9 by tables: the same columns as ``rules.recommend``, for a rule set of any size."""
    rules, spark = rules or load_rules(), df.sparkSession
    table = rules_frame(spark, rules)
    matched = match_rules(df, table, conditions_frame(spark, rules), archetype_col)
    actions = table.select(F.col("position").alias("_at"), *[F.col(c).alias(f"_rec_{c}") for c in ACTION_COLUMNS])
    at = F.coalesce("position", F.lit(len(rules.rules)))  # the fallback's place
    return matched.join(actions, at == F.col("_at")).select(*df.columns, *[F.col(f"_rec_{c}").alias(c) for c in ACTION_COLUMNS])
