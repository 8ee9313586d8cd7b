"""Rules as tables: equal to the compiled CASE, and to a plain loop for thousands of rules."""

import random

import pytest
from pyspark.sql import functions as F

from keepwell.operators import rule_match
from keepwell.operators.archetypes import classify
from keepwell.operators.rule_match import recommend_by_tables
from keepwell.operators.rules import ACTION_COLUMNS, Rule, RuleSet, load_rules, recommend
from keepwell.plans.batch import Stages

from sf_dirs import SF_SMALL

FEATURES = ["a", "b", "c", "name", "gone"]


def generated(n, seed=1):
    rng = random.Random(seed)
    rules = []
    for k in range(n):
        conditions = {}
        for f in rng.sample(FEATURES, rng.randrange(0 if rng.random() < 0.02 else 1, 4)):
            op = rng.choice(["gte", "lte", "eq", "gt", "lt"])
            conditions[f"{f}_{op}"] = rng.choice(["x", "y", "z"]) if f == "name" else rng.choice([0, 1, round(rng.random(), 2)])
        if rng.random() < 0.02:
            conditions["a_about"] = 1
        rules.append(Rule(f"R{k}", "", rng.choice("ABCD"), rng.randrange(max(2, n // 10)), conditions, f"do {k}", f"c{k}", "email", "low", 0.1, k / 7, ""))
    return RuleSet(rules, load_rules().fallback)


def plain(row, rules):
    ops = {"gte": lambda x, t: x >= t, "lte": lambda x, t: x <= t, "eq": lambda x, t: x == t, "gt": lambda x, t: x > t, "lt": lambda x, t: x < t}

    def holds(key, t):
        f, _, op = key.rpartition("_")
        if op not in ops:
            return False
        if f not in row:
            return True
        return row[f] is not None and row[f] == row[f] and ops[op](row[f], t)

    for r in rules.ordered(row["churn_archetype"]):
        if all(holds(k, t) for k, t in r.conditions.items()):
            return r.id
    return "FALLBACK"


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(2)
    value = lambda: rng.choice([None, 0.0, 1.0, float("nan"), rng.random()])
    out = [(k, rng.choice(["A", "B", "C", "D", "E"]), value(), value(), rng.choice([None, 0, 1]), rng.choice(["x", "y", None])) for k in range(400)]
    return spark.createDataFrame(out, "id int, churn_archetype string, a double, b double, c int, name string")


@pytest.mark.parametrize("n,per_pass", [(5000, 20_000), (5000, 700), (60, 20_000), (0, 20_000)])
def test_thousands_of_rules_equal_a_plain_loop(rows, monkeypatch, n, per_pass):
    monkeypatch.setattr(rule_match, "RULES_PER_PASS", per_pass)
    rules = generated(n)
    got = {r.id: r for r in recommend_by_tables(rows, rules).collect()}
    assert len(got) == 400
    for r in rows.collect():
        assert got[r.id].rule_id == plain(r.asDict(), rules)
    if n == 60:
        key = lambda r: r.id
        compiled = recommend(rows, rules).select("id", *ACTION_COLUMNS).collect()
        assert sorted(compiled, key=key) == sorted((r for r in recommend_by_tables(rows, rules).select("id", *ACTION_COLUMNS).collect()), key=key)


def test_equal_priorities_go_by_position(spark):
    rules = generated(0)
    rules.rules = [Rule(i, "", "A", 1, {}, i, i, "email", "low", 0.1, 1.0, "") for i in ("second", "first")]
    assert recommend_by_tables(spark.createDataFrame([("A",)], "churn_archetype string"), rules).first().rule_id == "second"


def test_default_rules_on_all_customers(spark):
    customers = classify(Stages(spark, SF_SMALL).scored)
    a, b = (f(customers).select("customer_id", *ACTION_COLUMNS) for f in (recommend, recommend_by_tables))
    assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0 and a.count() == customers.count()
    without = customers.drop("churn_archetype", "sessions_30d")
    a, b = (f(without).select("customer_id", "rule_id") for f in (recommend, recommend_by_tables))
    assert a.exceptAll(b).count() == 0 and a.filter(F.col("rule_id") == "A2").count() > 0
