"""Tree and sampled attribution: additivity, all subsets of features, and the exact values of a linear score."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from keepwell.operators import explain, tree_attribution
from keepwell.operators.sampled_attribution import background_rows, sampled_attribution
from keepwell.operators.tree_attribution import ensemble_nodes, paths_of, shapley

NAMES = [f"f{k}" for k in range(6)]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    out = []
    for k in range(400):
        x = [rng.choice([0.0, 0.5, 1.0, rng.random()]) for _ in NAMES]
        out.append((f"c{k}", x, float(x[0] + x[1] * x[2] + rng.gauss(0, 0.3) > 0.9), 1.0 + (k % 3)))
    kind = "customer_id string, x array<double>, label double, w double"
    return spark.createDataFrame(out, kind).withColumn("features", array_to_vector("x")).drop("x").cache()


@pytest.fixture(scope="module")
def forest(rows):
    return RandomForestClassifier(numTrees=7, maxDepth=5, seed=3, weightCol="w").fit(rows)


@pytest.fixture(scope="module")
def boosted(rows):
    return GBTClassifier(maxIter=6, maxDepth=3, stepSize=0.3, subsamplingRate=0.8, seed=3, weightCol="w").fit(rows)


@pytest.mark.parametrize("per_pass", [30, 200_000])
@pytest.mark.parametrize("name", ["forest", "boosted"])
def test_values_and_base_add_up_to_the_score(request, monkeypatch, rows, name, per_pass):
    monkeypatch.setattr(tree_attribution, "NODES_PER_PASS", per_pass)
    monkeypatch.setattr(tree_attribution, "CELLS", 500)
    model = request.getfixturevalue(name)
    score = "probability" if name == "forest" else "rawPrediction"
    given = model.transform(rows).withColumn("score", vector_to_array(F.col(score))[1]).drop("rawPrediction", "probability", "prediction")
    out = tree_attribution.tree_attribution(given, model, names=NAMES).collect()
    assert len(out) == 400
    for r in out:
        assert abs(sum(p.shap_value for p in r.phi) + r.base_value - r.score) < 1e-9
        assert [(p.pos, p.feature) for p in r.phi] == list(enumerate(NAMES))
    assert any(abs(p.shap_value) > 0.01 for r in out for p in r.phi)


def expected(nodes, x, known):
    """The score of a tree when only ``known`` features are: other splits go both ways by training weight."""
    def at(n):
        if n["low"] < 0:
            return n["value"]
        low, high = nodes[n["low"]], nodes[n["high"]]
        if n["feature"] in known:
            return at(low if x[n["feature"]] <= n["threshold"] else high)
        return (low["cover"] * at(low) + high["cover"] * at(high)) / n["cover"]

    return at(nodes[0])


@pytest.mark.parametrize("name", ["forest", "boosted"])
def test_values_equal_all_subsets(request, rows, name):
    nodes = ensemble_nodes(request.getfixturevalue(name)).collect()
    trees = {}
    for n in nodes:
        trees.setdefault(n["tree"], {})[n["node"]] = n
    x = np.array([r.features.toArray() for r in rows.limit(12).collect()])
    got, k = shapley(paths_of(nodes), x), len(NAMES)
    for row, values in zip(x, got, strict=True):
        score = {s: sum(expected(t, row, s) for t in trees.values()) for n in range(k + 1) for s in itertools.combinations(range(k), n)}
        for j in range(k):
            want = sum(
                math.factorial(len(s)) * math.factorial(k - 1 - len(s)) / math.factorial(k) * (score[tuple(sorted((*s, j)))] - v)
                for s, v in score.items() if j not in s
            )
            assert abs(values[j] - want) < 1e-9


def test_an_ensemble_of_leaves_has_only_a_base():
    paths = paths_of([{"tree": 0, "node": 0, "low": -1, "high": -1, "feature": -1, "threshold": None, "cover": 4.0, "value": 0.25}])
    assert paths.base == 0.25 and not shapley(paths, np.zeros((3, 2))).any()


def test_sampled_values_of_a_linear_score_are_exact(spark, rows):
    model = LogisticRegression(maxIter=20).fit(rows)
    background = background_rows(rows, n=20)
    margin = vector_to_array(F.col("rawPrediction"))[1]
    some = rows.filter(F.col("customer_id").isin([f"c{k}" for k in range(15)]))
    got = sampled_attribution(some, model, background, names=NAMES, value=margin).collect()
    assert len(got) == 15 * len(NAMES)
    x = {r.customer_id: r.features.toArray() for r in some.collect()}
    mean = np.mean(background, axis=0)
    for r in got:
        assert abs(r.shap_value - model.coefficients[r.pos] * (x[r.customer_id][r.pos] - mean[r.pos])) < 1e-9
        assert r.feature == NAMES[r.pos] and r.feature_value == x[r.customer_id][r.pos]


def test_sampled_values_add_up_and_converge(rows, forest):
    background = background_rows(rows, n=10)
    some = rows.filter(F.col("customer_id").isin(["c1", "c2"]))
    p = lambda frame: {r.customer_id: r.p for r in forest.transform(frame).select("customer_id", vector_to_array(F.col("probability"))[1].alias("p")).collect()}
    spark = rows.sparkSession
    base = spark.createDataFrame([(str(k), b) for k, b in enumerate(background)], "customer_id string, x array<double>")
    mean = np.mean(list(p(base.withColumn("features", array_to_vector("x"))).values()))
    few, many = (sampled_attribution(some, forest, background, per_row=k, names=NAMES).collect() for k in (1, 30))
    for out in (few, many):
        for c, score in p(some).items():
            assert abs(sum(r.shap_value for r in out if r.customer_id == c) - (score - mean)) < 1e-9
    # The error falls with the draws, and tells how far the two estimates are apart.
    assert sum(r.std_error for r in many) < sum(r.std_error for r in few) / 2 and all(r.std_error > 0 for r in many)
    exact = {(r.customer_id, r.pos): r for r in many}
    for r in few:
        m = exact[r.customer_id, r.pos]
        assert abs(r.shap_value - m.shap_value) <= 5 * (r.std_error + m.std_error) + 1e-9


def test_explanations_take_any_attribution(rows, forest):
    scored = forest.transform(rows).withColumn("churn_probability", vector_to_array(F.col("probability"))[1]).drop("rawPrediction", "probability", "prediction")
    out = tree_attribution.tree_attribution(scored.limit(20), forest, names=NAMES)
    said = explain.batch_explanations(out, 0.0).collect()
    assert len(said) == 20 and {r.primary_driver for r in said} <= set(NAMES)
    first = {r.customer_id: max(r.phi, key=lambda p: (abs(p.shap_value), p.pos)).feature for r in out.collect()}
    assert {r.customer_id: r.primary_driver for r in said} == first
    assert sorted(r.feature for r in explain.global_importance(out).collect()) == NAMES


def test_margins_of_a_logistic_regression_give_the_values_of_all_its_prefixes(spark, rows):
    model = LogisticRegression(maxIter=20, regParam=0.01, weightCol="w").fit(rows)
    background = background_rows(rows, n=15)
    part = rows.filter("customer_id like 'c1%'").limit(30)
    other = rows.limit(2)
    # A key that comes twice with other features, one that comes twice with the same, and one that is null.
    some = part.unionByName(part.limit(3)).unionByName(other.withColumn("customer_id", F.lit("c11")))
    some = some.unionByName(other.withColumn("customer_id", F.lit(None).cast("string")))
    some = spark.createDataFrame(some.collect(), some.schema)
    fast = sampled_attribution(some, model, background, per_row=2, names=NAMES)
    # Not a row for each draw and prefix: the only generator gives the features.
    assert fast._jdf.queryExecution().optimizedPlan().toString().count("Generate ") == 1
    slow = sampled_attribution(some, model, background, per_row=2, names=NAMES, value=vector_to_array(F.col("probability"))[1])
    assert fast.dtypes == slow.dtypes
    order = lambda r: (r.customer_id, r.pos, r.feature_value, r.shap_value)
    a, b = sorted(fast.collect(), key=order), sorted(slow.collect(), key=order)
    assert len(a) == len(b) == 6 * (some.count() - 2)
    for r, t in zip(a, b, strict=True):
        assert (r.customer_id, r.pos, r.feature, r.feature_value) == (t.customer_id, t.pos, t.feature, t.feature_value)
        assert abs(r.shap_value - t.shap_value) < 1e-12 and abs(r.std_error - t.std_error) < 1e-12
