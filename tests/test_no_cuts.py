"""Keys, features, labels and inputs that must not be cut or lost."""

from pyspark.sql import functions as F

from keepwell.operators import drift, impact, rules, train
from keepwell.sources.mart import _padded


def test_long_customer_keys_stay_unique(spark):
    keys = [1, 999_999, 1_000_000, 10_000_001]
    out = spark.createDataFrame([(str(k),) for k in keys], "k string").select(_padded(F.col("k"))).collect()
    assert [r[0] for r in out] == ["000001", "999999", "1000000", "10000001"]


def test_features_without_values_are_reported(spark):
    rows = [("a", s, float(v)) for s in ("ref", "prod") for v in range(20)] + [("b", s, None) for s in ("ref", "prod")]
    long = spark.createDataFrame(rows, "feature string, side string, value double")
    psi = {r.feature: r.psi for r in drift.psi_table(long).collect()}
    ks = {r.feature: (r.ks_statistic, r.ks_pvalue) for r in drift.ks_table(long).collect()}
    assert psi == {"a": 0.0, "b": 0.0} and ks["b"] == (0.0, 1.0)


def test_rows_without_a_label_stay(spark):
    df = spark.createDataFrame([(str(k), None if k % 5 == 0 else k % 2) for k in range(50)], "customer_id string, churned int")
    assert train.stratified_split(df).count() == 50


def test_text_conditions(spark):
    df = spark.createDataFrame([("Enterprise", 1.0), ("Basic", 2.0), (None, float("nan"))], "subscription_type string, x double")
    got = df.select(rules.predicate(df.columns, {"subscription_type_eq": "Enterprise", "x_lte": 1}).alias("p")).collect()
    assert [r.p for r in got] == [True, False, False]


def test_totals_of_nothing_are_one_row(spark):
    schema = "revenue_saved double, p_saved double, campaign_cost_total double, incremental_profit double, monthly_revenue double"
    rows = impact.impact_totals(spark.createDataFrame([], schema)).collect()
    assert len(rows) == 1 and rows[0].total_at_risk_users == 0 and rows[0].net_incremental_profit == 0


def test_models_are_compared_with_full_settings(spark, monkeypatch):
    import inspect
    from types import SimpleNamespace

    from keepwell import catalog

    zoo = train.model_zoo("weight", 100)
    settings = {n: e.getNumTrees() if n == "random_forest" else e.getMaxIter() for n, e in zoo.items()}
    assert settings == {"logistic_regression": 1000, "random_forest": 200, "gbt_a": 200, "gbt_b": 200, "gbt_c": 200}
    assert "light" not in inspect.signature(train.compare_models).parameters
    asked = []
    best = {"roc_auc": 0.7, "f1": 0.5, "precision": 0.5, "recall": 0.5, "train_roc_auc": 0.8}
    monkeypatch.setattr(train, "compare_models", lambda df, **how: asked.append(how) or (None, None, None, best))
    monkeypatch.setattr(catalog, "st", lambda spark, d: SimpleNamespace(features=None))
    catalog.k12_model_comparison(spark, "")
    catalog.k18_quality_gates(spark, "")
    assert asked == [{"cv_folds": 5}, {}]
