"""The saved pipeline, concurrent fits and their grouped metrics, search, champion, gates and run log."""

import json
import os
import subprocess
import sys
from threading import Barrier

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from keepwell.operators import train
from keepwell.operators.metrics import average_precision, grouped_metrics, roc_auc, threshold_metrics
from keepwell.operators.pipeline import Standardise, feature_pipeline, load_pipeline, save_pipeline
from keepwell.plans.batch import Stages
from keepwell.plans.training import Training
from keepwell.schema import MODEL_FEATURES
from keepwell.session import materialize

from sf_dirs import SF_SMALL


def small_zoo(weight_col="weight", n_rows=1000):
    kw = {"featuresCol": "features", "labelCol": "label", "seed": 1, "weightCol": weight_col}
    return {
        "logistic_regression": LogisticRegression(featuresCol="features", labelCol="label", maxIter=5, regParam=0.1, weightCol=weight_col),
        "random_forest": RandomForestClassifier(numTrees=4, maxDepth=3, **kw),
        "gbt_a": GBTClassifier(maxIter=2, maxDepth=2, **kw),
    }


@pytest.fixture(scope="module")
def stages(spark):
    s = Stages(spark, SF_SMALL)
    s.__dict__["mart"] = materialize(s.mart)
    return s


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(train, "model_zoo", small_zoo)
    monkeypatch.setitem(train.GRIDS, "gbt_a", {"maxIter": [1, 2], "maxDepth": [1, 2], "stepSize": [0.1, 0.3]})


def test_statistics_come_from_the_training_side_only(stages):
    split = train.stratified_split(stages.features)
    model = Standardise().fit(split.filter(~F.col("is_test")))
    rows = split.select("is_test", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in MODEL_FEATURES]).toPandas()
    known = rows[~rows.is_test][MODEL_FEATURES].to_numpy()
    assert np.allclose(model.getOrDefault(model.means), known.mean(axis=0)) and np.allclose(model.getOrDefault(model.stds), known.std(axis=0))
    assert not np.allclose(known.mean(axis=0), rows[MODEL_FEATURES].to_numpy().mean(axis=0))
    got = np.array([r[0] for r in model.transform(split.filter(~F.col("is_test"))).select(vector_to_array("features")).collect()])
    assert np.allclose(got.mean(axis=0), 0) and all(np.isclose(s, 1) or s == 0 for s in got.std(axis=0))


def test_feature_pipeline_round_trip(stages, tmp_path):
    fitted = feature_pipeline().fit(stages.mart)
    save_pipeline(fitted, str(tmp_path / "p"))
    again = load_pipeline(str(tmp_path / "p"))
    a, b = ({r.customer_id: r.features for r in m.transform(stages.mart).select("customer_id", "features").collect()} for m in (fitted, again))
    assert a == b and len(a) == stages.mart.count()
    odd = stages.mart.limit(1).withColumn("api_usage", F.lit(None).cast("int"))
    assert len(again.transform(odd).first().features) == len(MODEL_FEATURES)


def test_grouped_metrics_equal_those_of_each_group(spark):
    rng = np.random.default_rng(2)
    rows = [(g, float(round(p, 1 + g)), float(rng.random() < p)) for g in range(4) for p in rng.random(80)]
    rows += [(9, 0.3, 1.0), (9, 0.7, 1.0), (8, 0.2, 0.0), (3, 0.4, None)]
    df = spark.createDataFrame(rows, "g int, p double, label double")
    for r in grouped_metrics(df, ["g"], "p", "label").collect():
        part = df.filter((F.col("g") == r.g) & F.col("label").isNotNull())
        t = threshold_metrics(part, "p", "label").first()
        assert (r.tp, r.fp, r.fn, r.tn) == (t.tp, t.fp, t.fn, t.tn)
        for k in ("accuracy", "precision", "recall", "f1"):
            assert abs(r[k] - t[k]) <= 5.1e-5
        for k, one in (("roc_auc", roc_auc), ("pr_auc", average_precision)):
            want = one(part, "p", "label").first()[k]
            assert (r[k] is None and want is None) or abs(r[k] - want) < 1e-12


def test_comparison_fills_every_metric_and_fits_once(stages, small):
    table, champion, scaler, best = train.compare_models(stages.features, cv_folds=3)
    rows = {r.model: r for r in table.collect()}
    assert list(rows) == list(small_zoo()) and all(v is not None for r in rows.values() for v in r)
    assert best["roc_auc"] == max(r.roc_auc for r in rows.values())
    # By hand for one model and fold.
    comparison = train.Comparison(stages.features, folds=3)
    name = "random_forest"
    parts = []
    for k in range(3):
        model = small_zoo()[name].fit(comparison.train.filter(F.col("fold") != k))
        parts.append(roc_auc(train.score(model, comparison.train.filter(F.col("fold") == k)), "p", "label").first()[0])
    assert rows[name].cv_roc_auc_mean == round(sum(parts) / 3, 4)
    fitted = dict(train._FITTED)
    means = {(r.model, r.metric): r.value for r in train.cross_validation(stages.features, folds=3).collect()}
    assert train._FITTED == fitted and len(means) == 15
    assert all(round(means[m, f"{k}_cv_mean"], 4) == rows[m][f"cv_{k}_mean"] for m in rows for k in train.METRICS)
    gates = train.quality_gates(best)
    assert len(gates) == 9 and all(observed is not None for _, _, observed in gates)
    assert abs(sum(train.importances(champion)) - 1) < 1e-9


def test_search_is_reproducible_and_replaces_the_champion(stages, small, monkeypatch):
    assert train.drawn_settings("gbt_b") == train.drawn_settings("gbt_b") != train.drawn_settings("gbt_b", seed=7)
    drawn = train.drawn_settings("gbt_b")
    assert len(drawn) == 20 == len({json.dumps(s, sort_keys=True) for s in drawn})
    assert all(s[k] in v for s in drawn for k, v in train.GRIDS["gbt_b"].items())
    table, tuned, _ = train.random_search(stages.features, "gbt_a", n=5, folds=2)
    rows = table.collect()
    chosen = next(r for r in rows if r.chosen)
    assert len(rows) == 5 and chosen.mean_roc_auc == max(r.mean_roc_auc for r in rows)
    settings = json.loads(chosen.settings)
    assert all(tuned.getOrDefault(k) == v for k, v in settings.items())
    # The tuned model takes the champion's place without another comparison; the metadata are those of the compared one.
    compared = train.compare_models(stages.features)
    run = Training(stages, tune=True)
    run.__dict__["compared"] = (*compared[:3], {**compared[3], "model": "gbt_a", "roc_auc": 0.123})
    monkeypatch.setattr(train, "random_search", lambda df, name: (None, tuned, compared[2]))
    assert run.champion.stages[-1] is tuned and run.metadata().first().roc_auc == 0.123


RELOAD = """
import sys
from keepwell.operators.pipeline import load_champion
from keepwell.operators.scoring import score_model
from keepwell.session import get_session
spark = get_session("local[2]", 2)
folder, customers, out = sys.argv[1:]
score_model(spark.read.parquet(customers), load_champion(folder)).select("customer_id", "churn_probability").write.parquet(out)
"""


def test_champion_is_saved_scored_and_explained(spark, stages, small, tmp_path):
    run = Training(stages, folder=str(tmp_path / "champion"))
    meta = run.metadata().first()
    assert meta.champion_model == run.compared[3]["model"] and meta.feature_names == MODEL_FEATURES
    want = {r.customer_id: r.p for r in train.score(run.champion, stages.mart).select("customer_id", "p").collect()}
    scored = run.scoring().scored
    assert {r.customer_id: r.churn_probability for r in scored.select("customer_id", "churn_probability").collect()} == want
    assert not {"features", "rawPrediction", "probability", "prediction"} & set(scored.columns)
    # In a fresh session of another process.
    stages.mart.write.parquet(str(tmp_path / "customers"))
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", RELOAD, run.saved, str(tmp_path / "customers"), str(tmp_path / "out")], cwd=root, check=True, timeout=300, capture_output=True)
    assert {r.customer_id: r.churn_probability for r in spark.read.parquet(str(tmp_path / "out")).collect()} == want
    high = {c for c, p in want.items() if p >= 0.5}
    for name in ("random_forest", "logistic_regression"):
        run = Training(stages, folder=str(tmp_path / name))
        run.__dict__["champion"] = type(run.champion)([*run.champion.stages[:2], small_zoo()[name].fit(train.Comparison(stages.features).train)])
        said = {r.customer_id: r for r in run.explanations().collect()}
        out = run.recommendations().collect()
        high = {r.customer_id for r in run.scoring().scored.filter("churn_probability >= 0.5").collect()}
        assert high and set(said) == high == {r.customer_id for r in out}
        assert all(r.primary_driver == said[r.customer_id].driver_1_feature for r in out)


def test_run_log_appends(spark, stages, small, tmp_path):
    run = Training(stages, folder=str(tmp_path / "champion"))
    path = str(tmp_path / "runs")
    run.log(path)
    run.log(path)
    rows = spark.read.parquet(path).collect()
    assert len(rows) == 2 * (len(small_zoo()) + 1)
    whole = [r for r in rows if r.run_name == "full_pipeline"]
    assert all(r.n_records == stages.mart.count() and 0 < r.churn_rate < 1 for r in whole)
    assert len(json.loads(whole[0].metrics)["comparison"]) == len(small_zoo())
    assert json.loads(next(r for r in rows if r.run_name == "gbt_a").params)["maxDepth"] == 2


def test_scores_are_computed_once_for_all_metrics(spark):
    seen = spark.sparkContext.accumulator(0)

    def scored(x):
        seen.add(1)
        return x / 50

    rows = spark.createDataFrame([(k % 2, float(k), float(k % 3 == 0)) for k in range(50)], "g int, x double, label double")
    out = grouped_metrics(rows.withColumn("p", F.udf(scored, "double")("x")), ["g"], "p", "label").collect()
    assert len(out) == 2 and seen.value == 50


def test_more_rows_give_larger_tasks_before_more_tasks():
    assert [train.parts_of(n) for n in (0, 12_000, 50_001, 720_000, 4_320_000, 8_000_000, 432_000_000)] == [1, 1, 2, 15, 16, 16, 864]


def test_folds_are_dealt_only_for_a_cross_validation(stages, small, monkeypatch):
    dealt = []
    folds_of = train.stratified_folds
    monkeypatch.setattr(train, "stratified_folds", lambda df, folds: dealt.append(folds) or folds_of(df, folds))
    train.compare_models(stages.features)
    assert dealt == []
    train.compare_models(stages.features, cv_folds=2)
    assert dealt == [2]
    # Fits of the whole training side are shared, with and without folds.
    plain, crossed = train.Comparison(stages.features, folds=0), train.Comparison(stages.features, folds=2)
    assert plain.name == crossed.name and "fold" not in plain.train.columns
    assert set(plain.jobs(False)) == {(m, None) for m in small_zoo()}


def test_champion_scores_the_customers_it_was_trained_on(stages, small, tmp_path, monkeypatch):
    from keepwell.plans import batch

    run = Training(stages, folder=str(tmp_path / "champion"))
    want = {r.customer_id for r in stages.mart.select("customer_id").collect()}
    monkeypatch.setattr(batch, "customer_mart", None)  # not derived from the tables a second time
    assert {r.customer_id for r in run.scoring().scored.select("customer_id").collect()} == want


def test_all_fits_of_a_small_training_side_run_at_once(stages, small, monkeypatch):
    assert [train.fits_at_once(n) for n in (12_000, 50_001, 100_001, 720_000, 432_000_000)] == [24, 12, 8, 8, 8]
    comparison = train.Comparison(stages.features, folds=4)
    together = Barrier(len(comparison.jobs(True)), timeout=60)  # 15 fits, none of which begins before all are there
    for kind in (GBTClassifier, LogisticRegression, RandomForestClassifier):
        monkeypatch.setattr(kind, "fit", lambda self, rows, fit=kind.fit: together.wait() >= 0 and fit(self, rows))
    monkeypatch.setattr(train, "_FITTED", {})
    models, found = comparison.results(True)
    assert len(models) == 15 and not together.broken and all(found[run]["roc_auc"] is not None for run in found)
