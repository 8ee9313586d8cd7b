"""Training plan: split, compare, choose, tune, save, log; then score and decide with what was saved.

The saved champion is a whole pipeline from raw customers to probabilities.
Scoring loads it from its folder, so a scoring job needs the folder and the
customers and nothing of the training session.  High-risk customers get the
driver that the champion's attribution names: by its trees if it is an
ensemble (M1), by sampled permutations if not (M2).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import explain, train
from ..operators.pipeline import champion_metadata, load_champion, save_champion, with_classifier
from ..operators.sampled_attribution import background_rows, sampled_attribution
from ..operators.tree_attribution import tree_attribution
from ..session import ensure_checkpoint_dir, materialize
from .batch import Stages, recommendations


@dataclass
class Training:
    """One training run over a table of customers; every step is done once, when it is asked for."""

    stages: Stages
    cv_folds: int = 0
    #: Search settings of a boosted champion; the tuned model replaces it without another comparison.
    tune: bool = False
    #: Folder of the champion; a folder for the training rows in the shared one if none is given.
    folder: str | None = None

    @cached_property
    def compared(self) -> tuple:
        return train.compare_models(self.stages.features, cv_folds=self.cv_folds)

    @property
    def table(self) -> DataFrame:
        return self.compared[0]

    @cached_property
    def champion(self) -> PipelineModel:
        _, model, scaler, best = self.compared
        if self.tune and best["model"] in train.GRIDS:
            _, model, scaler = train.random_search(self.stages.features, best["model"])
        return with_classifier(scaler, model)

    @cached_property
    def saved(self) -> str:
        """The folder, once the champion and its metadata are there."""
        spark = self.stages.spark
        folder = self.folder or f"{ensure_checkpoint_dir(spark)}/champion-{train.fingerprint(self.stages.mart)}"
        save_champion(self.champion, self.compared[3], folder)
        return folder

    def metadata(self) -> DataFrame:
        return champion_metadata(self.stages.spark, self.saved)

    def scoring(self) -> Stages:
        """The decision stages over the same tables, scored by the champion as it was saved."""
        stages = Stages(self.stages.spark, self.stages.sf_dir, self.stages.threshold, self.stages.materialized, load_champion(self.saved))
        stages.mart = self.stages.mart  # the customers that were trained on, not derived from the tables again
        return stages

    def attribution(self) -> DataFrame:
        """High-risk customers by the saved champion: customer_id, churn_probability, phi."""
        champion, classifier = load_champion(self.saved), self.champion.stages[-1]
        scored = champion.transform(self.stages.mart).withColumn("churn_probability", vector_to_array(F.col("probability"))[1])
        high = scored.filter(F.col("churn_probability") >= self.stages.threshold).select("customer_id", "churn_probability", "features")
        high = materialize(high)  # read more than once, and kept apart from the long expressions of the features
        if hasattr(classifier, "trees"):
            return tree_attribution(high, champion.stages[-1]).drop("base_value")
        split = train.stratified_split(self.stages.mart)
        background = background_rows(PipelineModel(champion.stages[:-1]).transform(split.filter(~F.col("is_test"))))
        long = sampled_attribution(high, champion.stages[-1], background)
        # one row for each feature of the model
        phi = F.array_sort(F.collect_list(F.struct("pos", "feature", "shap_value", "feature_value"))).alias("phi")
        return high.drop("features").join(long.groupBy("customer_id").agg(phi), "customer_id")

    def explanations(self) -> DataFrame:
        """M6 of the champion."""
        return explain.batch_explanations(self.attribution(), self.stages.threshold)

    def recommendations(self) -> DataFrame:
        """A11 of the champion: its high-risk customers with archetype, action and value, and their own drivers."""
        drivers = self.explanations().select("customer_id", "primary_driver")
        return recommendations(self.scoring().decided.drop("primary_driver").join(drivers, "customer_id", "left"))

    def log(self, path: str | None = None) -> DataFrame:
        """A row for each model and one for the run as a whole, appended to ``path``; the rows of this run."""
        rows = [r.asDict() for r in self.table.collect()]
        zoo = train.model_zoo()
        named = lambda e: {p.name: v for p, v in e.extractParamMap().items()}
        runs = [(r["model"], named(zoo[r["model"]]), {k: v for k, v in r.items() if isinstance(v, float)}, None, None) for r in rows]
        size = self.stages.mart.agg(F.count(F.lit(1)).alias("n"), F.avg("churned").alias("rate")).first()
        best = self.compared[3]
        whole = {f"champion_{k}": v for k, v in best.items() if isinstance(v, float)} | {"comparison": rows}
        runs.append(("full_pipeline", {"champion_model": best["model"]}, whole, size["n"], size["rate"]))
        return train.log_runs(self.stages.spark, path or f"{self.saved}/runs", runs)
