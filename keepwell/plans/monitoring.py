"""Monitoring plan: reference vs production batches from the test tables.

Both batches hold every customer.  The production batch is scored on the
whole order and event logs; the reference batch is scored as of an earlier
day, from the orders up to ``REFERENCE_AGE`` days before the last one and the
events of the first ``REFERENCE_EVENT_DAYS`` days.  Behaviour that adds up
over time drifts between the two, behaviour within a fixed window hardly, and
attributes of the customer not at all.  The days are scalar subqueries (no
hard-coded date).
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import drift
from ..schema import MODEL_FEATURES
from ..sources.tables import Tables
from .batch import Stages

REFERENCE_AGE = 730
REFERENCE_EVENT_DAYS = 15


class EarlierTables(Tables):
    """The tables as they stood on the reference day."""

    @property
    def orders(self) -> DataFrame:
        rows = self.read("orders")
        last = rows.select(F.max(F.to_date("o_orderdate"))).scalar()
        return rows.where(F.to_date("o_orderdate") <= F.date_sub(last, REFERENCE_AGE))

    @property
    def events(self) -> DataFrame:
        rows = self.read("events")
        first = rows.select(F.min(F.to_date("ts"))).scalar()
        return rows.where(F.to_date("ts") < F.date_add(first, REFERENCE_EVENT_DAYS))


class EarlierStages(Stages):
    @cached_property
    def tables(self) -> Tables:
        return EarlierTables(self.spark, self.sf_dir)


def batches(stages: Stages) -> tuple[DataFrame, DataFrame]:
    reference = EarlierStages(stages.spark, stages.sf_dir, stages.threshold, stages.materialized)
    return reference.scored, stages.scored


def monitor(stages: Stages, features: list[str] = MODEL_FEATURES) -> dict:
    ref, prod = batches(stages)
    return drift.run_monitoring(
        ref,
        prod,
        features,
        ref.select("churn_probability"),
        prod.select("churn_probability"),
    )
