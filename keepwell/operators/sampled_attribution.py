"""M2: model-agnostic attribution by sampled permutations (Strumbelj and Kononenko 2014).

A row is turned from a background row into itself, one feature after the other
in the order of a permutation; what the score changes with a feature counts
for it.  All prefixes of all permutations of all rows go through one
``model.transform``.  A prefix's score adds to the feature that came last and
takes from the one that comes next, so the changes need no sorting: two signed
entries for each prefix, summed where they arise before anything is shuffled.

The prefixes of a logistic regression need no vectors of their own: its margin
changes by one term with each feature, so the margins of a permutation are a
running sum.  Their scores are taken for a slice of rows and all draws in one
array operation.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import MODEL_FEATURES

BACKGROUND = 100
SEED = 42
#: The draws are dealt into so many groups, whose means tell the error.
GROUPS = 10
#: Numbers in one array of a worker.
CELLS = 500_000


def background_rows(train: DataFrame, key: str = "customer_id", features_col: str = "features", n: int = BACKGROUND, seed: int = SEED) -> list[list[float]]:
    """``n`` rows of the training side by a seeded hash: a bounded sample, as the method asks for."""
    drawn = train.orderBy(F.xxhash64(F.col(key), F.lit(seed)), F.col(key)).limit(n)
    return [r[0] for r in drawn.select(vector_to_array(F.col(features_col))).collect()]


def sampled_attribution(
    df: DataFrame, model, background: list[list[float]], per_row: int = 1, key: str = "customer_id", features_col: str = "features",
    names: list[str] = MODEL_FEATURES, value: Column | None = None, seed: int = SEED,
) -> DataFrame:
    """(key, pos, feature, shap_value, std_error, feature_value): a row for each row of ``df`` and feature.

    Every background row meets every row of ``df`` with ``per_row``
    permutations of its own.  ``value`` is read from what ``model`` adds, by
    default the probability of class 1.  The values add up to the row's score
    less the background's mean score, exactly; each by itself is an estimate.
    Its standard error is that of a mean over GROUPS random groups of draws; it
    takes the background rows for drawn at random too, and so is rather large.  For
    a score that is linear in the features they are exact.  ``key`` must be
    unique; a row of another with the same key would share its values.
    """
    spark, width = df.sparkSession, len(names)
    rng = random.Random(seed)
    draws, count = [], per_row * len(background)
    # Each group gets as many draws as any other, or one less, with background rows at random.
    dealt = [k % GROUPS for k in range(count)]
    rng.shuffle(dealt)
    for k in range(count):
        rank = list(range(width))
        rng.shuffle(rank)
        order = sorted(range(width), key=rank.__getitem__)
        draws.append((k, dealt[k], dealt.count(dealt[k]), rank, order, background[k % len(background)]))
    rows = df.select(F.col(key), vector_to_array(F.col(features_col)).alias("x"))
    # One row is many scores: spread few rows over all cores.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if value is None and isinstance(model, LogisticRegressionModel) and model.coefficientMatrix.numRows == 1 and model.numFeatures == width:
        return _by_margins(rows, model, draws, parts, key, names)
    # bounded by the two parameters
    design = F.broadcast(spark.createDataFrame(draws, "draw int, group int, size int, rank array<int>, turn array<int>, base array<double>"))
    value = vector_to_array(F.col("probability"))[1] if value is None else value
    each = rows.repartition(parts).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).join(design, "draw")
    prefix = each.withColumn("taken", F.explode(F.sequence(F.lit(0), F.lit(width))))
    mixed = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.when(F.get("rank", i) < F.col("taken"), F.get("x", i)).otherwise(F.get("base", i)))
    scored = model.transform(prefix.withColumn(features_col, array_to_vector(mixed))).withColumn("score", value)
    last = F.when(F.col("taken") > 0, F.get("turn", F.col("taken") - 1))
    following = F.when(F.col("taken") < width, F.get("turn", F.col("taken")))
    entries = F.array(F.struct(last.alias("pos"), F.col("score").alias("d")), F.struct(following.alias("pos"), (-F.col("score")).alias("d")))
    changes = scored.select(key, "group", "size", F.inline(entries)).filter(F.col("pos").isNotNull())
    sums = changes.groupBy(key, "pos", "group", "size").agg(F.sum("d").alias("d"))
    out = sums.groupBy(key, "pos").agg(
        (F.sum("d") / count).alias("shap_value"),
        (F.stddev_samp(F.col("d") / F.col("size")) / F.sqrt(F.count(F.lit(1)))).alias("std_error"),
    )
    feature = F.get(F.array(*[F.lit(f) for f in names]), F.col("pos"))
    return out.join(rows, key).select(key, "pos", feature.alias("feature"), "shap_value", F.coalesce("std_error", F.lit(0.0)).alias("std_error"), F.get("x", F.col("pos")).alias("feature_value"))


class _Margins:
    """The draws with a logistic regression's weights, as arrays with a row for each draw."""

    def __init__(self, model: LogisticRegressionModel, draws: list[tuple]):
        _, group, _, rank, turn, base = (np.array(c) for c in zip(*draws, strict=True))
        weights = model.coefficients.toArray()
        self.rank, self.turn = rank, turn
        self.weights, self.base = weights[turn], np.take_along_axis(base, turn, axis=1)
        self.start = base @ weights + model.intercept
        #: A row for each group that has draws: 1 where a draw is in it.
        self.member = (np.unique(group)[:, None] == group).astype(float)

    def changes(self, x: np.ndarray) -> np.ndarray:
        """What each feature of each row of ``x`` changes, summed by group: rows by groups by features."""
        draw = np.arange(len(self.turn))[:, None]
        out = np.empty((len(x), len(self.member), x.shape[1]))
        rows = max(1, CELLS // self.turn.size)
        for at in range(0, len(x), rows):
            steps = (x[at : at + rows][:, self.turn] - self.base) * self.weights
            margins = np.concatenate([np.zeros((*steps.shape[:2], 1)), np.cumsum(steps, axis=2)], axis=2) + self.start[:, None]
            with np.errstate(over="ignore"):
                scores = 1 / (1 + np.exp(-margins))
            out[at : at + rows] = self.member @ np.diff(scores, axis=2)[:, draw, self.rank]
        return out


def _by_margins(rows: DataFrame, model: LogisticRegressionModel, draws: list[tuple], parts: int, key: str, names: list[str]) -> DataFrame:
    """``sampled_attribution`` of ``rows`` (key, x) for a binary logistic regression."""
    shared = rows.sparkSession.sparkContext.broadcast(_Margins(model, draws))
    width, count = len(names), len(draws)
    # Rows of one key share their values.
    keyed = rows.filter(F.col(key).isNotNull()).repartition(parts, key).groupBy(key).agg(F.collect_list("x").alias("x"))
    schema = rows.select(F.col(key), *[F.col("x").alias(c) for c in ("shap_value", "std_error", "feature_value")]).schema

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        margins = shared.value
        sizes = margins.member.sum(axis=1)[:, None]
        for batch in batches:
            if not batch.num_rows:
                continue
            many = batch.column("x").value_lengths().to_numpy(zero_copy_only=False)
            x = batch.column("x").flatten().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            for at, to in _slices(many):
                first = np.cumsum(many[at:to]) - many[at:to]
                given = x[many[:at].sum() : many[:to].sum()]
                changes = np.add.reduceat(margins.changes(given), first, axis=0)
                values = changes.sum(axis=1) / count
                of_group = changes / sizes
                errors = of_group.std(axis=1, ddof=1) / np.sqrt(len(sizes)) if len(sizes) > 1 else np.zeros(values.shape)
                ends = pa.array(np.arange(len(given) + 1) * width, pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.ravel(c))) for c in (np.repeat(values, many[at:to], axis=0), np.repeat(errors, many[at:to], axis=0), given)]
                keys = batch.column(key).take(pa.array(np.repeat(np.arange(at, to), many[at:to])))
                yield pa.RecordBatch.from_arrays([keys, *lists], names=schema.names)

    found = keyed.mapInArrow(run, schema)
    feature = F.array(*[F.lit(f) for f in names]).alias("feature")
    zipped = F.posexplode(F.arrays_zip(feature, "shap_value", "std_error", "feature_value")).alias("pos", "v")
    return found.select(key, zipped).select(key, "pos", "v.feature", "v.shap_value", "v.std_error", "v.feature_value")


def _slices(many: np.ndarray, rows: int = 2_000) -> list[tuple[int, int]]:
    """(from, to) of stretches of keys that hold about ``rows`` rows."""
    cuts = np.flatnonzero(np.diff(np.cumsum(many) // rows)) + 1
    return [*zip([0, *cuts.tolist()], [*cuts.tolist(), len(many)], strict=True)]
