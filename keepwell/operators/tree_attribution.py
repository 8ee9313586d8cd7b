"""M1: additive attribution of tree ensembles, path-dependent (Lundberg et al. 2018).

The nodes of a fitted ensemble are read from what Spark ML writes of it.  Each
leaf is a game among the features on its path: a feature that is out sends a
row down both sides in proportion to the training weight there.  Its Shapley
values come from the path's polynomial, the product over the features of
z (1 - u) + o u, where o says whether the row keeps to the path and z is the
share of weight that does.  The weights of the coalition sizes are Beta
integrals, so a feature's value is the integral over u in [0, 1] of the
product without it, times (o - z) and the leaf's value.  The polynomial's
degree is less than the number of features on the path, hence Gauss-Legendre
points of half that number give the integral exactly.

All leaves and a slice of rows are handled in one array operation.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import MODEL_FEATURES
from ..session import ensure_checkpoint_dir

#: Nodes of the trees that one pass explains and broadcasts; a larger ensemble takes several passes, whose values add up.
NODES_PER_PASS = 200_000
#: Numbers in one array of a worker.
CELLS = 2_000_000


def ensemble_nodes(model) -> DataFrame:
    """The nodes of a fitted random forest or boosted ensemble: tree, node, feature, threshold, low, high, cover, value.

    ``value`` is what the node adds to the class-1 score when it is a leaf: for
    boosted trees to the raw margin, for a forest to the probability.
    ``cover`` is its training weight, ``low`` and ``high`` its children, -1 for
    a leaf.  A split on categories has no threshold and is an error.
    """
    spark = SparkSession.active()
    path = f"{ensure_checkpoint_dir(spark)}/ensemble-{uuid.uuid4().hex}"
    model.write().save(path)
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
    boosted = "GBT" in type(model).__name__
    weights = F.create_map(*[F.lit(x) for k, w in enumerate(model.treeWeights) for x in (k, float(w))])
    total = F.aggregate("impurityStats", F.lit(0.0), lambda a, x: a + x)
    if boosted:
        cover, value = F.col("impurityStats")[0], F.col("prediction") * weights[F.col("treeID")]
    else:
        cover, value = total, F.col("impurityStats")[1] / total / model.getNumTrees
    split = F.col("split")
    threshold = F.when(F.col("leftChild") < 0, F.lit(None).cast("double")).when(split["numCategories"] == -1, F.get(split["leftCategoriesOrThreshold"], F.lit(0)))
    return nodes.select(
        F.col("treeID").alias("tree"), F.col("id").alias("node"), split["featureIndex"].alias("feature"),
        threshold.otherwise(F.raise_error(F.lit("a split on categories cannot be attributed"))).alias("threshold"),
        F.col("leftChild").alias("low"), F.col("rightChild").alias("high"), cover.alias("cover"), value.alias("value"),
    )


@dataclass
class Paths:
    """All leaves of some trees, each with the features on its path; shorter ones are filled up with a feature that takes no part."""

    feature: np.ndarray
    above: np.ndarray
    upto: np.ndarray
    share: np.ndarray
    value: np.ndarray

    @property
    def base(self) -> float:
        """The mean score of the training weight."""
        return float((self.value * self.share.prod(axis=1)).sum())


def paths_of(nodes: list) -> Paths:
    """The leaves of trees given as rows of ``ensemble_nodes``."""
    by_place = {(n["tree"], n["node"]): n for n in nodes}
    found: list[tuple[float, dict[int, tuple[float, float, float]]]] = []
    stack = [(n, {}) for n in nodes if n["node"] == 0]
    while stack:
        n, on = stack.pop()
        if n["low"] < 0:
            found.append((n["value"], on))
            continue
        for child, is_low in ((by_place[n["tree"], n["low"]], True), (by_place[n["tree"], n["high"]], False)):
            above, upto, share = on.get(n["feature"], (-np.inf, np.inf, 1.0))
            limits = (above, min(upto, n["threshold"])) if is_low else (max(above, n["threshold"]), upto)
            stack.append((child, on | {n["feature"]: (*limits, share * child["cover"] / n["cover"])}))
    width = max((len(on) for _, on in found), default=0) or 1
    feature = np.zeros((len(found), width), dtype=np.int64)
    above, upto = np.full(feature.shape, -np.inf), np.full(feature.shape, np.inf)
    share = np.ones(feature.shape)
    for i, (_, on) in enumerate(found):
        for j, (f, (a, b, z)) in enumerate(on.items()):
            feature[i, j], above[i, j], upto[i, j], share[i, j] = f, a, b, z
    return Paths(feature, above, upto, share, np.array([v for v, _ in found]))


def shapley(paths: Paths, x: np.ndarray) -> np.ndarray:
    """Values of each row of ``x`` (rows by features) and feature; with ``paths.base`` they add up to the score."""
    out = np.zeros(x.shape)
    leaves, width = paths.feature.shape
    points, weights = np.polynomial.legendre.leggauss(-(-width // 2))
    points, weights = (points + 1) / 2, weights / 2
    rows = max(1, CELLS // (leaves * width))
    by_feature = np.argsort(paths.feature.ravel(), kind="stable")
    names, begins = np.unique(paths.feature.ravel()[by_feature], return_index=True)
    for at in range(0, len(x), rows):
        part = x[at : at + rows]
        given = part[:, paths.feature]
        keeps = (given > paths.above) & (given <= paths.upto)
        inner = np.zeros(keeps.shape)
        for u, w in zip(points, weights, strict=True):
            factor = paths.share * (1 - u) + keeps * u
            inner += w * factor.prod(axis=2, keepdims=True) / factor
        value = (paths.value[:, None] * (keeps - paths.share) * inner).reshape(len(part), -1)
        out[at : at + rows, names] += np.add.reduceat(value[:, by_feature], begins, axis=1)
    return out


def tree_attribution(df: DataFrame, model, features_col: str = "features", names: list[str] = MODEL_FEATURES) -> DataFrame:
    """``df`` (without vector columns) with ``base_value`` and ``phi``, the values of ``model`` for each row.

    ``features_col`` is the vector that the model was fitted on.  ``phi`` is an
    array in feature order of pos, feature, shap_value and feature_value, as
    the other attributions give it.  The values and the base add up to the
    class-1 score: the raw margin of boosted trees, the probability of a
    forest.  The nodes pass through the driver, like the model itself.
    """
    nodes = ensemble_nodes(model)
    sizes = sorted((r["tree"], r["n"]) for r in nodes.groupBy("tree").agg(F.count(F.lit(1)).alias("n")).collect())
    blocks, held = [[]], 0
    for tree, n in sizes:
        if held and held + n > NODES_PER_PASS:
            blocks.append([])
            held = 0
        blocks[-1].append(tree)
        held += n
    vectors = [f.name for f in df.schema.fields if isinstance(f.dataType, T.UserDefinedType)]
    rows = df.withColumns({"_x": vector_to_array(F.col(features_col)), "_phi": F.array_repeat(F.lit(0.0), len(names))}).drop(*vectors)
    base = 0.0
    for block in blocks:
        paths = paths_of(nodes.filter(F.col("tree").isin(block)).collect())
        base += paths.base
        rows = _added(rows, paths, len(names))
    items = [
        F.struct(F.lit(i).alias("pos"), F.lit(f).alias("feature"), F.col("_phi")[i].alias("shap_value"), F.col("_x")[i].alias("feature_value"))
        for i, f in enumerate(names)
    ]
    return rows.withColumns({"base_value": F.lit(base), "phi": F.array(*items)}).drop("_x", "_phi")


def _added(rows: DataFrame, paths: Paths, width: int) -> DataFrame:
    """``rows`` with the values of some trees added to ``_phi``."""
    shared = rows.sparkSession.sparkContext.broadcast(paths)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            x, phi = (columns[c].flatten().to_numpy(zero_copy_only=False).reshape(-1, width) for c in ("_x", "_phi"))
            values = phi + shapley(shared.value, x)
            ends = pa.array(np.arange(len(x) + 1) * width, pa.int32())
            columns["_phi"] = pa.ListArray.from_arrays(ends, pa.array(values.ravel()))
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return rows.mapInArrow(run, rows.schema)
