"""Connected components of a link table, as repeated joins on the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepwell.session import materialize


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of a link; root is one node of its component.

    Each round every node points to the one of itself and its neighbours
    whose hash is least, pointers are followed once more, and links are
    redrawn between the pointers; links inside a component vanish.  Hashes
    change with the round, so a share of the nodes goes in each, whatever the
    order along a chain, and rounds grow with the logarithm of the longest.
    Neighbours are never gathered: a node's choice is a pre-aggregated
    ``min``.  Self links and repeated links are allowed.  No links give no
    rows.
    """
    links = materialize(links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct())
    labels, rounds = None, 0
    while not links.isEmpty():
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
        rounds += 1
        hashed = F.xxhash64(F.lit(rounds), "v")
        least = both.groupBy("u").agg(F.min(F.struct(hashed.alias("h"), "v")).alias("least"))
        first = least.select("u", F.when(F.col("least.h") < F.xxhash64(F.lit(rounds), "u"), F.col("least.v")).otherwise(F.col("u")).alias("p"))
        then = first.select(F.col("u").alias("p"), F.col("p").alias("q"))
        up = materialize(first.join(then, "p").select("u", F.col("q").alias("p")))
        if labels is None:
            labels = up.select(F.col("u").alias("node"), F.col("p").alias("root"))
        else:
            moved = up.select(F.col("u").alias("root"), "p")
            labels = materialize(labels.join(moved, "root", "left").select("node", F.coalesce("p", "root").alias("root")))
        of_a, of_b = up.select(F.col("u").alias("a"), F.col("p").alias("pa")), up.select(F.col("u").alias("b"), F.col("p").alias("pb"))
        links = materialize(links.join(of_a, "a").join(of_b, "b").select(F.col("pa").alias("a"), F.col("pb").alias("b")).where("a <> b").distinct())
    if labels is None:
        labels = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels
