"""Distributed order statistics: running totals within groups, exact quantiles.

A window ``PARTITION BY g ORDER BY x`` puts a whole group into one task; with
one hot group (a feature column, an archetype holding a third of the rows)
that task holds a third of the data.  Instead:

1. pre-aggregate to distinct ``(group, key)`` rows with their measures, so a
   hot *value* becomes one row;
2. range-partition on ``(group, key)`` so a hot *group* spreads over many
   parts, and keep each row's part;
3. a window inside each (part, group) gives running sums of bounded stretches;
4. the per-(part, group) totals form a small table; their prefix sums (a
   window over at most #parts rows per group) are the offsets that are added.

Step 2's output is checkpointed (reliable, into ``spark.checkpoint.dir``) so
that the parts are not dealt anew when an executor is lost.  Everything runs
inside the JVM; sums keep the measures' own type, so counts stay exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def cumulative(
    df: DataFrame,
    group_cols: list[str],
    order_col: str,
    measures: list[str],
    descending: bool = False,
    num_partitions: int | None = None,
) -> DataFrame:
    """Inclusive running sums ``cum_<m>`` of ``measures`` within each group ordered by ``order_col``.

    ``df`` must hold one row per ``(group, order_col)`` (pre-aggregate first).
    """
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = F.col(order_col).desc_nulls_last() if descending else F.col(order_col).asc_nulls_first()
    base = df.select(*group_cols, order_col, *measures)
    dealt = base.repartitionByRange(n, *[F.col(g).asc_nulls_first() for g in group_cols], order)
    dealt = materialize(dealt.withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy("_part", *group_cols).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = dealt.withColumns({f"_cum_{m}": F.sum(m).over(inside) for m in measures})

    totals = dealt.groupBy("_part", *group_cols).agg(*[F.sum(m).alias(f"_tot_{m}") for m in measures])
    before = Window.partitionBy(*group_cols).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    keys = [F.col(g).alias(f"_of_{g}") for g in group_cols]
    offsets = totals.select(
        F.col("_part").alias("_of_part"), *keys, *[F.sum(f"_tot_{m}").over(before).alias(f"_off_{m}") for m in measures]
    )
    same = F.col("_part") == F.col("_of_part")
    for g in group_cols:
        same = same & F.col(g).eqNullSafe(F.col(f"_of_{g}"))
    return local.join(offsets, same, "left").select(
        *group_cols,
        order_col,
        *measures,
        *[(F.col(f"_cum_{m}") + F.coalesce(F.col(f"_off_{m}"), F.lit(0))).alias(f"cum_{m}") for m in measures],
    )


def grouped_quantiles(df: DataFrame, group_cols: list[str], value_col: str, qs: list[float]) -> DataFrame:
    """Exact linear-interpolation quantiles (``lo + (hi - lo) * frac``) per group.

    Returns ``(*group_cols, q_index, q, quantile)``.  Nulls are ignored.
    """
    vals = df.select(*group_cols, F.col(value_col).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    counts = vals.groupBy(*group_cols, "_v").agg(F.count(F.lit(1)).alias("cnt"))
    return quantiles_of(cumulative(counts, group_cols, "_v", ["cnt"]), group_cols, "_v", "cnt", qs)


def quantiles_of(cum: DataFrame, group_cols: list[str], value_col: str, count_col: str, qs: list[float]) -> DataFrame:
    """``grouped_quantiles`` from the running totals of counts that ``cumulative`` gives; values with a count of 0 play no part."""
    cum = cum.select(*group_cols, F.col(value_col).alias("_v"), F.col(count_col).alias("cnt"), F.col(f"cum_{count_col}").alias("cum_cnt"))
    sizes = cum.groupBy(*group_cols).agg(F.sum("cnt").alias("_n"))
    # target positions per group: a bounded array (2 per quantile)
    targets = sizes.select(
        *group_cols,
        F.array(
            *[
                F.struct(
                    F.lit(i).alias("qi"),
                    F.lit(float(q)).alias("q"),
                    ((F.col("_n") - 1) * F.lit(float(q))).alias("pos"),
                )
                for i, q in enumerate(qs)
            ]
        ).alias("_t"),
    )
    j = cum.join(targets, group_cols, "inner") if group_cols else cum.crossJoin(targets)
    start = F.col("cum_cnt") - F.col("cnt")
    end = F.col("cum_cnt") - 1
    hits = j.select(
        *group_cols,
        "_v",
        F.filter(
            F.transform(
                F.col("_t"),
                lambda t: F.struct(
                    t["qi"].alias("qi"),
                    t["q"].alias("q"),
                    t["pos"].alias("pos"),
                    ((F.floor(t["pos"]) >= start) & (F.floor(t["pos"]) <= end)).alias("is_lo"),
                    ((F.ceil(t["pos"]) >= start) & (F.ceil(t["pos"]) <= end)).alias("is_hi"),
                ),
            ),
            lambda t: t["is_lo"] | t["is_hi"],
        ).alias("_m"),
    ).filter(F.size("_m") > 0)
    e = hits.select(*group_cols, "_v", F.explode("_m").alias("m")).select(*group_cols, "_v", "m.*")
    agg = e.groupBy(*group_cols, "qi", "q", "pos").agg(
        F.max(F.when(F.col("is_lo"), F.col("_v"))).alias("lo"),
        F.max(F.when(F.col("is_hi"), F.col("_v"))).alias("hi"),
    )
    frac = F.col("pos") - F.floor(F.col("pos"))
    return agg.select(
        *group_cols,
        F.col("qi").alias("q_index"),
        "q",
        (F.col("lo") + (F.col("hi") - F.col("lo")) * frac).alias("quantile"),
    )


def grouped_quantile(df: DataFrame, group_cols: list[str], value_col: str, q: float, out: str) -> DataFrame:
    r = grouped_quantiles(df, group_cols, value_col, [q])
    return r.select(*group_cols, F.col("quantile").alias(out))
