"""Drift and data-quality monitoring.

Both batches are unpivoted ONCE into a long ``(side, feature, value)`` form
and counted ONCE per ``(feature, value)`` and side.  Everything is read from
these counts and their running totals (``ordered.cumulative``), so every
feature is handled by the same few jobs (no per-feature loop):

* column profile (F33): weighted aggregates per feature and side;
* PSI (J1): reference deciles from the running totals, de-duplicated edges,
  bin index by counting edges ``<= x`` in-row, counts per ``(feature, bin)``,
  all bins generated from the (feature-count-bounded) edge table;
* KS (J3): ``max |diff|`` of the two ECDFs, which are the running totals;
  p-value (J4) by an in-row 100-term asymptotic series, or exact by counting
  lattice paths.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .ordered import cumulative, quantiles_of

# ---- fixed values: drift thresholds and labels ----
PSI_NO_DRIFT = 0.10
PSI_MINOR_DRIFT = 0.20
KS_ALPHA = 0.05
PSI_LABELS = ("✅ No Drift", "⚠️ Minor Drift", "🚨 Major Drift")
STATUS_RETRAIN = "🚨 RETRAIN REQUIRED"
STATUS_MONITOR = "⚠️ MONITOR CLOSELY"
STATUS_HEALTHY = "✅ HEALTHY"
DECILES = [i / 10 for i in range(11)]
SHARE_FLOOR = 1e-6
KS_TERMS = 100
#: Sides of up to so many rows get the exact p-value, where it is asked for.
KS_EXACT_ROWS = 10_000


def psi_label(psi: Column) -> Column:
    return F.when(psi < PSI_NO_DRIFT, PSI_LABELS[0]).when(psi < PSI_MINOR_DRIFT, PSI_LABELS[1]).otherwise(PSI_LABELS[2])


def long_form(df: DataFrame, features: list[str], side: str) -> DataFrame:
    """Unpivot the feature columns present in ``df`` to (side, feature, value); bad text -> null."""
    present = [f for f in features if f in df.columns]
    if not present:
        return df.sparkSession.createDataFrame([], "side string, feature string, value double")
    cast = df.select(*[F.col(f).try_cast("double").alias(f) for f in present])
    cast = cast.select(*[F.when(~F.isnan(F.col(f)), F.col(f)).alias(f) for f in present])
    return cast.unpivot([], present, "feature", "value").select(F.lit(side).alias("side"), "feature", "value")


def both_sides(ref: DataFrame, prod: DataFrame, features: list[str]) -> DataFrame:
    """Features present on both sides only."""
    common = [f for f in features if f in ref.columns and f in prod.columns]
    return long_form(ref, common, "ref").unionByName(long_form(prod, common, "prod"))


def column_profile(long: DataFrame) -> DataFrame:
    """rows, non-null count, mean, sample std, min, max, null share per (side, feature)."""
    return long.groupBy("side", "feature").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("value").alias("n"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        (1 - F.count("value") / F.count(F.lit(1))).alias("null_pct"),
    )


@dataclass(frozen=True)
class Counted:
    """Both batches as (feature, value, c_ref, c_prod), a null value too; its running totals; the values of each side."""

    counts: DataFrame
    totals: DataFrame
    sizes: DataFrame


def counted(long: DataFrame) -> Counted:
    ref = F.col("side") == "ref"
    counts = materialize(long.groupBy("feature", "value").agg(F.count_if(ref).alias("c_ref"), F.count_if(~ref).alias("c_prod")))
    there = counts.filter(F.col("value").isNotNull())
    # every feature, also one without a value on either side
    known = lambda c: F.sum(F.when(F.col("value").isNotNull(), F.col(c)).otherwise(0))
    sizes = counts.groupBy("feature").agg(known("c_ref").alias("n_ref"), known("c_prod").alias("n_prod"))
    return Counted(counts, cumulative(there, ["feature"], "value", ["c_ref", "c_prod"]), sizes)


def profile_of(both: Counted) -> DataFrame:
    """F33 from the counts; the deviations are taken from the mean, so that large values do not cancel."""
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"c_{s}").alias("c")) for s in ("ref", "prod")])
    long = both.counts.select("feature", "value", F.inline(sides)).filter(F.col("c") > 0)
    there, v, c = F.col("value").isNotNull(), F.col("value"), F.col("c")
    first = long.groupBy("side", "feature").agg(
        F.sum("c").alias("rows"), F.coalesce(F.sum(F.when(there, c)), F.lit(0)).alias("n"), F.sum(v * c).alias("total"),
        F.min(v).alias("min"), F.max(v).alias("max"),
    ).withColumn("mean", F.when(F.col("n") > 0, F.col("total") / F.col("n")))
    # two rows per feature
    means = F.broadcast(first.select("side", "feature", "mean"))
    spread = long.filter(there).join(means, ["side", "feature"]).groupBy("side", "feature").agg(F.sum(c * (v - F.col("mean")) * (v - F.col("mean"))).alias("ss"))
    return first.join(spread, ["side", "feature"], "left").select(
        "side", "feature", "rows", "n", "mean", F.when(F.col("n") > 1, F.sqrt(F.col("ss") / (F.col("n") - 1))).alias("std"), "min", "max",
        (1 - F.col("n") / F.col("rows")).alias("null_pct"),
    )


def psi_table(long: DataFrame | Counted) -> DataFrame:
    """PSI per feature (4 dp) from reference deciles."""
    both = long if isinstance(long, Counted) else counted(long)
    vals, sizes = both.counts.filter(F.col("value").isNotNull()), both.sizes
    q = quantiles_of(both.totals, ["feature"], "value", "c_ref", DECILES)
    # one row per feature: bounded by the number of features
    edges = q.groupBy("feature").agg(
        F.array_distinct(F.array_sort(F.collect_list("quantile"))).alias("edges")
    )
    e = edges.join(sizes, "feature", "right")
    nb = F.size("edges") - 1
    idx = F.aggregate("edges", F.lit(0), lambda acc, x: acc + F.when(x <= F.col("value"), 1).otherwise(0)) - 1
    binned = vals.join(F.broadcast(edges), "feature").select(
        "feature",
        "c_ref",
        "c_prod",
        F.when(F.col("value") == F.element_at("edges", -1), nb - 1).otherwise(idx).alias("bin"),
        nb.alias("nb"),
    )
    counts = (
        binned.filter((F.col("bin") >= 0) & (F.col("bin") < F.col("nb")))
        .groupBy("feature", "bin")
        .agg(F.sum("c_ref").alias("c_ref"), F.sum("c_prod").alias("c_prod"))
    )
    all_bins = e.filter(F.col("edges").isNotNull() & (F.size("edges") >= 2)).select(
        "feature", "n_ref", "n_prod", F.explode(F.sequence(F.lit(0), F.size("edges") - 2)).alias("bin")
    )
    j = all_bins.join(counts, ["feature", "bin"], "left")
    r = F.greatest(F.coalesce(F.col("c_ref"), F.lit(0)) / F.col("n_ref"), F.lit(SHARE_FLOOR))
    p = F.greatest(F.coalesce(F.col("c_prod"), F.lit(0)) / F.col("n_prod"), F.lit(SHARE_FLOOR))
    terms = j.filter((F.col("n_ref") > 0) & (F.col("n_prod") > 0)).select("feature", ((p - r) * F.log(p / r)).alias("t"))
    psi = terms.groupBy("feature").agg(F.round(F.sum("t"), 4).alias("psi"))
    return sizes.select("feature").join(psi, "feature", "left").select(
        "feature", F.coalesce(F.col("psi"), F.lit(0.0)).alias("psi")
    )


def ks_pvalue(d: Column, n: Column, m: Column) -> Column:
    """Asymptotic two-sample Kolmogorov p-value."""
    en = n * m / (n + m)
    lam = (F.sqrt(en) + 0.12 + 0.11 / F.sqrt(en)) * d
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(KS_TERMS)),
        F.lit(0.0),
        lambda acc, k: acc
        + F.when(k % 2 == 1, F.lit(1.0)).otherwise(F.lit(-1.0)) * F.exp(-2.0 * k * k * lam * lam),
    )
    return F.when(d <= 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2.0 * series)))


def exact_ks_pvalue(n: int, m: int, steps: int) -> float:
    """P(D >= steps / (n m)) for samples of n and m rows: the share of lattice paths that reach so far from the diagonal.

    Paths from (0, 0) to (n, m) that stay inside are counted as a share of all
    paths to each point, one anti-diagonal after the other, so that no number
    grows.
    """
    import numpy as np

    if steps <= 0:
        return 1.0
    inside = np.zeros(n + 1)
    inside[0] = 1.0
    for k in range(1, n + m + 1):
        # i steps of the first sample, k - i of the second: |i m - (k - i) n| < steps
        low = max(0, k - m, (k * n - steps) // (n + m) + 1)
        high = min(n, k, -((-(k * n + steps)) // (n + m)) - 1)
        if low > high:
            return 1.0
        i = np.arange(low, high + 1)
        came = np.where(i > 0, inside[i - 1], 0.0) * i / k + inside[i] * (k - i) / k
        inside[:] = 0.0
        inside[low : high + 1] = came
    return float(min(1.0, max(0.0, 1.0 - inside[n])))


def _with_exact(rows: DataFrame) -> DataFrame:
    """``rows`` (a row per feature) with ``exact``, null where a side has more than KS_EXACT_ROWS rows or fewer than 5."""

    def run(batches: Iterator) -> Iterator:
        for pdf in batches:
            fits = (pdf["n_ref"] >= 5) & (pdf["n_prod"] >= 5) & (pdf[["n_ref", "n_prod"]].max(axis=1) <= KS_EXACT_ROWS)
            pdf["exact"] = [
                exact_ks_pvalue(int(n), int(m), int(s)) if ok else None
                for n, m, s, ok in zip(pdf["n_ref"], pdf["n_prod"], pdf["steps"].fillna(0), fits)
            ]
            yield pdf

    # each feature is a count of up to n times m steps of its own
    return rows.repartition("feature").mapInPandas(run, rows.schema.add("exact", "double"))


def ks_table(long: DataFrame | Counted, exact: bool = False) -> DataFrame:
    """J3 + J4: KS statistic and p-value per feature (4 dp); fewer than 5 on a side -> (0, 1).

    With ``exact`` the p-value of sides of at most KS_EXACT_ROWS rows is that
    of all lattice paths; else, and beyond, it is the asymptotic one.
    """
    both = long if isinstance(long, Counted) else counted(long)
    sizes = both.sizes
    r, p = F.col("cum_c_ref"), F.col("cum_c_prod")
    diff = both.totals.join(sizes, "feature").select(
        "feature",
        F.abs(r / F.col("n_ref") - p / F.col("n_prod")).alias("gap"),
        F.abs(r * F.col("n_prod") - p * F.col("n_ref")).alias("step"),
    )
    d = sizes.join(diff.groupBy("feature").agg(F.max("gap").alias("d"), F.max("step").alias("steps")), "feature", "left")
    small = (F.col("n_ref") < 5) | (F.col("n_prod") < 5)
    value = ks_pvalue(F.col("d"), F.col("n_ref"), F.col("n_prod"))
    if exact:
        d, value = _with_exact(d), F.coalesce(F.col("exact"), value)
    return d.select(
        "feature",
        F.when(small, F.lit(0.0)).otherwise(F.round(F.col("d"), 4)).alias("ks_statistic"),
        F.when(small, F.lit(1.0)).otherwise(F.round(value, 4)).alias("ks_pvalue"),
    )


def feature_drift(ref: DataFrame, prod: DataFrame, features: list[str], both: Counted | None = None) -> DataFrame:
    """Per feature psi, label, ks, p, means, stds (4 dp), drift flag; by psi desc."""
    both = both or counted(both_sides(ref, prod, features))
    prof = profile_of(both)
    pr = prof.filter(F.col("side") == "ref").select(
        "feature", F.col("mean").alias("rm"), F.col("std").alias("rs")
    )
    pp = prof.filter(F.col("side") == "prod").select(
        "feature", F.col("mean").alias("pm"), F.col("std").alias("ps")
    )
    j = psi_table(both).join(ks_table(both), "feature").join(pr, "feature").join(pp, "feature")
    return j.select(
        "feature",
        "psi",
        psi_label(F.col("psi")).alias("psi_label"),
        "ks_statistic",
        "ks_pvalue",
        F.round("rm", 4).alias("ref_mean"),
        F.round("pm", 4).alias("prod_mean"),
        F.round("rs", 4).alias("ref_std"),
        F.round("ps", 4).alias("prod_std"),
        ((F.col("psi") >= PSI_MINOR_DRIFT) | (F.col("ks_pvalue") < KS_ALPHA)).alias("drift_detected"),
    )


def prediction_drift(ref_scores: DataFrame, prod_scores: DataFrame, col: str = "churn_probability") -> DataFrame:
    """J1 + J3 on score vectors; drift = psi >= .20 only."""
    long = long_form(ref_scores, [col], "ref").unionByName(long_form(prod_scores, [col], "prod"))
    both = counted(long)
    mean = lambda c: F.round(F.sum(F.col("value") * F.col(c)) / F.sum(F.when(F.col("value").isNotNull(), F.col(c))), 4)
    means = both.counts.agg(mean("c_ref").alias("ref_mean_score"), mean("c_prod").alias("prod_mean_score"))
    j = psi_table(both).join(ks_table(both), "feature")
    return j.select(
        means.select("ref_mean_score").scalar().alias("ref_mean_score"),
        means.select("prod_mean_score").scalar().alias("prod_mean_score"),
        "psi",
        psi_label(F.col("psi")).alias("psi_label"),
        "ks_statistic",
        "ks_pvalue",
        (F.col("psi") >= PSI_MINOR_DRIFT).alias("drift_detected"),
    )


def data_quality(ref: DataFrame, prod: DataFrame, features: list[str], both: Counted | None = None) -> DataFrame:
    """Null shares, ranges, out-of-range share (ref min/max -/+ 3 sample std), quality flag."""
    both = both or counted(both_sides(ref, prod, features))
    prof = profile_of(both)
    r = prof.filter(F.col("side") == "ref").select(
        "feature",
        F.col("null_pct").alias("r_null"),
        F.col("min").alias("r_min"),
        F.col("max").alias("r_max"),
        F.col("std").alias("r_std"),
    )
    p = prof.filter(F.col("side") == "prod").select(
        "feature", F.col("null_pct").alias("p_null"), F.col("min").alias("p_min"), F.col("max").alias("p_max"),
        F.col("n").alias("p_n"),
    )
    # ref stats per feature: bounded by the number of features
    rs = F.broadcast(r.select("feature", "r_min", "r_max", "r_std"))
    prod_vals = both.counts.filter((F.col("c_prod") > 0) & F.col("value").isNotNull()).join(rs, "feature")
    lo = F.col("r_min") - 3 * F.col("r_std")
    hi = F.col("r_max") + 3 * F.col("r_std")
    oor = prod_vals.groupBy("feature").agg(
        (F.sum(F.when((F.col("value") < lo) | (F.col("value") > hi), F.col("c_prod")).otherwise(0)) / F.sum("c_prod")).alias("oor")
    )
    j = r.join(p, "feature").join(oor, "feature", "left")
    out_pct = F.when(F.col("p_n") > 0, F.col("oor")).otherwise(F.lit(1.0))
    inc = F.col("p_null") - F.col("r_null")
    return j.select(
        "feature",
        F.round("r_null", 4).alias("ref_null_pct"),
        F.round("p_null", 4).alias("prod_null_pct"),
        F.round(inc, 4).alias("null_increase"),
        F.round("r_min", 4).alias("ref_min"),
        F.round("r_max", 4).alias("ref_max"),
        F.round("p_min", 4).alias("prod_min"),
        F.round("p_max", 4).alias("prod_max"),
        F.round(out_pct, 4).alias("out_of_range_pct"),
        ((inc < 0.10) & (out_pct < 0.05)).alias("quality_ok"),
    )


def overall_status(fdrift: DataFrame, quality: DataFrame, pdrift: DataFrame | None = None) -> DataFrame:
    """One row with counts, status and recommendation."""
    a = fdrift.agg(
        F.count_if(F.col("psi") >= PSI_MINOR_DRIFT).alias("n_major"),
        F.count_if(F.col("drift_detected")).alias("n_drifted"),
    )
    # the other inputs are one-row aggregates: attach them as scalar subqueries
    s = a.withColumn("quality_fails", quality.select(F.count_if(~F.col("quality_ok"))).scalar())
    if pdrift is not None:
        s = s.withColumn("prediction_drift", pdrift.select(F.bool_or("drift_detected")).scalar())
    else:
        s = s.withColumn("prediction_drift", F.lit(False))
    retrain = (F.col("n_major") >= 5) | F.coalesce(F.col("prediction_drift"), F.lit(False))
    monitor = (F.col("n_major") >= 2) | (F.col("quality_fails") >= 3)
    status = F.when(retrain, STATUS_RETRAIN).when(monitor, STATUS_MONITOR).otherwise(STATUS_HEALTHY)
    rec = (
        F.when(
            retrain,
            F.format_string("%d features show major drift. Trigger model retraining pipeline immediately.", F.col("n_major")),
        )
        .when(
            monitor,
            F.format_string(
                "%d features drifting, %d quality issues. Schedule retraining within 2 weeks.",
                F.col("n_major"),
                F.col("quality_fails"),
            ),
        )
        .otherwise("Model performing within expected parameters. Next review in 30 days.")
    )
    return s.select("n_major", "n_drifted", "quality_fails", "prediction_drift", status.alias("overall_status"), rec.alias("recommendation"))


def drift_report(fdrift: DataFrame) -> DataFrame:
    """8 columns, by psi desc (ties by feature)."""
    return fdrift.select(
        "feature",
        "psi",
        F.col("psi_label").alias("status"),
        F.col("ks_statistic").alias("ks_stat"),
        F.col("ks_pvalue").alias("ks_pval"),
        "ref_mean",
        "prod_mean",
        F.col("drift_detected").alias("drift"),
    ).orderBy(F.desc("psi"), "feature")


def run_monitoring(ref: DataFrame, prod: DataFrame, features: list[str], ref_scores=None, prod_scores=None):
    """Feature drift, prediction drift, quality, status and row counts; the batches are counted once."""
    both = counted(both_sides(ref, prod, features))
    fd = feature_drift(ref, prod, features, both)
    dq = data_quality(ref, prod, features, both)
    pdr = prediction_drift(ref_scores, prod_scores) if ref_scores is not None and prod_scores is not None else None
    status = overall_status(fd, dq, pdr)
    summary = status.withColumns(
        {
            "n_reference": ref.select(F.count(F.lit(1))).scalar(),
            "n_production": prod.select(F.count(F.lit(1))).scalar(),
            "run_ts": F.current_timestamp(),
        }
    )
    drifted = fd.filter("drift_detected").select("feature")
    return {"feature_drift": fd, "prediction_drift": pdr, "data_quality": dq, "summary": summary, "drifted": drifted}
