"""Distributed order statistics and drift against brute force (NumPy) on small fixtures."""

import numpy as np
from pyspark.sql import functions as F

from keepwell.operators import drift
from keepwell.operators.ordered import cumulative, grouped_quantiles


def test_cumulative_matches_pandas(spark):
    rng = np.random.default_rng(1)
    rows = [(str(g), float(v), int(c)) for g, v, c in zip(rng.integers(0, 3, 300), rng.normal(size=300), rng.integers(1, 5, 300))]
    df = spark.createDataFrame(rows, "g string, v double, c long").groupBy("g", "v").agg(F.sum("c").alias("c"))
    got = {(r["g"], r["v"]): r["cum_c"] for r in cumulative(df, ["g"], "v", ["c"], num_partitions=7).collect()}
    pdf = df.toPandas().sort_values(["g", "v"])
    pdf["cum"] = pdf.groupby("g")["c"].cumsum()
    for g, v, cum in pdf[["g", "v", "cum"]].itertuples(index=False):
        assert got[(g, v)] == cum


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(2)
    vals = np.concatenate([rng.integers(0, 20, 500).astype(float), rng.normal(size=200)])
    df = spark.createDataFrame([(float(x),) for x in vals], "value double").withColumn("f", F.lit("x"))
    qs = [i / 10 for i in range(11)]
    got = sorted((r["q_index"], r["quantile"]) for r in grouped_quantiles(df, ["f"], "value", qs).collect())
    want = np.percentile(vals, [q * 100 for q in qs])
    assert np.allclose([g for _, g in got], want, rtol=0, atol=1e-12)


def _numpy_psi(ref, prod):
    bp = np.unique(np.percentile(ref, np.linspace(0, 100, 11)))
    if len(bp) < 2:
        return 0.0
    r = np.clip(np.histogram(ref, bins=bp)[0] / len(ref), 1e-6, None)
    p = np.clip(np.histogram(prod, bins=bp)[0] / len(prod), 1e-6, None)
    return round(float(np.sum((p - r) * np.log(p / r))), 4)


def _numpy_ks(ref, prod):
    allv = np.sort(np.concatenate([ref, prod]))
    cdf1 = np.searchsorted(np.sort(ref), allv, side="right") / len(ref)
    cdf2 = np.searchsorted(np.sort(prod), allv, side="right") / len(prod)
    return round(float(np.max(np.abs(cdf1 - cdf2))), 4)


def test_psi_and_ks_match_brute_force(spark):
    rng = np.random.default_rng(3)
    ref = np.round(rng.normal(5, 2, 900), 1)
    prod = np.round(rng.normal(5.6, 2.3, 400), 1)
    r = spark.createDataFrame([(float(x),) for x in ref], "a double")
    p = spark.createDataFrame([(float(x),) for x in prod], "a double")
    fd = drift.feature_drift(r, p, ["a"]).first()
    assert fd["psi"] == _numpy_psi(ref, prod)
    assert fd["ks_statistic"] == _numpy_ks(ref, prod)
    assert fd["drift_detected"] == (fd["psi"] >= 0.2 or fd["ks_pvalue"] < 0.05)


def test_drift_of_table_against_itself_is_zero(spark):
    df = spark.createDataFrame([(float(i % 17), float(i)) for i in range(200)], "a double, b double")
    fd = drift.feature_drift(df, df, ["a", "b"]).collect()
    assert all(r["psi"] == 0.0 and r["ks_statistic"] == 0.0 for r in fd)


def test_empty_side_gives_zero_psi(spark):
    ref = spark.createDataFrame([], "a double")
    prod = spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "a double")
    fd = drift.feature_drift(ref, prod, ["a"]).collect()
    assert [r["psi"] for r in fd] in ([], [0.0])


def test_psi_labels(spark):
    df = spark.createDataFrame([(0.05,), (0.15,), (0.25,)], "p double")
    got = [r[0] for r in df.select(drift.psi_label(F.col("p"))).collect()]
    assert [g.split(" ", 1)[1] for g in got] == ["No Drift", "Minor Drift", "Major Drift"]


def test_quality_flags_nulls_and_values_out_of_range(spark):
    kind = "same double, nulls double, far double, gone double"
    ref = spark.createDataFrame([(float(i), float(i), float(i), float(i)) for i in range(20)], kind)
    prod = spark.createDataFrame([(float(i), None if i < 4 else float(i), 1000.0 if i < 2 else float(i), None) for i in range(20)], kind)
    got = {r["feature"]: r for r in drift.data_quality(ref, prod, ["same", "nulls", "far", "gone"]).collect()}
    assert {f: r["quality_ok"] for f, r in got.items()} == {"same": True, "nulls": False, "far": False, "gone": False}
    assert got["nulls"]["null_increase"] == 0.2
    assert got["far"]["out_of_range_pct"] == 0.1
    assert got["gone"]["out_of_range_pct"] == 1.0


def test_monitored_batches_hold_all_customers_and_drift_in_part(spark):
    from keepwell.plans.batch import Stages
    from keepwell.plans.monitoring import batches

    from sf_dirs import SF_SMALL

    ref, prod = batches(Stages(spark, SF_SMALL))
    assert ref.count() == prod.count() == spark.read.parquet(f"{SF_SMALL}/customer.parquet").count()
    psi = {r["feature"]: r["psi"] for r in drift.psi_table(drift.both_sides(ref, prod, ["tenure_months", "sessions_30d", "api_usage"])).collect()}
    assert psi["tenure_months"] == 0.0
    assert psi["api_usage"] >= 0.25


def _paths_pvalue(a, b):
    """The share of all orders of the two samples whose ECDFs come as far apart as these."""
    from itertools import combinations

    n, m = len(a), len(b)
    steps = max(abs(sum(x <= v for x in a) * m - sum(x <= v for x in b) * n) for v in (*a, *b))
    far = total = 0
    for first in combinations(range(n + m), n):
        i = reach = 0
        for k in range(n + m):
            i += k in first
            reach = max(reach, abs(i * m - (k + 1 - i) * n))
        total += 1
        far += reach >= steps
    return far / total


def test_exact_pvalue_equals_all_paths(spark):
    rng = np.random.default_rng(4)
    for n, m in ((5, 5), (5, 7), (6, 8), (7, 6), (5, 9)):
        for spread in (3, 6, 50):
            a, b = rng.integers(0, spread, n).tolist(), rng.integers(0, spread, m).tolist()
            both = spark.createDataFrame([("ref", "x", float(v)) for v in a] + [("prod", "x", float(v)) for v in b], "side string, feature string, value double")
            steps = max(abs(sum(x <= v for x in a) * m - sum(x <= v for x in b) * n) for v in (*a, *b))
            assert abs(drift.exact_ks_pvalue(n, m, steps) - _paths_pvalue(a, b)) < 1e-12
            if spread == 6:
                assert drift.ks_table(both, exact=True).first().ks_pvalue == round(_paths_pvalue(a, b), 4)


def test_exact_pvalue_of_large_sides_is_near_the_asymptotic_one(spark, monkeypatch):
    # 4 dp of the asymptotic form for 2,000 and 3,000 rows
    assert abs(drift.exact_ks_pvalue(2000, 3000, int(0.04 * 6_000_000)) - 0.0432) < 0.002
    assert drift.exact_ks_pvalue(4000, 4000, 4000 * 4000) == 0.0 and drift.exact_ks_pvalue(3000, 3000, 0) == 1.0
    monkeypatch.setattr(drift, "KS_EXACT_ROWS", 5)
    rows = [("ref", "x", float(k)) for k in range(8)] + [("prod", "x", float(k) + 2) for k in range(8)]
    long = spark.createDataFrame(rows, "side string, feature string, value double")
    assert drift.ks_table(long, exact=True).first() == drift.ks_table(long).first()
