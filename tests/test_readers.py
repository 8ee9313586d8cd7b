"""Ranges of a key with equal rows, and the way of bad records."""

import random

from pyspark.sql import functions as F

from keepwell.sources import readers


def test_ranges_hold_equal_rows_and_every_row_once(spark):
    rng = random.Random(1)
    keys = [int(10 ** rng.uniform(0, 9)) for _ in range(5000)] + [None] * 7
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    predicates = readers.range_predicates("k", readers.equal_bounds(df, "k", 8))
    hits = df.select(*[F.expr(p).cast("int").alias(f"p{i}") for i, p in enumerate(predicates)])
    assert hits.filter(" + ".join(f"coalesce(p{i}, 0)" for i in range(len(predicates))) + " <> 1").count() == 0
    sizes = hits.agg(*[F.sum(f"p{i}") for i in range(len(predicates))]).first()
    assert len(predicates) == 8 and all(abs(n - 5000 / 8) < 60 for n in sizes)
    assert readers.range_predicates("k", readers.equal_bounds(df.filter("k is null"), "k", 8)) == ["1 = 1"]
    assert len(readers.range_predicates("k", readers.equal_bounds(df.select(F.lit(3).alias("k")), "k", 8))) == 1
    names = spark.createDataFrame([(x,) for x in ("a", "b'c", "d", "e")], "k string")
    bounds = ["b'c", "d"]
    assert [names.filter(p).count() for p in readers.range_predicates("k", bounds)] == [1, 1, 2]


def header():
    return [f.name for f in readers.CUSTOMER_SCHEMA.fields]


def row(customer, **over):
    values = {f.name: "1" for f in readers.CUSTOMER_SCHEMA.fields} | {"customer_id": customer, "subscription_type": "Starter", "country": "US", "industry": "x"} | over
    return ",".join(values[c] for c in header())


def test_broken_csv_lines_are_kept_apart(spark, tmp_path):
    lines = [",".join(header()), row("a"), row("b", tenure_months="three"), row(""), row("c") + ",more,fields", row("d", monthly_revenue=""), row("e").rsplit(",", 3)[0]]
    (tmp_path / "in.csv").write_text("\n".join(lines) + "\n")
    checked = readers.read_checked(spark, str(tmp_path / "in.csv"))
    assert {r.customer_id for r in checked.accepted.collect()} == {"a", "d"}
    assert {r.reason: r.records for r in checked.counts().collect()} == {"accepted": 2, "malformed": 3, "customer_id is missing": 1}
    assert row("b", tenure_months="three") in {r.record for r in checked.rejected.collect()}
    readers.write_checked(checked, str(tmp_path / "out"))
    assert readers.read_table(spark, str(tmp_path / "out/accepted")).count() == 2
    assert readers.read_table(spark, str(tmp_path / "out/rejected")).filter("reason = 'malformed'").count() == 3


def test_broken_json_lines_are_kept_apart(spark, tmp_path):
    lines = ['{"customer_id": "a", "ticket_count": 3}', '{"customer_id": "b", "ticket_count": "x"}', '{"customer_id"', '{"ticket_count": 1}', '{"customer_id": "  "}']
    (tmp_path / "in.json").write_text("\n".join(lines) + "\n")
    checked = readers.read_checked(spark, str(tmp_path / "in.json"), "json")
    assert [(r.customer_id, r.ticket_count) for r in checked.accepted.collect()] == [("a", 3)]
    assert {r.reason: r.records for r in checked.counts().collect()} == {"accepted": 1, "malformed": 2, "customer_id is missing": 2}


def test_stamped_runs_add_up(spark, tmp_path):
    path = str(tmp_path / "drift")
    for k in range(2):
        readers.write_stamped(spark.createDataFrame([(k,)], "x int"), path)
    back = readers.read_table(spark, path)
    assert back.count() == 2 and "run_ts" in back.columns and back.filter("run_ts is null").count() == 0
