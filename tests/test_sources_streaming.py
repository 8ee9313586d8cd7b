"""Round trips through the sinks and sources, and the streaming form of scoring."""

import json
import os
import tempfile

from keepwell.plans.batch import Stages
from keepwell.sources import readers
from keepwell.streaming.scoring_stream import read_customer_stream, score_stream

from sf_dirs import SF_SMALL


def test_csv_and_sql_file_round_trip(spark):
    mart = Stages(spark, SF_SMALL).mart.drop("c_custkey")
    d = tempfile.mkdtemp(prefix="kw-src-")
    readers.write_table(mart, os.path.join(d, "c"), fmt="csv")
    back = readers.read_customers_csv(spark, os.path.join(d, "c"))
    assert back.count() == mart.count()
    back.createOrReplaceTempView("customer_features")
    assert readers.read_sql_file(spark).count() == mart.count()


def test_json_records_with_defaults(spark):
    d = tempfile.mkdtemp(prefix="kw-json-")
    with open(os.path.join(d, "r.json"), "w") as fh:
        fh.write(json.dumps({"customer_id": "X1", "sessions_30d": 1}) + "\n")
    r = readers.read_records_json(spark, d).first()
    assert r["customer_id"] == "X1" and r["sessions_30d"] == 1 and r["monthly_revenue"] == 199.0


def test_streaming_scoring_matches_batch(spark):
    d = tempfile.mkdtemp(prefix="kw-stream-")
    src = os.path.join(d, "in")
    mart = Stages(spark, SF_SMALL).mart.drop("c_custkey", "churned")
    mart.write.json(src)
    q = (score_stream(read_customer_stream(spark, src)).writeStream.format("memory").queryName("kw_scores")
         .outputMode("append").start())
    q.processAllAvailable()
    q.stop()
    got = spark.sql("SELECT count(*) AS n, count(DISTINCT customer_id) AS d FROM kw_scores").first()
    assert got["n"] == mart.count() == got["d"]
