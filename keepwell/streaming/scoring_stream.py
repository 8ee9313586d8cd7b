"""Streaming form of the per-record serving calls.

Features, score, archetypes, value and rules are stateless row-wise
``DataFrame -> DataFrame`` functions, so the same plan runs on
``readStream`` in append mode.  ``foreachBatch`` writes each micro-batch's
recommendations (idempotent per epoch: partitioned by ``batch_id`` and
overwritten), which survives restarts through the checkpoint location.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features, scoring
from ..plans.batch import decision_chain
from ..plans.serving import recommendation_record
from ..schema import CUSTOMER_SCHEMA_NO_LABEL


def score_stream(stream: DataFrame) -> DataFrame:
    """Row-wise scoring chain on a streaming frame of customer records (B13 -> B18 -> E8 -> E17 -> E14)."""
    f = features.engineer(stream)
    s = scoring.score_baseline(f).withColumn("churn_risk_level", scoring.risk_level())
    d = decision_chain(s.withColumn("primary_driver", F.lit("engagement_decay_score")))
    return recommendation_record(d).withColumn("churn_risk_level", scoring.risk_level(F.col("churn_probability")))


def read_customer_stream(spark: SparkSession, path: str, fmt: str = "json", max_files: int | None = None) -> DataFrame:
    r = spark.readStream.format(fmt).schema(CUSTOMER_SCHEMA_NO_LABEL)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.load(path)


def start(spark: SparkSession, source: str, sink: str, checkpoint: str, fmt: str = "json"):
    """Run the scoring stream into a Parquet sink via foreachBatch (one overwrite per epoch)."""

    def write(batch: DataFrame, batch_id: int) -> None:
        (batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(sink))

    q = (
        score_stream(read_customer_stream(spark, source, fmt))
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .start()
    )
    return q
