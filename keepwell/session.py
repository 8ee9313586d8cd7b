"""Session helpers.

``get_session`` builds a local session for tests and the bench; on a cluster
the caller passes its own session and nothing here overrides cluster settings.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

LOCAL_CONF = {
    "spark.ui.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.driver.memory": "16g",
}


def get_session(master: str | None = None, shuffle_partitions: int = 8, app: str = "keepwell") -> SparkSession:
    master = master or os.environ.get("KEEPWELL_MASTER", "local[8]")
    b = SparkSession.builder.master(master).appName(app)
    for k, v in LOCAL_CONF.items():
        b = b.config(k, v)
    b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """The shared checkpoint folder, made known to the context.

    A folder that the context already has stays.  Otherwise the session's
    ``spark.checkpoint.dir`` is used, then ``fallback``.  With none of them a
    local session (one machine, as in tests) gets a fresh temporary folder; a
    cluster session gets an error, since its machines share no local folder.
    The configuration key itself is never written.
    """
    sc = spark.sparkContext
    have = sc.getCheckpointDir()
    if have:
        return have
    d = spark.conf.get("spark.checkpoint.dir", None) or fallback
    if not d:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="keepwell-checkpoints-")
    sc.setCheckpointDir(d)
    return d


def written(df):
    """``df`` written as a Parquet table in the shared checkpoint folder and read back.

    For large intermediate results: compressed and column-wise, where
    ``materialize`` keeps whole rows.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/written-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize(df):
    """Cut lineage with a reliable checkpoint in the cluster's checkpoint folder.

    Used where a result is read more than once or ends an iteration: a lost
    executor recomputes at most one stage.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
