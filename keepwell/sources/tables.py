"""Parquet table access for the driver's TPC-H-like test tables.

Only ``spark.read.parquet`` is used: Catalyst prunes columns and pushes
filters into the scan, so callers just ``select`` what they need.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

DEFAULT_SF_DIR = "/root/testdata/sf0.01"

TABLE_NAMES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


# ---- fixed values: schemas of the test tables (explicit, so no footer inference per read) ----
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate {ts}, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate {ts}",
    "events": "event_id bigint, ts {ts}, user_id bigint, event_type string, value double, props string",
}


class Tables:
    """Lazy accessor: ``t = Tables(spark, sf_dir); t.orders``."""

    def __init__(self, spark: SparkSession, sf_dir: str = DEFAULT_SF_DIR):
        self.spark = spark
        self.sf_dir = sf_dir

    def path(self, name: str) -> str:
        return os.path.join(self.sf_dir, f"{name}.parquet")

    def read(self, name: str) -> DataFrame:
        ddl = SCHEMAS.get(name)
        if ddl is None:
            return self.spark.read.parquet(self.path(name))
        return self.spark.read.schema(ddl.format(ts=self._ts_type())).parquet(self.path(name))

    def _ts_type(self) -> str:
        # parquet timestamps without a UTC flag are read as timestamp_ntz when inference allows it
        v = self.spark.conf.get("spark.sql.parquet.inferTimestampNTZ.enabled", "true")
        return "timestamp_ntz" if str(v).lower() == "true" else "timestamp"

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLE_NAMES:
            return self.read(name)
        raise AttributeError(name)
