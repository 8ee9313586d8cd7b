"""The executive report as a dataset of six tables that readers see as a whole.

Each report is a version: its tables are written under a folder of their own,
and a manifest row is appended when all of them are there.  Readers start from
the manifests, so a report that is half written, or whose writer died, does
not exist for them, and a version is never changed once it does.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import explain, reports
from .batch import Stages

TOP_COLUMNS = ["customer_id", "subscription_type", "monthly_revenue", "archetype_name", "churn_probability", "action", "expected_revenue_saved"]
MANIFEST = "version string, tables map<string,bigint>"


def report_tables(stages: Stages) -> dict[str, DataFrame]:
    """The tables of a report: KPIs, archetypes, urgencies, top customers, top features, actions."""
    decided = stages.decided
    return {
        "kpis": reports.report_kpis(decided),
        "archetypes": reports.report_archetypes(decided),
        "urgency": reports.urgency_share(decided),
        "top_customers": reports.top_by_saved(decided, 10).select(*TOP_COLUMNS),
        "importance": explain.global_importance(decided, background=stages.scored).limit(10),
        "actions": reports.action_summary(decided),
    }


def write_report(tables: dict[str, DataFrame], folder: str, version: str | None = None) -> str:
    """Write all tables, then the manifest that makes them a report; the version's name."""
    version = version or uuid.uuid4().hex
    spark, counts = SparkSession.active(), {}
    for name, table in tables.items():
        path = f"{folder}/versions/{version}/{name}"
        table.write.mode("errorifexists").parquet(path)
        counts[name] = spark.read.parquet(path).count()
    row = spark.createDataFrame([(version, counts)], MANIFEST).withColumn("written_at", F.current_timestamp())
    # One file, which the committer moves into place at the end.
    row.coalesce(1).write.mode("append").parquet(f"{folder}/manifests")
    return version


def report_versions(spark: SparkSession, folder: str) -> DataFrame:
    """The manifests, latest first."""
    return spark.read.parquet(f"{folder}/manifests").orderBy(F.desc("written_at"), F.desc("version"))


def read_report(spark: SparkSession, folder: str, version: str | None = None) -> dict[str, DataFrame]:
    """The tables of a version, or of the latest one."""
    known = report_versions(spark, folder)
    found = (known.filter(F.col("version") == version) if version else known).first()
    if found is None:
        raise LookupError(f"no report {version or ''} in {folder}")
    return {name: spark.read.parquet(f"{folder}/versions/{found['version']}/{name}") for name in found["tables"]}
