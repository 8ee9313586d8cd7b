"""Sources and sinks (A1-A16) with explicit schemas.

Every reader applies a fixed ``StructType`` (no inference) and validates the
required columns at plan time.  Records that do not parse, or lack what a
customer must have, are told apart from the others and kept with their text
and the reason.  The JDBC source reads ranges of a key that hold equal numbers
of rows; the SQL-file source runs against registered views.  Sinks are plain
``DataFrameWriter`` calls (Parquet by default).
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import CUSTOMER_FIELDS, CUSTOMER_SCHEMA, CUSTOMER_SCHEMA_NO_LABEL, validate_schema
from ..session import written

DEFAULT_QUERY_PATH = os.path.join(os.path.dirname(__file__), "..", "config", "customer_query.sql")

# ---- fixed values: per-field defaults of a single customer record ----
RECORD_DEFAULTS = {
    "customer_id": "CUST-000001", "subscription_type": "Professional", "monthly_revenue": 199.0, "tenure_months": 14,
    "country": "US", "industry": "SaaS", "sessions_30d": 8, "sessions_90d": 35, "days_since_last_login": 10,
    "days_since_last_core_action": 12, "login_frequency_change": -0.3, "session_duration_change": -0.15,
    "ticket_count": 4, "support_sentiment": -0.4, "error_rate": 0.12, "failed_api_calls": 5, "rage_click_count": 2,
    "billing_page_visits": 3, "downgrade_page_visits": 2, "invoice_download_frequency": 2, "trial_expiry_days": -1,
    "tier_capacity_utilization": 0.55, "export_frequency": 4, "api_usage": 1200, "api_limit_usage": 0.12,
    "seat_limit_usage": 0.40,
}


def read_customers_csv(spark: SparkSession, path: str, require_label: bool = True) -> DataFrame:
    """A1: customer CSV with header, fixed schema."""
    schema = CUSTOMER_SCHEMA if require_label else CUSTOMER_SCHEMA_NO_LABEL
    df = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)
    return validate_schema(df, require_label)


def read_table(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A2: previously written outputs (Parquet or CSV with header)."""
    if fmt == "csv":
        return spark.read.option("header", True).option("inferSchema", False).csv(path)
    return spark.read.format(fmt).load(path)


def read_jdbc(spark: SparkSession, url: str, query: str, partition_column: str | None = None, lower: int = 0,
              upper: int = 0, num_partitions: int = 1, properties: dict | None = None,
              require_label: bool = True) -> DataFrame:
    """A3: run a SELECT over JDBC, partitioned on a numeric column when given; validated."""
    r = spark.read.format("jdbc").option("url", url)
    for k, v in (properties or {}).items():
        r = r.option(k, v)
    if partition_column:
        r = (r.option("dbtable", f"({query}) q").option("partitionColumn", partition_column)
             .option("lowerBound", lower).option("upperBound", upper).option("numPartitions", num_partitions))
    else:
        r = r.option("query", query)
    return validate_schema(r.load(), require_label)


def equal_bounds(keys: DataFrame, column: str, n: int) -> list:
    """At most n - 1 increasing values of ``column`` that part its rows into ranges of nearly equal size.

    From the keys as they are, so a key that is dense in one place and sparse
    in another still gives ranges of equal work; a value that is more frequent
    than a range stays whole in one.
    """
    if n < 2:
        return []
    shares = F.array(*[F.lit(k / n) for k in range(1, n)])
    found = keys.agg(F.percentile_approx(column, shares, 100_000)).first()[0]
    low = keys.agg(F.min(column)).first()[0]
    return [b for b in sorted(set(found or ())) if b > low]


def range_predicates(column: str, bounds: list) -> list[str]:
    """SQL predicates of the ranges below, between and from the bounds on; every row, a null key too, meets exactly one."""
    def text(v) -> str:
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)

    if not bounds:
        return ["1 = 1"]
    out = [f"{column} < {text(bounds[0])} OR {column} IS NULL"]
    out += [f"{column} >= {text(a)} AND {column} < {text(b)}" for a, b in zip(bounds, bounds[1:])]
    return [*out, f"{column} >= {text(bounds[-1])}"]


def read_jdbc_by_key(spark: SparkSession, url: str, query: str, key: str, n: int, properties: dict | None = None,
                     require_label: bool = True) -> DataFrame:
    """A3: a SELECT over JDBC in n ranges of ``key`` with equal numbers of rows, one task each.

    The keys alone are read first, to find the ranges.
    """
    properties = properties or {}
    keys = spark.read.jdbc(url, f"(SELECT {key} FROM ({query}) q) k", properties=properties)
    predicates = range_predicates(key, equal_bounds(keys, key, n))
    return validate_schema(spark.read.jdbc(url, f"({query}) q", predicates=predicates, properties=properties), require_label)


def read_sql_file(spark: SparkSession, path: str | None = None, require_label: bool = True) -> DataFrame:
    """A4: run the projection query file against views registered in the session."""
    with open(path or DEFAULT_QUERY_PATH) as fh:
        text = fh.read().strip().rstrip(";")
    return validate_schema(spark.sql(text), require_label)


def read_records_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON customer records, each missing/null field defaulted."""
    df = spark.read.schema(CUSTOMER_SCHEMA_NO_LABEL).json(path)
    return df.select(
        *[F.coalesce(F.col(n), F.lit(RECORD_DEFAULTS[n]).cast(t)).alias(n) for n, t, _ in CUSTOMER_FIELDS if n in RECORD_DEFAULTS]
    )


CORRUPT = "_corrupt_record"


@dataclass(frozen=True)
class Checked:
    """Records that were accepted, and those that were not: their fields as far as they parse, ``record`` and ``reason``."""

    accepted: DataFrame
    rejected: DataFrame

    def counts(self) -> DataFrame:
        """One row for each reason, and one for what was accepted."""
        rejected = self.rejected.groupBy("reason").agg(F.count(F.lit(1)).alias("records"))
        accepted = self.accepted.agg(F.count(F.lit(1)).alias("records")).select(F.lit("accepted").alias("reason"), "records")
        return accepted.unionByName(rejected)


def read_checked(spark: SparkSession, path: str, fmt: str = "csv", require_label: bool = True, required: tuple[str, ...] = ("customer_id",)) -> Checked:
    """Customer records as CSV (with header) or JSON lines, without losing the ones that do not parse.

    A record is rejected as ``malformed`` if a field does not have its type or
    the fields do not fit the schema, and as ``<field> is missing`` for the
    first of ``required`` that is null or blank.  The parsed records are
    written once, so that both sides come from one parse.
    """
    schema = CUSTOMER_SCHEMA if require_label else CUSTOMER_SCHEMA_NO_LABEL
    nullable = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields]).add(CORRUPT, T.StringType())
    reader = spark.read.schema(nullable).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    if fmt == "csv":
        # the whole record is judged, whatever columns are asked for later
        parsed = reader.option("header", True).option("enforceSchema", True).csv(path)
    elif fmt == "json":
        parsed = reader.json(path)
    else:
        raise ValueError(f"no checked reader for {fmt}")
    reason = F.when(F.col(CORRUPT).isNotNull(), "malformed")
    for c in required:
        reason = reason.when(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""), f"{c} is missing")
    judged = written(parsed.withColumn("reason", reason))
    names = [f.name for f in schema.fields]
    return Checked(
        judged.filter(F.col("reason").isNull()).select(*names),
        judged.filter(F.col("reason").isNotNull()).select(*names, F.col(CORRUPT).alias("record"), "reason"),
    )


def write_checked(checked: Checked, path: str) -> None:
    """Both sides under ``path``, the rejected ones in a folder for each reason."""
    write_table(checked.accepted, f"{path}/accepted")
    write_table(checked.rejected, f"{path}/rejected", partition_by=["reason"])


def write_stamped(df: DataFrame, path: str, stamp: str = "run_ts") -> None:
    """Append the rows of one run, stamped with its time, in a folder of their own."""
    now = df.sparkSession.range(1).select(F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss").alias("t")).first()["t"]
    df.withColumn(stamp, F.lit(now)).write.mode("append").partitionBy(stamp).parquet(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None,
                mode: str = "overwrite") -> None:
    """Sinks (raw snapshot, engineered features, recommendations, explanations, drift report)."""
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)
