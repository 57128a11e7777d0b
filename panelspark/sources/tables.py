"""Append tables, snapshots, exports and rebuilt bucket tables."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Column contracts of the pick log and the grade table.
LOG_SCHEMA = (
    "series STRING, run_id STRING, created_at_utc STRING, decision_date DATE, ticker STRING, signal_value DOUBLE, "
    "signal_close DOUBLE, stop_frac DOUBLE, entry_rule STRING, model STRING, universe STRING, market STRING, "
    "code_commit STRING, manifest_sha256 STRING")
GRADE_SCHEMA = (
    "series STRING, run_id STRING, decision_date DATE, entry_date DATE, exit_date DATE, ticker STRING, model STRING, "
    "entry DOUBLE, exit DOUBLE, ret DOUBLE, market_ret DOUBLE, excess DOUBLE, graded_at_utc STRING, "
    "manifest_sha256 STRING")
SNAPSHOT_SCHEMA = (
    "decision_date DATE, model STRING, ticker STRING, signal_value DOUBLE, signal_close DOUBLE, stop_frac DOUBLE, "
    "record_sha256 STRING, run_id STRING")


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A parquet table, or an empty typed one where nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], StructType.fromDDL(schema))


def append_table(df: DataFrame, path: str, schema: str) -> None:
    """Append under a fixed column contract; columns not given are null."""
    fields = StructType.fromDDL(schema)
    cols = [(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields]
    df.select(*cols).write.mode("append").parquet(path)


def write_snapshot(signals: DataFrame, path: str) -> None:
    """Signals of one or more runs, each run written once.

    Every record carries its hash. A run whose folder exists is refused.
    """
    from panelspark.operators.provenance import record_hash
    names = [f.name for f in StructType.fromDDL(SNAPSHOT_SCHEMA) if f.name != "record_sha256"]
    hashed = signals.select(*names).withColumn("record_sha256", record_hash(names))
    known = read_table(signals.sparkSession, path, SNAPSHOT_SCHEMA)
    if not hashed.select("run_id").distinct().join(known.select("run_id").distinct(), "run_id", "left_semi").isEmpty():
        raise ValueError("a snapshot of this run exists")
    hashed.write.mode("append").partitionBy("run_id").parquet(path)


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, SNAPSHOT_SCHEMA)


def export(df: DataFrame, path: str, kind: str = "csv") -> None:
    """Result tables as CSV with a header, or JSON lines."""
    writer = df.write.mode("overwrite")
    if kind == "csv":
        writer.option("header", True).csv(path)
    elif kind == "json":
        writer.json(path)
    else:
        raise ValueError(f"unknown export kind {kind}")


def upsert_distinct(new: DataFrame, path: str) -> str:
    """Rebuild a bucket table from its old and new rows without copies.

    ``path`` holds versions; the union is written as a new one before readers see it,
    so a failed job leaves the old table whole.
    """
    spark = new.sparkSession
    old = latest_version(spark, path)
    merged = new if old is None else old.drop("version").unionByName(new)
    stamp = spark.sql("SELECT date_format(current_timestamp(), 'yyyyMMddHHmmssSSS')").first()[0]
    target = f"{path}/version={stamp}-{uuid.uuid4().hex[:8]}"
    merged.distinct().write.mode("errorifexists").parquet(target)
    return target


def latest_version(spark: SparkSession, path: str) -> DataFrame | None:
    """Newest complete version of a rebuilt table, None before the first."""
    try:
        rows = spark.read.parquet(path)
    except AnalysisException:
        return None
    return rows.where(F.col("version") == rows.agg(F.max("version")).scalar())
