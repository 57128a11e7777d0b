"""Monthly factor files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIVE = ["mkt_rf", "smb", "hml", "rmw", "cma", "rf"]
MISSING_LIMIT = -0.98


def read_factors(spark: SparkSession, path: str, cols: Sequence[str]) -> DataFrame:
    return factors_from_text(spark.read.text(path), cols)


def factors_from_text(lines: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows keyed YYYYMM as decimals under the month end. Annual rows have a four-digit
    key and fall out by the pattern."""
    rows = lines.where(F.col("value").rlike(r"^\s*\d{6}\s*,")).select(F.split("value", ",").alias("p"))
    key = F.trim(F.col("p")[0])
    return rows.select(
        F.last_day(F.to_date(F.concat(key, F.lit("01")), "yyyyMMdd")).alias("month"),
        *[(F.trim(F.col("p")[i]).cast("double") / F.lit(100.0)).alias(c) for i, c in enumerate(cols, 1)])


def factor_table(five: DataFrame, mom: DataFrame) -> DataFrame:
    """Five factors left-joined with momentum; the missing marker (-99 %) is dropped."""
    return five.join(mom.where(F.col("mom") > MISSING_LIMIT), "month", "left")
