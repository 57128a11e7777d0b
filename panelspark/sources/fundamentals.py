"""Fundamentals from files and statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ["ticker", "filed_date", "period_end", "qeps", "eps_ttm", "bvps"]
SCHEMA = "ticker STRING, filed_date DATE, period_end DATE, qeps DOUBLE, eps_ttm DOUBLE, bvps DOUBLE"


def read_fundamentals(spark: SparkSession, path: str) -> DataFrame:
    """Fundamentals CSV; every required column must be present, in any order."""
    header = spark.read.option("header", True).csv(path)
    absent = [c for c in COLUMNS if c not in header.columns]
    if absent:
        raise ValueError(f"fundamentals need {COLUMNS}; missing {absent}")
    kinds = dict(item.strip().split(" ") for item in SCHEMA.split(","))
    return header.select(*[F.col(c).try_cast(kinds[c].lower()).alias(c) for c in COLUMNS])


def fundamentals_from_statements(income: DataFrame, balance: DataFrame) -> DataFrame:
    """Merge income and balance statements on (symbol, date). Book value per share uses
    the balance sheet's shares, else the income statement's; rows without earnings or
    book value are dropped."""
    num = lambda c: F.col(c).cast("string").try_cast("double")
    right = balance.groupBy("symbol", "date").agg(F.max(F.struct(
        num("totalStockholdersEquity").alias("equity"), num("weightedAverageShsOutDil").alias("shares"))).alias("_b"))
    joined = income.join(right, ["symbol", "date"], "left")
    shares = F.coalesce(F.nullif(F.col("_b.shares"), F.lit(0.0)), F.nullif(num("weightedAverageShsOutDil"), F.lit(0.0)))
    eps = num("epsDiluted")
    rows = joined.select(
        F.upper("symbol").alias("ticker"), F.col("filingDate").try_cast("date").alias("filed_date"),
        F.col("date").try_cast("date").alias("period_end"), eps.alias("qeps"), eps.alias("eps_ttm"),
        (F.nullif(F.col("_b.equity"), F.lit(0.0)) / shares).alias("bvps"))
    return rows.dropna(subset=["eps_ttm", "bvps"])
