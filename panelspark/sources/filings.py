"""Filings: page extraction, cleaning and monthly aggregates."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from panelspark.functions.columns import is_csuite, month_key, number_from_text
from panelspark.functions.joins import asof_join
from panelspark.operators.features import INSIDER_FEATURES

AVAILABLE_AFTER = 3  # days after month end
CONVICTION_VALUE = 50_000
FILING_KEY = ["filing_dt", "trade_dt", "ticker", "insider", "side", "qty", "price"]

# Patterns of the filing table.
TABLE_PATTERN = r"(?s)<table[^>]*tinytable[^>]*>(.*?)</table>"
ROW_PATTERN = r"(?s)<tr[^>]*>(.*?)</tr>"
CELL_PATTERN = r"(?s)<td[^>]*>(.*?)</td>"
SYMBOL_PATTERN = r"\">([A-Z][A-Z\.\-]{0,7})</a>"


@F.pandas_udf(ArrayType(StringType()))
def _unescape(cells: pd.Series) -> pd.Series:
    return cells.map(lambda row: [html.unescape(c).strip() for c in row])


def filings_from_pages(pages: DataFrame, text: str = "html") -> DataFrame:
    """Filing rows from raw pages: rows of the filing table with at least 13 cells."""
    table = F.regexp_extract(text, TABLE_PATTERN, 1)
    rows = pages.select(F.explode(F.regexp_extract_all(table, F.lit(ROW_PATTERN), 1)).alias("row"))
    cells = rows.select(F.regexp_extract_all("row", F.lit(CELL_PATTERN), 1).alias("raw")).where(F.size("raw") >= 13)
    plain = cells.select("raw", _unescape(F.transform(
        "raw", lambda c: F.regexp_replace(c, "<[^>]+>", ""))).alias("t"))
    symbol = F.regexp_extract(F.col("raw")[3], SYMBOL_PATTERN, 1)
    fallback = F.substring(F.regexp_replace(F.col("t")[3], r"[^A-Z.\-]", ""), 1, 8)
    return plain.select(
        F.substring(F.col("t")[1], 1, 10).alias("filing_dt"), F.substring(F.col("t")[2], 1, 10).alias("trade_dt"),
        F.when(symbol != "", symbol).otherwise(fallback).alias("ticker"), F.col("t")[4].alias("insider"),
        F.col("t")[5].alias("title"), F.col("t")[6].alias("ttype"), F.col("t")[7].alias("price"),
        F.col("t")[8].alias("qty"), F.col("t")[11].alias("value"))


def clean_filings(raw: DataFrame) -> DataFrame:
    """Typed open-market filings with a signed value, one per key. Copies collapse
    map-side; among rows equal on the key the smallest remaining values are kept."""
    side = F.substring("ttype", 1, 1)
    typed = raw.select(
        F.col("filing_dt").try_cast("date").alias("filing_dt"), F.col("trade_dt").try_cast("date").alias("trade_dt"),
        "ticker", "insider", "title", "ttype", side.alias("side"), number_from_text("price").alias("price"),
        F.abs(number_from_text("qty")).alias("qty"), number_from_text("value").alias("value"))
    kept = typed.where(F.col("filing_dt").isNotNull() & F.col("side").isin("P", "S"))
    signed = kept.withColumn("sval", F.abs("value") * F.when(F.col("side") == "P", 1.0).otherwise(-1.0))
    rest = ["title", "ttype", "value", "sval"]
    return signed.groupBy(*FILING_KEY).agg(F.min(F.struct(*rest)).alias("_r")).select(
        *FILING_KEY, *[F.col("_r")[c].alias(c) for c in rest])


def month_end_available(month) -> F.Column:
    return F.date_add(F.last_day(month), AVAILABLE_AFTER)


def monthly_features(filings: DataFrame) -> DataFrame:
    """Per ticker and filing month: counts, distinct buyers, net value, buy share and
    their means over the last three buckets. Aggregation combines map-side; the window
    runs over a ticker's months."""
    buy, sell = F.col("side") == "P", F.col("side") == "S"
    m = filings.groupBy("ticker", month_key("filing_dt").alias("month")).agg(
        F.count_if(buy).alias("n_buy"), F.count_if(sell).alias("n_sell"),
        F.countDistinct(F.when(buy, F.col("insider"))).alias("buyers"),
        F.sum(F.col("sval").cast("decimal(20,2)")).cast("double").alias("netval"))
    share = F.col("n_buy") / F.when(F.col("n_buy") + F.col("n_sell") == 0, 1).otherwise(F.col("n_buy") + F.col("n_sell"))
    m = m.withColumn("buy_ratio", share)
    w = Window.partitionBy("ticker").orderBy("month").rowsBetween(-2, 0)
    return m.select(
        "ticker", month_end_available("month").alias("avail"), F.avg("n_buy").over(w).alias("ins_nbuy_3m"),
        F.avg("netval").over(w).alias("ins_netval_3m"), F.avg("buy_ratio").over(w).alias("ins_buy_ratio_3m"),
        F.when(F.col("buyers") >= 3, 1).otherwise(0).alias("ins_cluster_buy"))


def conviction_buys(filings: DataFrame, gap_days: int = 365) -> DataFrame:
    """Large officer purchases with no other one by the same insider in the ``gap_days``
    before.

    Only the first such filing of a day can qualify, so filings collapse to one per
    (ticker, insider, day) before the window; the window is bounded by days. Among
    filings of one day the smallest value is the first.
    """
    buys = filings.where((F.col("side") == "P") & is_csuite("title") & (F.col("sval") > CONVICTION_VALUE))
    daily = buys.groupBy("ticker", "insider", "filing_dt").agg(F.min("sval").alias("sval"))
    before = F.lag("filing_dt", 1).over(Window.partitionBy("ticker", "insider").orderBy("filing_dt"))
    return daily.withColumn("_prev", before).where(
        F.col("_prev").isNull() | (F.datediff("filing_dt", "_prev") > gap_days)).drop("_prev")


def monthly_conviction(filings: DataFrame) -> DataFrame:
    """Conviction presence and value per filing month, means over three buckets. Months
    with any filing form the spine, so quiet months pull the means down."""
    hits = conviction_buys(filings).groupBy("ticker", month_key("filing_dt").alias("month")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("sval").cast("decimal(20,2)")).cast("double").alias("val"))
    spine = filings.select("ticker", month_key("filing_dt").alias("month")).distinct()
    m = spine.join(hits, ["ticker", "month"], "left")
    w = Window.partitionBy("ticker").orderBy("month").rowsBetween(-2, 0)
    return m.select(
        "ticker", month_end_available("month").alias("avail"),
        F.avg(F.when(F.col("n") > 0, 1.0).otherwise(0.0)).over(w).alias("ins_conv_3m"),
        F.avg(F.coalesce("val", F.lit(0.0))).over(w).alias("ins_convval_3m"))


def add_insider(panel: DataFrame, buckets: DataFrame) -> DataFrame:
    """Latest bucket available by each panel date; no history gives 0 and a missing flag."""
    joined = asof_join(panel, buckets, ["ticker"], "Date", "avail", unique_left=True)
    values = [c for c in INSIDER_FEATURES if c != "ins_missing"]
    return joined.select(
        *panel.columns, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in values],
        F.when(F.col("avail").isNull(), 1).otherwise(0).alias("ins_missing"))
