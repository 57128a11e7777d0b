"""Bar sources: CSV folders, quote payloads, and bars built from order lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.functions.columns import padded

BAR_SCHEMA = "Date DATE, Open DOUBLE, High DOUBLE, Low DOUBLE, Close DOUBLE, Volume DOUBLE"
BAR_COLUMNS = ["ticker", "Date", "Open", "High", "Low", "Close", "Volume"]
VALUES = ["Open", "High", "Low", "Close", "Volume"]


def dedupe_bars(df: DataFrame) -> DataFrame:
    """One bar per (ticker, Date). Copies collapse map-side; the choice among
    differing copies does not depend on row order."""
    return (df.where(F.col("Date").isNotNull())
            .groupBy("ticker", "Date").agg(F.min(F.struct(*VALUES)).alias("_bar"))
            .select("ticker", "Date", *[F.col("_bar")[c].alias(c) for c in VALUES]))


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    """Bars from a folder of CSV files, one per ticker; the file name is the ticker.

    Headers must name the columns of ``BAR_SCHEMA`` (any case, outer blanks ignored).
    """
    raw = (spark.read.schema(BAR_SCHEMA)
           .option("header", True).option("enforceSchema", False)
           .option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
           .csv(path))
    stem = F.regexp_replace(F.col("_metadata.file_name"), r"\.csv(\.gz)?$", "")
    return dedupe_bars(raw.select(F.upper(stem).alias("ticker"), "Date", *VALUES))


QUOTE_SCHEMA = (
    "STRUCT<chart: STRUCT<result: ARRAY<STRUCT<timestamp: ARRAY<BIGINT>, indicators: STRUCT<"
    "quote: ARRAY<STRUCT<open: ARRAY<DOUBLE>, high: ARRAY<DOUBLE>, low: ARRAY<DOUBLE>, "
    "close: ARRAY<DOUBLE>, volume: ARRAY<DOUBLE>>>, "
    "adjclose: ARRAY<STRUCT<adjclose: ARRAY<DOUBLE>>>>>>>>"
)


def bars_from_payload(payloads: DataFrame) -> DataFrame:
    """Adjusted bars from quote payloads (``ticker``, ``payload`` JSON text).

    Rows without a close are dropped; prices scale by adjusted over raw close where
    both are non-zero; a missing volume is 0.
    """
    parsed = payloads.select(
        F.upper("ticker").alias("ticker"),
        F.from_json("payload", QUOTE_SCHEMA).chart.result[0].alias("r"))
    quote = F.col("r.indicators.quote")[0]
    adjusted = F.get(F.get(F.col("r.indicators.adjclose"), F.lit(0)).adjclose, F.col("pos"))
    rows = parsed.select("ticker", "r", F.posexplode("r.timestamp").alias("pos", "ts")).select(
        "ticker", "ts",
        *[F.get(quote[c], F.col("pos")).alias(c) for c in ("open", "high", "low", "close", "volume")],
        adjusted.alias("adj"))
    factor = F.when((F.col("adj") != 0) & (F.col("close") != 0), F.col("adj") / F.col("close")).otherwise(F.lit(1.0))
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("ts") / 86400).cast("int"))
    return rows.where(F.col("close").isNotNull()).select(
        "ticker", day.alias("Date"),
        *[(F.col(c.lower()) * factor).alias(c) for c in ("Open", "High", "Low", "Close")],
        F.coalesce("volume", F.lit(0.0)).alias("Volume"))


def _hundredths(c: str):
    """Value in whole hundredths as BIGINT; long sums are exact in any order and cheap."""
    return F.round(F.col(c).cast("decimal(18,2)").cast("double") * 100).cast("bigint")


def bars_from_lines(lines: DataFrame, supplier: DataFrame, part: DataFrame, period: str = "day",
                    market: str | None = None, names: str = "nation") -> DataFrame:
    """Bars from order lines: the ticker is the line's supplier (``names="supplier"``, as many names
    as suppliers) or its nation, prices are part prices weighted by quantity.

    Prices and quantities are summed as whole hundredths and are therefore the same in
    any order. ``market`` names one index ticker over all lines instead. The aggregation
    combines map-side, so a nation with most of the lines costs no more than another.
    """
    when = F.col("l_shipdate").cast("date") if period == "day" else F.date_trunc(period, "l_shipdate").cast("date")
    base = lines.select("l_partkey", "l_suppkey", when.alias("Date"), _hundredths("l_quantity").alias("_q"))
    if market:
        base, ticker = base.drop("l_suppkey"), F.lit(market)
    else:
        name = {"nation": F.concat(F.lit("T"), padded("s_nationkey")),
                "supplier": F.concat(F.lit("S"), F.col("s_suppkey").cast("string"))}[names]
        named = supplier.select(F.col("s_suppkey").alias("l_suppkey"), name.alias("ticker"))
        base, ticker = base.join(named, "l_suppkey"), F.col("ticker")
    prices = part.select(F.col("p_partkey").alias("l_partkey"), "p_retailprice", _hundredths("p_retailprice").alias("_p"))
    quantity = F.sum("_q")
    return base.join(prices, "l_partkey").groupBy(ticker.alias("ticker"), "Date").agg(
        (F.sum("_p") / F.lit(100.0) / F.count(F.lit(1))).alias("Open"),
        F.max("p_retailprice").alias("High"),
        F.min("p_retailprice").alias("Low"),
        ((F.sum(F.col("_p") * F.col("_q")) / F.lit(10000.0)) / (quantity / F.lit(100.0))).alias("Close"),
        (quantity / F.lit(100.0)).alias("Volume"))


def vintage(bars: DataFrame, max_gap: int = 7, oldest: int = 5) -> DataFrame:
    """Last date per ticker with the span guard; the ``oldest`` stalest tickers."""
    ends = bars.groupBy("ticker").agg(F.max("Date").alias("last_date"))
    span = ends.agg(F.struct(F.count(F.lit(1)).alias("symbols"),
                             F.datediff(F.max("last_date"), F.min("last_date")).cast("bigint").alias("days"))).scalar()
    return ends.orderBy("last_date", "ticker").limit(oldest).select("ticker", "last_date", span.alias("_s")).select(
        "ticker", "last_date", F.col("_s.symbols").alias("symbols"), F.col("_s.days").alias("span_days"),
        (F.col("_s.days") <= max_gap).alias("ok"))


def assert_vintage(bars: DataFrame, max_gap: int = 7) -> None:
    stale = vintage(bars, max_gap).collect()
    if not stale:
        raise ValueError("no bars to check")
    if not stale[0].ok:
        names = ", ".join(f"{r.ticker} {r.last_date}" for r in stale)
        raise ValueError(f"mixed vintages: {stale[0].span_days} days apart; oldest: {names}")


def slice_dates(df: DataFrame, start: str | None, end: str | None, on: str = "Date",
                require_rows: bool = False) -> DataFrame:
    """Rows with start <= date <= end; optionally fail when none is left."""
    out = df
    if start is not None:
        out = out.where(F.col(on) >= F.lit(start).cast("date"))
    if end is not None:
        out = out.where(F.col(on) <= F.lit(end).cast("date"))
    if require_rows and out.isEmpty():
        raise ValueError(f"no rows between {start} and {end}")
    return out


def coverage(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rows, dates, tickers and date range, overall or per key group."""
    return df.groupBy(*(keys or [])).agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("Date").alias("dates"),
        F.countDistinct("ticker").alias("tickers"),
        F.min("Date").alias("first_date"), F.max("Date").alias("last_date"))
