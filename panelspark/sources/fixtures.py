"""Inputs derived by Spark from the given tables.

The tables hold orders, not markets; these derivations give them the shapes the
operators expect, so that every registered query runs over whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.functions.columns import hash_unit, padded
from panelspark.operators.folds import assign_folds
from panelspark.operators.labels import build_panel, labelled_rows
from panelspark.session import shared
from panelspark.sources.bars import BAR_COLUMNS, bars_from_lines

MARKET = "MKT"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    return [table(spark, sf_dir, t) for t in ("lineitem", "supplier", "part")]


def bars(spark: SparkSession, sf_dir: str, period: str = "day", names: str = "nation") -> DataFrame:
    return shared(spark, f"bars {period} {names} {sf_dir}",
                  lambda: bars_from_lines(*_lines(spark, sf_dir), period, names=names))


def market(spark: SparkSession, sf_dir: str, period: str = "day") -> DataFrame:
    return shared(spark, f"market {period} {sf_dir}",
                  lambda: bars_from_lines(*_lines(spark, sf_dir), period, MARKET))


def all_bars(spark: SparkSession, sf_dir: str, period: str = "day", names: str = "nation") -> DataFrame:
    """Ticker bars plus the market's."""
    return bars(spark, sf_dir, period, names).select(BAR_COLUMNS).unionByName(
        market(spark, sf_dir, period).select(BAR_COLUMNS))


def panel(spark: SparkSession, sf_dir: str, names: str = "nation") -> DataFrame:
    return shared(spark, f"panel {names} {sf_dir}", lambda: build_panel(all_bars(spark, sf_dir, names=names), MARKET))


def scores(spark: SparkSession, sf_dir: str, names: str = "nation") -> DataFrame:
    return shared(spark, f"scores {names} {sf_dir}", lambda: build_scores(spark, sf_dir, names=names))


def build_scores(spark: SparkSession, sf_dir: str, arms: tuple[str, ...] = ("legacy", "corrected"),
                 names: str = "nation") -> DataFrame:
    """Scored test rows of every fold for two arms, with reproducible md5 scores; the
    second arm perturbs the first."""
    # The nations' panel serves many queries; of the suppliers' only the labels are asked for, so no features are written.
    rows = panel(spark, sf_dir) if names == "nation" else labelled_rows(all_bars(spark, sf_dir, names=names), MARKET)
    test = assign_folds(rows.select("ticker", "Date", "Close", "label"), roles=("test",))
    day = F.date_format("Date", "yyyy-MM-dd")
    first, other = hash_unit(F.lit("legacy"), "ticker", day), hash_unit(F.lit("other"), "ticker", day)
    proba = {"legacy": first, "corrected": F.lit(0.8) * first + F.lit(0.2) * other}
    arm = F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), proba[a].alias("proba")) for a in arms]))
    return test.select("fold", "ticker", "Date", "Close", "label", arm.alias("_a")).select(
        F.col("_a.arm").alias("arm"), "fold", "ticker", "Date", "Close", "label", F.col("_a.proba").alias("proba"))


def raw_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uncleaned filings, all text, from orders and their customers; price and quantity follow from the
    order's number."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    day = F.col("o_orderdate").cast("date")
    title = F.expr("""CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'CEO' WHEN '2' THEN 'CFO'
                      WHEN '3' THEN 'Dir' WHEN '4' THEN 'VP' ELSE 'COO' END""")
    ttype = F.expr("""CASE o_orderstatus WHEN 'P' THEN 'P - Purchase' WHEN 'F' THEN 'S - Sale' ELSE 'A - Grant' END""")
    cents = F.lit(100) + F.col("o_orderkey") % 9900
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.date_format(day, "yyyy-MM-dd").alias("filing_dt"),
        F.date_format(F.date_sub(day, 2), "yyyy-MM-dd").alias("trade_dt"),
        F.concat(F.lit("T"), padded("c_nationkey")).alias("ticker"),
        F.col("o_custkey").cast("string").alias("insider"), title.alias("title"), ttype.alias("ttype"),
        F.concat(F.lit("$"), F.format_string("%d.%02d", F.floor(cents / 100), cents % 100)).alias("price"),
        F.concat(F.lit("-"), F.format_number(F.lit(1000) + F.col("o_orderkey") % 7919, 0)).alias("qty"),
        F.concat(F.lit("$"), F.col("o_totalprice").cast("decimal(18,2)").cast("string")).alias("value"))


def fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly filings per nation: order values relative to the mean quarter, trailing
    sums and book values."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    ticker = F.concat(F.lit("T"), padded("c_nationkey"))
    quarter = F.date_trunc("quarter", F.col("o_orderdate")).cast("date")
    sums = (orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
            .groupBy(ticker.alias("ticker"), quarter.alias("q"))
            .agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("d")))
    mean = sums.agg(F.sum("d").cast("double") / F.count(F.lit(1))).scalar()
    books = customer.groupBy(ticker.alias("ticker")).agg(
        (F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("double") / F.count(F.lit(1))).alias("bvps"))
    w = Window.partitionBy("ticker").orderBy("q").rowsBetween(-3, 0)
    end = F.date_sub(F.add_months("q", 3), 1)
    eps = lambda d: d.cast("double") / mean * F.lit(40.0)
    return sums.select("ticker", "q", eps(F.col("d")).alias("qeps"), eps(F.sum("d").over(w)).alias("eps_ttm")).join(
        books, "ticker").select("ticker", F.date_add(end, 45).alias("filed_date"), end.alias("period_end"),
                                "qeps", "eps_ttm", "bvps")


def statements(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Income and balance statements as text columns; every third month has no balance."""
    filed = fundamentals(spark, sf_dir).select("ticker", "period_end", "filed_date",
                                               F.round("qeps", 4).alias("eps"), F.round("bvps", 2).alias("book"))
    text = lambda c: F.col(c).cast("string")
    income = filed.select(
        F.lower("ticker").alias("symbol"), text("period_end").alias("date"), text("filed_date").alias("filingDate"),
        F.when(F.col("eps") < 20, "n/a").otherwise(text("eps")).alias("epsDiluted"),
        F.lit("100").alias("weightedAverageShsOutDil"))
    balance = filed.where(F.month("period_end") != 3).select(
        F.lower("ticker").alias("symbol"), text("period_end").alias("date"),
        text("book").alias("totalStockholdersEquity"),
        F.when(F.month("period_end") == 6, "0").otherwise("50").alias("weightedAverageShsOutDil"))
    return income, balance


def quote_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One quote document per ticker: every seventh day lacks a close, every fifth a
    volume; adjusted closes are a fixed share of the close."""
    day = F.datediff("Date", F.lit("1970-01-01").cast("date")).cast("bigint")
    rows = bars(spark, sf_dir).select(
        "ticker", F.struct(
            (day * 86400 + 50400).alias("t"), F.col("Open").alias("o"), F.col("High").alias("h"), F.col("Low").alias("l"),
            F.when(day % 7 != 0, F.col("Close")).alias("c"), F.when(day % 5 != 0, F.col("Volume")).alias("v"),
            (F.col("Close") * 0.98765432).alias("a")).alias("x"))
    docs = rows.groupBy("ticker").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    quote = F.struct(*[F.col(f"xs.{k}").alias(n) for k, n in (
        ("o", "open"), ("h", "high"), ("l", "low"), ("c", "close"), ("v", "volume"))])
    result = F.struct(F.col("xs.t").alias("timestamp"), F.struct(
        F.array(quote).alias("quote"), F.array(F.struct(F.col("xs.a").alias("adjclose"))).alias("adjclose")
    ).alias("indicators"))
    body = F.struct(F.struct(F.array(result).alias("result")).alias("chart"))
    return docs.select("ticker", F.to_json(body, {"ignoreNullFields": "false"}).alias("payload"))


def external_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Another engine's documents: three equity stamps per day around the market close
    (the last one falls on the next UTC day), one document a year, and one order per ticker,
    dealt out to sixteen documents."""
    day = F.datediff("Date", F.lit("1970-01-01").cast("date")).cast("double") * 86400
    stamps = market(spark, sf_dir).select(F.year("Date").alias("part"), F.explode(F.array(
        F.array(day + 52200, *[F.col("Close") * 0.99] * 4),
        F.array(day + 75600, *[F.col("Close")] * 4),
        F.array(day + 93600, *[F.col("Close") * 1.001] * 4))).alias("v"))
    equity = stamps.groupBy("part").agg(F.collect_list("v").alias("values")).select(F.to_json(F.struct(
        F.create_map(F.lit("Strategy Equity"), F.struct(
            F.create_map(F.lit("Equity"), F.struct("values")).alias("series"))).alias("charts"),
        F.create_map(F.lit("Total Orders"), F.lit("1")).alias("statistics"))).alias("payload"))
    entry = F.struct(F.col("ticker").alias("k"), F.struct(F.struct(
        F.col("ticker").alias("value"), F.concat(F.lit("OLD"), "ticker", F.lit(" R735QTJ8XC9X")).alias("id")
    ).alias("symbol")).alias("v"))
    orders = bars(spark, sf_dir).select("ticker").distinct().groupBy(
        F.pmod(F.xxhash64("ticker"), F.lit(16)).alias("part")).agg(
        F.map_from_entries(F.collect_list(entry)).alias("orders")).select(F.to_json(F.struct("orders")).alias("payload"))
    return equity.unionByName(orders).select(F.lit("ext").alias("source"), "payload")


def external_log(picks: DataFrame) -> DataFrame:
    """Log lines announcing picks (``d0``, ``ticker``) in the month they realise; names
    with an even number appear under their first symbol."""
    old = F.when(F.expr("substring(ticker, 2)").cast("int") % 2 == 0, F.concat(F.lit("OLD"), "ticker")).otherwise(F.col("ticker"))
    sets = picks.groupBy("d0").agg(F.array_join(F.sort_array(F.collect_set(old)), ",").alias("names"))
    line = F.concat(F.date_format(F.add_months(F.trunc("d0", "month"), 1), "yyyy-MM"), F.lit("-03 10:30:00 : picks: "), "names")
    noise = F.concat(F.lit("Launching analysis for "), F.col("d0").cast("string"))
    return sets.select(F.lit("ext").alias("source"), F.explode(F.array(line, noise)).alias("value"))


def factor_lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Factor files as text, in percent, with a header and an annual block.

    The market factor is the index's monthly change; the others are the mean monthly
    return of the upper half minus the lower half by an attribute of the month before.
    Tickers here are nations, at most a hundred by their two-digit code.
    """
    weekly = bars(spark, sf_dir, "week")
    month = F.trunc("Date", "month").cast("date")
    w = Window.partitionBy("ticker").orderBy("month")
    monthly = weekly.groupBy("ticker", month.alias("month")).agg(
        F.max_by("Close", "Date").alias("close"), F.sum("Volume").alias("smb"),
        F.avg((F.col("High") - F.col("Low")) / F.col("Close")).alias("hml"),
        F.avg(F.col("Close") / F.col("Open")).alias("rmw"), F.max("High").alias("cma"))
    moved = monthly.withColumn("ret", F.col("close") / F.lag("close", 1).over(w) - 1)
    names = ["smb", "hml", "rmw", "cma", "mom"]
    known = moved.withColumn("mom", F.col("ret")).select(
        "ticker", "month", "ret", *[F.lag(c, 1).over(w).alias(c) for c in names]).dropna()
    whole = Window.partitionBy("month")
    halves = known.select("month", "ret", *[
        (F.row_number().over(whole.orderBy(c, "ticker")) * 2 > F.count(F.lit(1)).over(whole)).alias(c) for c in names])
    spread = halves.groupBy("month").agg(*[
        (F.avg(F.when(F.col(c), F.col("ret"))) - F.avg(F.when(~F.col(c), F.col("ret")))).alias(c) for c in names])
    index = market(spark, sf_dir, "week").groupBy(month.alias("month")).agg(F.max_by("Close", "Date").alias("close"))
    whole_index = Window.partitionBy().orderBy("month")
    mkt = index.select("month", (F.col("close") / F.lag("close", 1).over(whole_index) - 1).alias("mkt_rf")).dropna()
    rows = mkt.join(spread, "month")
    pct = lambda c: F.format_string("%.6f", F.coalesce(F.col(c), F.lit(0.0)) * 100)
    key = F.date_format("month", "yyyyMM")
    five = F.concat_ws(",", key, *[pct(c) for c in ("mkt_rf", "smb", "hml", "rmw", "cma")], F.lit("0.000000"))
    annual = F.concat_ws(",", F.date_format("month", "yyyy"), *[F.lit("1.0")] * 6)
    mom = F.concat_ws(",", key, F.when(F.month("month") == 2, F.lit("-99.99")).otherwise(pct("mom")))
    text5 = rows.select(F.explode(F.array(F.lit(",Mkt-RF,SMB,HML,RMW,CMA,RF"), five, annual)).alias("value"))
    return text5, rows.select(F.explode(F.array(F.lit("header"), mom)).alias("value"))


def pick_log(spark: SparkSession, book: DataFrame) -> DataFrame:
    """Pick log rows from a threshold book (arm, d0, ticker, proba)."""
    return book.select(
        F.lit("prospective").alias("series"), F.concat_ws("-", F.lit("run"), "arm", F.col("d0").cast("string")).alias("run_id"),
        F.lit("2000-01-01T00:00:00+00:00").alias("created_at_utc"), F.col("d0").alias("decision_date"), "ticker",
        F.round("proba", 6).alias("signal_value"), F.lit(100.0).alias("signal_close"), F.lit(0.95).alias("stop_frac"),
        F.lit("next_session_open").alias("entry_rule"), F.col("arm").alias("model"), F.lit("nations").alias("universe"),
        F.lit(MARKET).alias("market"), F.lit("none").alias("code_commit"), F.lit("none").alias("manifest_sha256"))
