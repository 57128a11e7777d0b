"""Intrinsic value: growth, panels as of filing, holding episodes and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.columns import AAA_YIELD, graham_iv, graham_number
from panelspark.functions.joins import asof_join
from panelspark.operators.brake import let
from panelspark.operators.evaluate import annual_sharpe, compound

HOLD_DAYS = 3 * 365


def periods_per_year(fund: DataFrame) -> DataFrame:
    """4 for tickers whose median filing gap is under 200 days or unknown, else 1. A
    ticker's filings are bounded by its reporting history."""
    w = Window.partitionBy("ticker").orderBy("filed_date")
    gaps = fund.select("ticker", F.datediff("filed_date", F.lag("filed_date", 1).over(w)).alias("gap"))
    return gaps.groupBy("ticker").agg(F.percentile("gap", 0.5).alias("gap")).select(
        "ticker", F.when(F.col("gap").isNull() | (F.col("gap") < 200), 4).otherwise(1).alias("ppy"))


def growth_rate(fund: DataFrame) -> DataFrame:
    """Annualised slope of log earnings over each filing's own trailing history.

    Quarterly: last 30 values, at least 12; annual: last 10, at least 5. Any
    non-positive value, or too few, gives 0; the result is clipped to +-0.5.
    """
    rows = fund.join(periods_per_year(fund), "ticker")
    known = F.col("qeps").isNotNull()
    w = Window.partitionBy("ticker", known).orderBy("filed_date")
    numbered = rows.withColumn("_i", F.row_number().over(w).cast("double"))
    log_eps = F.when(F.col("qeps") > 0, F.ln("qeps"))

    def slope(length: int, need: int, ppy: int) -> Column:
        frame = w.rowsBetween(-(length - 1), 0)
        fit = F.regr_slope(log_eps, F.col("_i")).over(frame)
        usable = (F.count("qeps").over(frame) >= need) & (F.min("qeps").over(frame) > 0)
        return F.when(usable, F.greatest(F.lit(-0.5), F.least(F.lit(0.5), fit * ppy))).otherwise(0.0)

    g = F.when(known, F.when(F.col("ppy") == 4, slope(30, 12, 4)).otherwise(slope(10, 5, 1)))
    past = Window.partitionBy("ticker").orderBy("filed_date").rowsBetween(Window.unboundedPreceding, 0)
    return (numbered.withColumn("g", g)
            .withColumn("g", F.coalesce(F.last("g", ignorenulls=True).over(past), F.lit(0.0))).drop("_i"))


def iv_panel(fund: DataFrame, aaa: float = AAA_YIELD) -> DataFrame:
    """One valuation row per filing on that filing's trailing history only."""
    return growth_rate(fund).select(
        "ticker", "filed_date", "period_end", "eps_ttm", "bvps", "g",
        graham_iv("eps_ttm", "g", aaa).alias("iv"), graham_number("eps_ttm", "bvps").alias("graham_num"))


def month_spine(bars: DataFrame) -> DataFrame:
    """(ticker, month end, month number) from a ticker's first month to the last month
    of the data; months without any bar are left out."""
    months = bars.select(F.trunc("Date", "month").cast("date").alias("month")).distinct()
    numbered = months.select("month", F.row_number().over(Window.orderBy("month")).alias("i"))
    span = bars.agg(F.trunc(F.max("Date"), "month").cast("date")).scalar()
    starts = bars.groupBy("ticker").agg(F.trunc(F.min("Date"), "month").cast("date").alias("_a"))
    every = starts.select("ticker", F.explode(F.sequence("_a", span, F.expr("interval 1 month"))).alias("month"))
    return every.join(F.broadcast(numbered), "month").select("ticker", F.last_day("month").alias("d"), "i")


def asof_value(bars: DataFrame, iv: DataFrame) -> DataFrame:
    """Value and price known at each month end, per ticker."""
    spine = month_spine(bars)
    valued = asof_join(spine, iv.where(F.col("iv").isNotNull()).select("ticker", "filed_date", "iv"),
                       ["ticker"], "d", "filed_date", unique_left=True)
    priced = asof_join(valued, bars.select("ticker", F.col("Date").alias("px_date"), F.col("Close").alias("price")),
                       ["ticker"], "d", "px_date", unique_left=True)
    return priced.select("ticker", "d", "i", "iv", "price")


def value_qualifiers(asof: DataFrame, discount: float = 0.5) -> DataFrame:
    return asof.where((F.col("iv") > 0) & (F.col("price") <= F.lit(1 - discount) * F.col("iv")))


EPISODE = "struct<entry_i:int,entry_date:date,entry_price:double,entry_iv:double,exit_i:int,exit_date:date,exit_price:double>"


def value_episodes(asof: DataFrame, discounts: Sequence[float] = (0.5, 0.3, 0.7)) -> DataFrame:
    """Holding episodes per ticker and discount.

    Enter when qualifying and flat; leave when the price reaches the value paid for, or
    after three years; a ticker sold this month may be bought again at once. Each fold
    runs over the months of one ticker.
    """
    months = asof.where(F.col("price").isNotNull()).groupBy("ticker").agg(
        F.array_sort(F.collect_list(F.struct("i", "d", "price", "iv"))).alias("xs"))
    paths = months.withColumn("discount", F.explode(F.array(*[F.lit(float(d)) for d in discounts])))
    none = F.expr(f"cast(null as {EPISODE})")
    start = F.struct(none.alias("open"), F.expr(f"cast(array() as array<{EPISODE}>)").alias("out"))

    def episode(entry_i, entry_d, entry_p, entry_v, x=None) -> Column:
        gone = x is not None
        return F.struct(
            entry_i.alias("entry_i"), entry_d.alias("entry_date"), entry_p.alias("entry_price"),
            entry_v.alias("entry_iv"),
            (x["i"] if gone else F.lit(None).cast("int")).alias("exit_i"),
            (x["d"] if gone else F.lit(None).cast("date")).alias("exit_date"),
            (x["price"] if gone else F.lit(None).cast("double")).alias("exit_price"))

    def step(acc: Column, x: Column) -> Column:
        held = acc["open"]
        sell = held.isNotNull() & ((x["price"] >= held["entry_iv"])
                                   | (F.datediff(x["d"], held["entry_date"]) > HOLD_DAYS))
        flat = F.coalesce(sell, F.lit(False)) | held.isNull()
        buy = flat & (x["iv"] > 0) & (x["price"] <= (1 - F.col("discount")) * x["iv"])
        closed = episode(held["entry_i"], held["entry_date"], held["entry_price"], held["entry_iv"], x)
        out = F.when(sell, F.concat(acc["out"], F.array(closed))).otherwise(acc["out"])
        now = (F.when(buy, episode(x["i"], x["d"], x["price"], x["iv"]))
               .when(flat, none).otherwise(held))
        return let(out, lambda o: F.struct(now.alias("open"), o.alias("out")))

    def finish(acc: Column) -> Column:
        return F.when(acc["open"].isNotNull(), F.concat(acc["out"], F.array(acc["open"]))).otherwise(acc["out"])

    return paths.select("ticker", "discount", F.inline(F.aggregate("xs", start, step, finish)))


def value_index(episodes: DataFrame, asof: DataFrame, cost_bps: float = 5.0) -> DataFrame:
    """Equal-weight monthly return over the open episodes of each discount, with a cost
    in the first and in the exit month of an episode; months without one return 0."""
    w = Window.partitionBy("ticker").orderBy("i")
    steps = asof.select("ticker", "i", "d", (F.col("price") / F.lag("price", 1).over(w) - 1).alias("ret"))
    last = asof.agg(F.max("i")).scalar()
    held = episodes.withColumn("_x", F.coalesce("exit_i", last)).where("_x > entry_i").select(
        "ticker", "discount", "entry_i", "exit_i", F.explode(F.sequence(F.col("entry_i") + 1, F.col("_x"))).alias("i"))
    fee = F.lit(cost_bps / 1e4)
    paid = (F.when(F.col("i") == F.col("entry_i") + 1, fee).otherwise(0.0)
            + F.when(F.col("i") == F.col("exit_i"), fee).otherwise(0.0))
    rows = held.join(steps, ["ticker", "i"]).where(F.col("ret").isNotNull())
    earned = rows.groupBy("discount", "i").agg(F.avg(F.col("ret") - paid).alias("net"),
                                               F.count(F.lit(1)).alias("n"))
    levels = episodes.agg(F.sort_array(F.collect_set("discount"))).scalar()
    spine = asof.select("i", "d").distinct().withColumn("discount", F.explode(levels))
    return spine.join(earned, ["discount", "i"], "left").select(
        "discount", "i", F.col("d").alias("d0"), F.coalesce("net", F.lit(0.0)).alias("net"),
        F.coalesce("n", F.lit(0)).alias("n"))


def fair_benchmark(asof: DataFrame) -> DataFrame:
    """Equal-weight buy and hold of the names that can be valued in the first month in
    which any can."""
    able = asof.where(F.col("iv").isNotNull() & (F.col("price") > 0))
    first = able.agg(F.min("i")).scalar()
    members = able.where(F.col("i") == first).select("ticker", F.col("price").alias("p0"))
    size = members.agg(F.count(F.lit(1))).scalar()
    held = asof.where(F.col("i") >= first).join(members, "ticker")
    return held.groupBy("i", "d").agg(
        (F.sum(F.coalesce("price", F.lit(0.0)) / F.col("p0")) / size).alias("bench"))


def value_report(index: DataFrame, bench: DataFrame) -> DataFrame:
    """Discount by half: growth on calendar days (at least one year), drawdown, Sharpe,
    benchmark growth and mean names; both curves are rebased to the half."""
    from panelspark.operators.folds import split_halves
    from panelspark.operators.ledger import equity_curve
    halves = split_halves(index, "i")
    moves = bench.select("i", (F.col("bench") / F.lag("bench", 1).over(Window.orderBy("i")) - 1).alias("bench_net"))
    rows = halves.join(F.broadcast(moves), "i", "left")
    curve = equity_curve(rows, ["discount", "half"])
    stats = curve.groupBy("discount", "half").agg(
        F.count(F.lit(1)).alias("months"), compound().alias("_e"),
        F.greatest(F.lit(1.0), F.datediff(F.max("d0"), F.min("d0")) / F.lit(365.25)).alias("_y"),
        F.min(F.least("drawdown", F.lit(0.0))).alias("max_dd"), annual_sharpe().alias("sharpe"),
        F.product(1 + F.coalesce("bench_net", F.lit(0.0))).alias("_b"), F.avg("n").alias("avg_n"))
    return stats.select("discount", "half", "months", "max_dd", "sharpe", "avg_n",
                        (F.pow("_e", 1 / F.col("_y")) - 1).alias("cagr"),
                        (F.pow("_b", 1 / F.col("_y")) - 1).alias("bench_cagr"))
