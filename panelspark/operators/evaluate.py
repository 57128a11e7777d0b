"""Summaries of ledgers, scores and return series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.columns import correlation
from panelspark.functions.joins import beside
from panelspark.functions.ranks import average_rank, ordered_counts

EPS = 1e-12


def compound(net: str = "net"):
    return F.product(1 + F.col(net))


def annualised(equity, months):
    return F.when(equity > 0, F.pow(equity, F.lit(12.0) / months) - 1)


def annual_sharpe(net: str = "net", eps: float = EPS):
    return F.avg(net) / (F.stddev_samp(net) + F.lit(eps)) * F.sqrt(F.lit(12.0))


def strict_sharpe(net: str = "net", annual: bool = True):
    """Mean over deviation; null when the deviation is 0."""
    ratio = F.avg(net) / F.nullif(F.stddev_samp(net), F.lit(0.0))
    return ratio * F.sqrt(F.lit(12.0)) if annual else ratio


def summarize(ledger: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Months, ending equity, growth rate, Sharpe, worst drawdown, mean turnover and
    share of invested months. Drawdown is rebased to the rows given."""
    from panelspark.operators.ledger import equity_curve
    curve = equity_curve(ledger, keys)
    months = F.count(F.lit(1))
    stats = curve.groupBy(*keys).agg(
        months.alias("months"), compound().alias("equity_end"),
        annual_sharpe().alias("sharpe"), F.min(F.least("drawdown", F.lit(0.0))).alias("max_dd"),
        *([F.avg("turnover").alias("avg_turnover")] if "turnover" in ledger.columns else []),
        *([F.avg(F.when(F.col("n") > 0, 1.0).otherwise(0.0)).alias("exposure")] if "n" in ledger.columns else []))
    return stats.withColumn("cagr", annualised(F.col("equity_end"), F.col("months")))


def auc(df: DataFrame, by: Sequence[str], label: str = "label", score: str = "proba") -> DataFrame:
    """Area under the ROC curve by rank sum; null where only one class is present.

    Positives are counted with the score's distinct values, so no rank goes back to the rows.
    """
    positive = F.count_if(F.col(label) == 1)
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), positive.alias("positives"))
    rank = F.col("below") + (F.col("n") + F.lit(1)) / F.lit(2.0)
    ranked = ordered_counts(df, by, score, hits=positive).where("hits > 0").groupBy(*by).agg(
        F.sum(F.col("hits") * rank).alias("_s"))
    sums = sizes.join(ranked, list(by), "left") if by else beside(sizes, ranked)
    p, n = F.col("positives"), F.col("rows") - F.col("positives")
    return sums.select(*by, "rows", "positives", F.when(
        (p > 0) & (n > 0), (F.col("_s") - p * (p + 1) / 2) / F.nullif(p * n, F.lit(0))).alias("auc"))


def align_caches(a: DataFrame, b: DataFrame, left: str = "left", right: str = "right") -> DataFrame:
    """Common (Date, ticker) rows of two scored caches with suffixed columns."""
    cols = ["Close", "label", "proba", "fold"]
    sides = [d.select("Date", "ticker", *[F.col(c).alias(f"{c}_{s}") for c in cols]) for d, s in ((a, left), (b, right))]
    return sides[0].join(sides[1], ["Date", "ticker"])


def compare_scores(common: DataFrame) -> DataFrame:
    """Overall agreement of two caches in one row."""
    ranked = average_rank(average_rank(common, [], "proba_left", "_a"), [], "proba_right", "_b")
    rel = F.abs(F.col("Close_left") / F.col("Close_right") - 1)
    return ranked.agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(F.when(F.col("label_left") == F.col("label_right"), 1.0).otherwise(0.0)).alias("label_match"),
        F.max(rel).alias("close_max_diff"),
        correlation("proba_left", "proba_right").alias("pearson"),
        correlation("_a", "_b").alias("spearman"),
        F.avg(F.abs(F.col("proba_left") - F.col("proba_right"))).alias("mean_abs_diff"))


def close_gap(common: DataFrame, q: float = 0.5) -> DataFrame:
    """Quantile of the relative close difference over all common rows."""
    from panelspark.functions.ranks import group_quantile
    rel = common.select(F.abs(F.col("Close_left") / F.col("Close_right") - 1).alias("gap"))
    return group_quantile(rel, [], "gap", q, "close_gap")


def spearman(df: DataFrame, by: Sequence[str], a: str, b: str) -> DataFrame:
    """Rank correlation per group. Only rows with both values are ranked."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    ranked = average_rank(average_rank(both, by, a, "_a"), by, b, "_b")
    return ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), correlation("_a", "_b").alias("spearman"))


def null_summary(equities: DataFrame, keys: Sequence[str] = (), value: str = "equity_end") -> DataFrame:
    """Mean, deviation and 5 / 95 % quantiles over the trials (a parameter-sized set)."""
    return equities.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trials"), F.avg(value).alias("null_mean"), F.stddev_samp(value).alias("null_std"),
        F.percentile(value, 0.05).alias("null_p5"), F.percentile(value, 0.95).alias("null_p95"))


def return_moments(series: DataFrame, keys: Sequence[str], net: str = "net") -> DataFrame:
    """Months, monthly Sharpe, skewness and Pearson kurtosis per trial."""
    return series.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("months"),
        F.coalesce(strict_sharpe(net, annual=False), F.lit(0.0)).alias("sharpe_m"),
        F.skewness(net).alias("skew"), (F.kurtosis(net) + 3).alias("kurtosis"))


def trial_variance(moments: DataFrame) -> DataFrame:
    return moments.agg(F.count(F.lit(1)).alias("trials"), F.var_samp("sharpe_m").alias("sharpe_var"))


def collapse_months(series: DataFrame, keys: Sequence[str] = (), ret: str = "net", month: str = "month") -> DataFrame:
    """Compound rows that fall in the same month."""
    return series.groupBy(*keys, month).agg((F.product(1 + F.col(ret)) - 1).alias(ret))


def month_last(series: DataFrame, value: str, keys: Sequence[str] = (), on: str = "Date") -> DataFrame:
    """Last value of each month."""
    return series.groupBy(*keys, F.trunc(on, "month").cast("date").alias("month")).agg(
        F.max_by(value, on).alias(value))


def drawdown_dates(curve: DataFrame, keys: Sequence[str] = (), value: str = "equity", on: str = "Date") -> DataFrame:
    """Deepest drawdown of a curve with its peak and trough dates; ties take the
    earliest date. A group is the days of one curve."""
    w = Window.partitionBy(*keys).orderBy(on).rowsBetween(Window.unboundedPreceding, 0)
    top = F.max(F.struct(F.col(value).alias("v"), (-F.unix_date(on)).alias("d"))).over(w)
    marked = curve.select(*keys, on, F.col(value).alias("_v"), top.alias("_p"))
    depth = marked.withColumn("_dd", F.col("_v") / F.col("_p.v") - 1)
    low = depth.groupBy(*keys).agg(F.min(F.struct(F.col("_dd").alias("dd"), F.col(on).alias("t"),
                                                  F.date_from_unix_date((-F.col("_p.d")).cast("int")).alias("p"))).alias("_x"))
    return low.select(*keys, F.col("_x.p").alias("peak_date"), F.col("_x.t").alias("trough_date"),
                      F.col("_x.dd").alias("max_dd"))


def reconcile_returns(aligned: DataFrame, a: str = "local_return", b: str = "ext_return",
                      keys: Sequence[str] = ()) -> DataFrame:
    """Correlation, R², mean, absolute and squared difference of two return series."""
    d = F.col(b) - F.col(a)
    return aligned.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("months"), correlation(a, b).alias("correlation"), F.pow(correlation(a, b), 2).alias("r_squared"),
        F.avg(d).alias("mean_diff"), F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"))


def series_metrics(series: DataFrame, ret: str, keys: Sequence[str] = (), order: str = "month") -> DataFrame:
    """Months, growth rate, strict Sharpe and drawdown of one return column."""
    from panelspark.operators.ledger import equity_curve
    rows = series.where(F.col(ret).isNotNull())
    curve = equity_curve(rows, keys, ret, order)
    out = curve.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("months"), compound(ret).alias("_e"), strict_sharpe(ret).alias("sharpe"),
        F.min("drawdown").alias("max_dd"))
    return out.withColumn("cagr", annualised(F.col("_e"), F.col("months"))).drop("_e")


def daily_sharpe(daily: DataFrame, value: str = "equity", on: str = "Date", year: int = 252) -> DataFrame:
    """Naive annualised Sharpe of one curve's daily changes."""
    w = Window.partitionBy().orderBy(on)
    steps = daily.select((F.col(value) / F.lag(value, 1).over(w) - 1).alias("r")).where("r IS NOT NULL")
    return steps.agg((F.avg("r") / F.nullif(F.stddev_samp("r"), F.lit(0.0)) * F.sqrt(F.lit(float(year)))).alias("daily_sharpe"))


def buy_hold(bars: DataFrame, start: str | None = None, end: str | None = None, keys: Sequence[str] = ("ticker",)) -> DataFrame:
    """Growth rate of holding each ticker over a window, on calendar days."""
    from panelspark.sources.bars import slice_dates
    rows = slice_dates(bars, start, end)
    ends = rows.groupBy(*keys).agg(
        F.min("Date").alias("first_date"), F.max("Date").alias("last_date"),
        (F.max_by("Close", "Date") / F.min_by("Close", "Date")).alias("growth"))
    years = F.datediff("last_date", "first_date") / F.lit(365.25)
    return ends.withColumn("cagr", F.when(years > 0, F.pow("growth", 1 / F.nullif(years, F.lit(0.0))) - 1))


def sweep_summary(ledger: DataFrame, levels: Sequence[str] = ("cost_bps",), fold: str = "fold",
                  null_means: DataFrame | None = None) -> DataFrame:
    """Stitched curve statistics per level, means of the per-fold ones, mean net and,
    if given, the null's mean per level."""
    levels = list(levels)
    stitched = summarize(ledger.select(*levels, "d0", "net"), levels).withColumnRenamed("sharpe", "stitched_sharpe")
    folds = summarize(ledger, [*levels, fold]).groupBy(*levels).agg(
        F.avg("sharpe").alias("sharpe_mean"), F.avg("cagr").alias("fold_cagr_mean"))
    net = ledger.groupBy(*levels).agg(F.avg("net").alias("avg_net"))
    out = stitched.join(folds, levels).join(net, levels)
    return out if null_means is None else out.join(null_means, levels, "left")


def grade_summary(grades: DataFrame) -> DataFrame:
    return grades.groupBy("model").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("ret") > 0, 1.0).otherwise(0.0)).alias("hit_rate"),
        F.avg("ret").alias("mean_ret"), F.avg("excess").alias("mean_excess"))


def promotion_gate(trials: DataFrame, min_sharpe: float = 0.41, min_dd: float = -0.35) -> DataFrame:
    """Trials on the tune half that pass the bar."""
    return trials.withColumn("passed", (F.col("sharpe") > min_sharpe) & (F.col("max_dd") > min_dd))


def best_trial(trials: DataFrame, by: Sequence[str] = (), trial: str = "variant") -> DataFrame:
    """Highest Sharpe among the trials; ties take the smallest name."""
    best = F.min(F.struct((-F.col("sharpe")).alias("s"), F.col(trial).alias("t")))
    return trials.where(F.col("sharpe").isNotNull()).groupBy(*by).agg(best.alias("_b")).select(
        *by, F.col("_b.t").alias(trial), (-F.col("_b.s")).alias("sharpe"))


def validation_gate(candidate: DataFrame, control: DataFrame, tolerance: float = 0.02, keys: Sequence[str] = ()) -> DataFrame:
    """Candidate against control on their common dates, for each value of ``keys``: both growth and Sharpe must be
    higher, drawdown within tolerance."""
    on = [*keys, "d0"]
    both = candidate.select(*on, F.col("net").alias("cand")).join(control.select(*on, F.col("net").alias("ctrl")), on)
    sides = both.select(*on, F.explode(F.array(*[
        F.struct(F.lit(p).alias("side"), F.col(p).alias("net")) for p in ("cand", "ctrl")])).alias("_x")).select(
        *on, "_x.side", "_x.net")
    stats = summarize(sides, [*keys, "side"]).groupBy(*keys).agg(*[
        F.max(F.when(F.col("side") == p, F.col(c))).alias(f"{p}_{c}")
        for p in ("cand", "ctrl") for c in ("months", "cagr", "sharpe", "max_dd")])
    return stats.withColumn(
        "passed", (F.col("cand_cagr") > F.col("ctrl_cagr")) & (F.col("cand_sharpe") > F.col("ctrl_sharpe"))
        & (F.col("cand_max_dd") >= F.col("ctrl_max_dd") - tolerance))
