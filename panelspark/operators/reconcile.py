"""Comparison of the local ledger with an external engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions.columns import correlation, month_key, realized_month
from panelspark.functions.joins import beside, set_overlap
from panelspark.operators.evaluate import (daily_sharpe, drawdown_dates, month_last, reconcile_returns,
                                           series_metrics)
from panelspark.operators.ledger import equity_curve, period_change


def local_monthly(ledger: DataFrame) -> DataFrame:
    """Net returns under the month in which they realise."""
    return ledger.select(month_key(realized_month("d0")).alias("month"), F.col("net").alias("local_return"))


def external_monthly(daily: DataFrame) -> DataFrame:
    """Month-end changes of the external equity, the first month null."""
    return period_change(month_last(daily, "equity"), "equity", out="ext_return").select("month", "ext_return")


def last_complete_month(daily: DataFrame) -> Column:
    """The newest month whose last weekday the daily series has reached."""
    last = F.max("Date")
    step = F.when(F.weekday(last) == 4, 3).when(F.weekday(last) == 5, 2).otherwise(1)
    return daily.agg(F.add_months(F.trunc(F.date_add(last, step), "month"), -1)).scalar()


def align_returns(ledger: DataFrame, daily: DataFrame, complete_through: str | Column | None = None) -> DataFrame:
    """Common months with the difference; months after ``complete_through`` are flagged
    as partial."""
    both = local_monthly(ledger).join(external_monthly(daily), "month").where(F.col("ext_return").isNotNull())
    complete = F.lit(True) if complete_through is None else F.col("month") <= F.lit(complete_through).cast("date")
    return both.withColumn("complete", complete).withColumn("difference", F.col("ext_return") - F.col("local_return"))


def local_pick_sets(book: DataFrame) -> DataFrame:
    return book.groupBy(month_key(realized_month("d0")).alias("month")).agg(
        F.sort_array(F.collect_set("ticker")).alias("local_picks"), F.count(F.lit(1)).alias("local_n"))


def reconcile_picks(local: DataFrame, external: DataFrame) -> DataFrame:
    """Overlap of both pick sets per realised month."""
    overlap = set_overlap(F.col("ext_picks"), F.col("local_picks"))
    return local.join(external, "month").select(
        "month", "ext_picks", "local_picks", "ext_n", "local_n", *[c.alias(k) for k, c in overlap.items()])


def attribute_differences(aligned: DataFrame, picks: DataFrame) -> DataFrame:
    """Error in months with equal and unequal picks, and its correlation with mismatch."""
    rows = aligned.where("complete").join(picks.select("month", "jaccard", "exact_match"), "month")
    gap = F.abs(F.col("difference"))
    return rows.agg(
        F.count(F.lit(1)).alias("months"), F.avg(F.when(F.col("exact_match"), gap)).alias("mae_exact"),
        F.avg(F.when(~F.col("exact_match"), gap)).alias("mae_inexact"),
        correlation(gap, 1 - F.col("jaccard")).alias("mismatch_corr"))


def pick_summary(picks: DataFrame) -> DataFrame:
    return picks.agg(
        F.count(F.lit(1)).alias("months"), F.avg("jaccard").alias("mean_jaccard"),
        F.percentile("jaccard", 0.5).alias("median_jaccard"), F.avg("intersection_n").alias("mean_intersection"),
        F.count_if("exact_match").alias("exact_months"))


def reconcile(ledger: DataFrame, daily: DataFrame, complete_through: str | None = None) -> DataFrame:
    """One-row report: matched months, both engines' metrics and drawdown dates."""
    aligned = align_returns(ledger, daily, complete_through).where("complete")
    metrics = [series_metrics(aligned, f"{p}_return").select(*[
        F.col(c).alias(f"{p}_{c}") for c in ("cagr", "sharpe", "max_dd")]) for p in ("local", "ext")]
    local_curve = equity_curve(ledger.select("d0", "net")).select(F.col("d0").alias("Date"), "equity")
    deep = [drawdown_dates(c).select(*[F.col(x).alias(f"{p}_{x}") for x in ("peak_date", "trough_date")],
                                     F.col("max_dd").alias(f"{p}_curve_dd"))
            for c, p in ((local_curve, "local"), (daily.select("Date", "equity"), "ext"))]
    return beside(reconcile_returns(aligned), *metrics, *deep, daily_sharpe(daily))
