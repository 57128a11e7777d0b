"""Agreement of two scored caches at month decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.columns import DISTANCE_LABELS, correlation, distance_bin
from panelspark.functions.joins import set_overlap
from panelspark.functions.ranks import average_rank
from panelspark.functions.windows import decision_dates, gated
from panelspark.operators.select import boundary
from panelspark.session import materialize


def decision_rows(common: DataFrame) -> DataFrame:
    """Common rows of the last date of each month (``d0``)."""
    dates = decision_dates(common).select(F.col("d0").alias("Date"))
    return common.join(F.broadcast(dates), "Date", "left_semi").withColumnRenamed("Date", "d0")


def selections(rows: DataFrame, thresh: float, n: int) -> DataFrame:
    """Picks and boundary of both arms per decision. Picks hold at most n names."""
    out = None
    for arm in ("left", "right"):
        side = boundary(rows.select("d0", "ticker", F.col(f"proba_{arm}").alias("proba")), thresh, n, keys=()).select(
            "d0", F.col("picks").alias(f"{arm}_picks"), F.col("boundary").alias(f"{arm}_boundary"))
        out = side if out is None else out.join(side, "d0", "full")
    spine = rows.select("d0").distinct()
    empty = F.expr("cast(array() as array<string>)")
    return spine.join(out, "d0", "left").select(
        "d0", *[F.coalesce(f"{a}_picks", empty).alias(f"{a}_picks") for a in ("left", "right")],
        *[F.coalesce(f"{a}_boundary", F.lit(thresh)).alias(f"{a}_boundary") for a in ("left", "right")])


def monthly_stability(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """Sizes, overlap, rank correlation and mean probability change per decision."""
    ranked = average_rank(average_rank(rows, ["d0"], "proba_left", "_a"), ["d0"], "proba_right", "_b")
    stats = ranked.groupBy("d0").agg(
        correlation("_a", "_b").alias("rank_spearman"),
        F.avg(F.abs(F.col("proba_left") - F.col("proba_right"))).alias("mean_abs_change"))
    overlap = set_overlap(F.col("left_picks"), F.col("right_picks"))
    return chosen.join(stats, "d0").select(
        "d0", F.size("left_picks").alias("left_n"), F.size("right_picks").alias("right_n"),
        *[c.alias(k) for k, c in overlap.items()], "rank_spearman", "left_boundary", "right_boundary",
        "mean_abs_change")


def security_distance(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """Per security: membership in both arms and mean distance to the boundaries. The
    joined side has one row per decision month."""
    joined = rows.join(F.broadcast(chosen), "d0")
    left, right = [F.array_contains(f"{a}_picks", F.col("ticker")) for a in ("left", "right")]
    gap = F.lit(0.5) * (F.abs(F.col("proba_left") - F.col("left_boundary"))
                        + F.abs(F.col("proba_right") - F.col("right_boundary")))
    return joined.select("d0", "ticker", "proba_left", "proba_right", left.alias("in_left"), right.alias("in_right"),
                         (left != right).alias("changed"), gap.alias("distance"),
                         distance_bin(gap).alias("distance_bin"))


def by_distance(securities: DataFrame) -> DataFrame:
    """Disagreement per distance bin, empty bins kept."""
    spark = securities.sparkSession
    bins = spark.createDataFrame([(i, b) for i, b in enumerate(DISTANCE_LABELS)], "pos INT, distance_bin STRING")
    counts = securities.groupBy("distance_bin").agg(
        F.count(F.lit(1)).alias("names"), F.count_if(F.col("changed")).alias("changed"))
    return bins.join(counts, "distance_bin", "left").select(
        "pos", "distance_bin", F.coalesce("names", F.lit(0)).alias("names"),
        F.coalesce("changed", F.lit(0)).alias("changed"),
        (F.col("changed") / F.col("names")).alias("disagreement_rate"))


def stability_summary(monthly: DataFrame) -> DataFrame:
    """One row over the decision months; empty unions do not enter the overlap."""
    q = F.percentile
    return monthly.agg(
        F.count(F.lit(1)).alias("months"), F.count("jaccard").alias("nonempty_months"),
        F.avg("jaccard").alias("mean_jaccard"), q("jaccard", 0.5).alias("median_jaccard"),
        q("jaccard", 0.1).alias("p10_jaccard"), q("jaccard", 0.9).alias("p90_jaccard"),
        F.count_if(F.col("exact_match") & F.col("jaccard").isNotNull()).alias("exact_months"),
        F.avg("rank_spearman").alias("mean_spearman"), q("rank_spearman", 0.5).alias("median_spearman"),
        F.avg("left_n").alias("mean_left_n"), F.avg("right_n").alias("mean_right_n"))


def rolling_overlap(monthly: DataFrame, window: int = 12, need: int = 3) -> DataFrame:
    """Rolling mean overlap over the decision months of one comparison."""
    return monthly.select("d0", "jaccard", gated(
        F.avg, F.col("jaccard"), window, Window.partitionBy().orderBy("d0"), need).alias("rolling"))


def stability(common: DataFrame, thresh: float = 0.25, n: int = 20) -> tuple[DataFrame, DataFrame]:
    """Monthly and distance tables of two aligned caches."""
    rows = materialize(decision_rows(common))
    chosen = materialize(selections(rows, thresh, n))
    return monthly_stability(rows, chosen), by_distance(security_distance(rows, chosen))
