"""Ranks and quantiles over groups of any size.

A cross section (all tickers on one date, all scored rows of one fold) has no
size bound, so it is never sorted in a single window partition. ``ordered_counts``
collapses ties first, range-partitions the distinct values of all groups together and
takes the partition as the slot: slots are of about equal size whatever the groups'
sizes are, and there are as many as the data fill. Values are then sorted inside the
slots and the running slot totals are added. Results do not depend on where a group
is cut.

The slotted counts are written once (see ``session.materialize``), so the cuts are the
same for both branches that read them, also after a lost executor.

``value`` must be a deterministic expression of the input; materialize first when it
is not (for instance freshly fitted model scores).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.session import materialize

def ordered_counts(df: DataFrame, by: Sequence[str], value: str, **more: Column) -> DataFrame:
    """One row per distinct non-null value: ``n`` rows hold it, ``below`` rows hold
    a smaller one, ``total`` rows are in the group; ``more`` are further aggregates of its rows."""
    by = list(by)
    counts = (df.where(F.col(value).isNotNull())
              .groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in more.items()]))
    slotted = materialize(counts.repartitionByRange(*by, value).select(
        *by, value, "n", *more, F.spark_partition_id().alias("_slot")))
    inside = Window.partitionBy(*by, "_slot").orderBy(value)
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    slots = Window.partitionBy(*by).orderBy("_slot")
    totals = slotted.groupBy(*by, "_slot").agg(F.sum("n").alias("_m"))
    offsets = totals.select(
        *by, "_slot",
        (F.sum("_m").over(slots) - F.col("_m")).alias("_before"),
        F.sum("_m").over(Window.partitionBy(*by)).alias("total"))
    return (slotted.withColumn("_run", F.sum("n").over(running))
            .join(offsets, [*by, "_slot"])
            .select(*by, value, "n", *more,
                    (F.col("_before") + F.col("_run") - F.col("n")).alias("below"), "total"))


def average_rank(df: DataFrame, by: Sequence[str], value: str, out: str, pct: bool = False) -> DataFrame:
    """Attach the average rank of ``value`` within ``by`` (null values rank null);
    ``pct`` divides by the non-null count of the group."""
    keys = list(by)
    counts = ordered_counts(df, keys, value)
    rank = F.col("below") + (F.col("n") + F.lit(1)) / F.lit(2.0)
    lookup = counts.select(*keys, value, (rank / F.col("total") if pct else rank).alias(out))
    return df.join(lookup, [*keys, value], "left").select(*df.columns, out)


def share_cut(df: DataFrame, by: Sequence[str], value: str, share: float, out: str = "cut") -> DataFrame:
    """The smallest value of each group whose average rank, as a share of the group, is at least ``share``.

    Average ranks rise with the value, so a row ranks there exactly where its value is not below the cut: one row
    per group goes back to the rows in place of a rank per value.
    """
    rank = (F.col("below") + (F.col("n") + F.lit(1)) / F.lit(2.0)) / F.col("total")
    return ordered_counts(df, by, value).where(rank >= share).groupBy(*by).agg(F.min(value).alias(out))


def bounded_rank(by: Sequence[str], value: str) -> Column:
    """Average rank as a plain window, for groups with a proven size bound such as
    the months of one strategy."""
    ordered = Window.partitionBy(*by).orderBy(value)
    ties = Window.partitionBy(*by, value)
    return F.when(F.col(value).isNotNull(),
                  F.rank().over(ordered) - F.count(F.when(F.col(value).isNull(), 1)).over(Window.partitionBy(*by))
                  + (F.count(F.lit(1)).over(ties) - 1) / F.lit(2.0))


def group_quantile(df: DataFrame, by: Sequence[str], value: str, q: float, out: str = "q") -> DataFrame:
    """Exact linear-interpolation quantile per group, with the group's ``total``."""
    keys = list(by)
    counts = ordered_counts(df, keys, value)
    spot = F.lit(float(q)) * (F.col("total") - 1)
    upto = F.col("below") + F.col("n")
    result = counts.groupBy(*keys, "total").agg(
        F.min(F.when(upto > F.floor(spot), F.col(value))).alias("_lo"),
        F.min(F.when(upto > F.ceil(spot), F.col(value))).alias("_hi"))
    value_at = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (spot - F.floor(spot))
    return result.select(*keys, "total", value_at.alias(out))
