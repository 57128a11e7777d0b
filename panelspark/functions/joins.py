"""As-of joins, set comparisons and series alignment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], left_on: str, right_on: str,
              unique_left: bool = False) -> DataFrame:
    """Backward as-of join: each left row takes the latest right row of its key
    with ``right_on <= left_on``.

    The fill runs over the distinct (key, day) pairs, so a key's window is bounded
    by the days it covers, however many rows share a day. ``unique_left`` states
    that the left side already has one row per (key, day) and saves the join back.
    """
    by = list(by)
    payload = [c for c in right.columns if c not in by]
    facts = (right.where(F.col(right_on).isNotNull())
             .groupBy(*by, F.col(right_on).alias("_t"))
             .agg(F.max(F.struct(*payload)).alias("_fact")))
    probe_cols = left.columns if unique_left else [*by, left_on]
    probe = left if unique_left else left.select(*by, left_on).distinct()
    carried = [c for c in probe_cols if c not in by]
    rows = (probe.select(*by, F.col(left_on).alias("_t"), F.lit(1).alias("_tag"), F.struct(*carried).alias("_row"))
            .unionByName(facts.select(*by, "_t", F.lit(0).alias("_tag"), "_fact"), allowMissingColumns=True))
    past = (Window.partitionBy(*by).orderBy("_t", "_tag")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    filled = (rows.withColumn("_fact", F.last("_fact", ignorenulls=True).over(past))
              .where(F.col("_tag") == 1)
              .select(*by, *[F.col("_row")[c].alias(c) for c in carried],
                      *[F.col("_fact")[c].alias(c) for c in payload]))
    if unique_left:
        return filled
    return left.join(filled, [*by, left_on], "left")


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """True when both tables hold the same rows, counting copies."""
    cols = a.columns
    other = b.select(*cols)
    return a.exceptAll(other).isEmpty() and other.exceptAll(a).isEmpty()


def set_overlap(left: Column, right: Column, empty: float | None = None) -> dict[str, Column]:
    """Sizes, Jaccard and equality of two pick arrays; ``empty`` is the Jaccard of
    two empty sets."""
    both, either = F.size(F.array_intersect(left, right)), F.size(F.array_union(left, right))
    return {
        "intersection_n": both.cast("bigint"),
        "union_n": either.cast("bigint"),
        "jaccard": F.when(either > 0, both / F.nullif(either, F.lit(0))).otherwise(F.lit(empty).cast("double")),
        "exact_match": F.array_sort(left) == F.array_sort(right),
    }


def beside(one: DataFrame, *others: DataFrame) -> DataFrame:
    """One-row tables side by side, as scalar subqueries rather than a cross join."""
    out, names = one, list(one.columns)
    for i, other in enumerate(others):
        row = other.select(F.struct(*other.columns)).scalar()
        out = out.select(*names, row.alias("_row")).select(*names, *[F.col("_row")[c].alias(c) for c in other.columns])
        names += other.columns
    return out


def overlap_by_count(left: DataFrame, right: DataFrame, keys: Sequence[str], name: str = "ticker",
                     empty: float | None = None) -> DataFrame:
    """Sizes, Jaccard and equality of the two sets of ``name`` under each value of ``keys``, whatever the sets' size.

    Rows are tagged with their side and counted twice: a name's sides, then a key's names; no set is gathered. Keys that
    either side has are kept; repeated names count once; ``empty`` is the Jaccard of two empty sets (keys with null names).
    """
    tagged = left.select(*keys, name, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(
        right.select(*keys, name, F.lit(0).alias("_l"), F.lit(1).alias("_r")))
    names = tagged.groupBy(*keys, name).agg(F.max("_l").alias("_l"), F.max("_r").alias("_r"))
    some = F.col(name).isNotNull().cast("int")
    sums = names.groupBy(*keys).agg(
        F.sum(some * F.col("_l")).alias("left_n"), F.sum(some * F.col("_r")).alias("right_n"),
        F.sum(some * F.col("_l") * F.col("_r")).alias("intersection_n"), F.sum(some).alias("union_n"))
    return sums.withColumns({
        "jaccard": F.when(F.col("union_n") > 0, F.col("intersection_n") / F.nullif(F.col("union_n"), F.lit(0))).otherwise(
            F.lit(empty).cast("double")),
        "exact_match": F.col("intersection_n") == F.col("union_n")})
