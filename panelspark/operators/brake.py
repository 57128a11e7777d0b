"""Path-dependent rules, folded per key over an array of months.

A key holds the months of one (strategy, arm, fold, cost); keys run in parallel and the
fold stays inside Spark's higher-order functions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONTH = "struct<d0:date,exposure:double,gross:double,turnover:double,cost:double,net:double,equity:double,peak:double>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once inside an expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def map_turnover(before: Column, after: Column) -> Column:
    moves = F.map_values(F.map_zip_with(
        before, after, lambda _k, a, b: F.abs(F.coalesce(b, F.lit(0.0)) - F.coalesce(a, F.lit(0.0)))))
    return F.lit(0.5) * F.aggregate(moves, F.lit(0.0), lambda s, v: s + v)


def brake_ledger(books: DataFrame, gross: DataFrame, decisions: DataFrame, costs: Sequence[float],
                 keys: Sequence[str], brake: float = 0.15, cut: float = 0.5) -> DataFrame:
    """Ledger in which exposure is cut while the equity is more than ``brake`` below its
    peak, feeding back into weights, turnover and net.

    ``books`` hold a fixed number of names per decision; ``gross`` is the unbraked gross
    per decision.
    """
    keys = list(keys)
    maps = books.groupBy(*keys, "d0").agg(
        F.map_from_entries(F.collect_list(F.struct("ticker", "weight"))).alias("w"))
    months = (decisions.select(*keys, "d0").distinct().join(maps, [*keys, "d0"], "left")
              .join(gross.select(*keys, "d0", "gross"), [*keys, "d0"], "left")
              .select(*keys, F.struct(
                  "d0", F.coalesce("gross", F.lit(0.0)).alias("gross"),
                  F.coalesce("w", F.expr("cast(map() as map<string,double>)")).alias("w")).alias("x")))
    paths = months.groupBy(*keys).agg(F.collect_list("x").alias("xs")).withColumn(
        "xs", F.array_sort("xs", lambda a, b: F.datediff(a["d0"], b["d0"]))).withColumn(
        "cost_bps", F.explode(F.array(*[F.lit(float(c)) for c in costs])))
    start = F.struct(F.lit(1.0).alias("equity"), F.lit(1.0).alias("peak"),
                     F.expr("cast(map() as map<string,double>)").alias("w"),
                     F.expr(f"cast(array() as array<{MONTH}>)").alias("out"))
    bps = F.col("cost_bps") / F.lit(1e4)

    def step(acc: Column, x: Column) -> Column:
        low = acc["equity"] / acc["peak"] - 1 < F.lit(-float(brake))
        return let(F.when(low, F.lit(cut)).otherwise(F.lit(1.0)), lambda f: let(
            F.transform_values(x["w"], lambda _k, v: v * f), lambda w: let(
                map_turnover(acc["w"], w), lambda t: let(
                    x["gross"] * f - t * bps, lambda net: let(
                        acc["equity"] * (1 + net), lambda eq: let(
                            F.greatest(acc["peak"], eq), lambda peak: F.struct(
                                eq.alias("equity"), peak.alias("peak"), w.alias("w"),
                                F.concat(acc["out"], F.array(F.struct(
                                    x["d0"].alias("d0"), f.alias("exposure"), (x["gross"] * f).alias("gross"),
                                    t.alias("turnover"), (t * bps).alias("cost"), net.alias("net"),
                                    eq.alias("equity"), peak.alias("peak")))).alias("out"))))))))

    folded = paths.select(*keys, "cost_bps", F.inline(F.aggregate("xs", start, step, lambda acc: acc["out"])))
    return folded.withColumn("drawdown", F.col("equity") / F.col("peak") - 1)
