"""Selection and weighting rules.

A rule maps candidates (one row per key group, decision date ``d0`` and ticker) to a
book: the same keys with a signed ``weight``, the rest being cash. Fixed-size tops
use ``row_number() <= n``, which Spark prunes map-side before the shuffle, so a large
cross section never travels whole. Ties break by ticker.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.joins import asof_join
from panelspark.functions.ranks import average_rank, group_quantile, ordered_counts
from panelspark.functions.windows import calendar, decision_dates
from panelspark.session import materialize

KEYS = ("arm", "fold")


def candidates(scores: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Scored rows of each key group's decision dates. The decision list has one row
    per month and group."""
    dates = decision_dates(scores, keys).select(*keys, F.col("d0").alias("Date"), "month")
    return scores.join(F.broadcast(dates), [*keys, "Date"]).withColumnRenamed("Date", "d0")


def top_n(rows: DataFrame, n, keys: Sequence[str], score: str = "proba", most: int | None = None,
          ascending: bool = False) -> DataFrame:
    """The n best rows per (keys, d0) with their place ``rn``. ``n`` may be a column;
    ``most`` is then its largest value."""
    order = [F.asc(score), F.desc("ticker")] if ascending else [F.desc(score), F.asc("ticker")]
    w = Window.partitionBy(*keys, "d0").orderBy(*order)
    placed = rows.withColumn("rn", F.row_number().over(w))
    if isinstance(n, int):
        return placed.where(F.col("rn") <= n)
    return placed.where((F.col("rn") <= most) & (F.col("rn") <= n))


def equal_weight(picks: DataFrame, keys: Sequence[str], total: float = 1.0) -> DataFrame:
    """Equal weights over the picks of each decision."""
    counts = picks.groupBy(*keys, "d0").agg(F.count(F.lit(1)).alias("_n"))
    return (picks.select(*keys, "d0", "ticker").join(counts, [*keys, "d0"])
            .select(*keys, "d0", "ticker", (F.lit(total) / F.col("_n")).alias("weight")))


def _spread(picks: DataFrame, keys: Sequence[str], total=1.0) -> DataFrame:
    """Equal weights where the picks are already cut to a fixed size."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys, "d0"))
    return picks.withColumn("weight", F.lit(total) / n)


def pick_threshold(cands: DataFrame, thresh=0.30, n=10, keys: Sequence[str] = KEYS,
                   most: int | None = None) -> DataFrame:
    """Gate, then the n best, equal weight."""
    gate = F.col(thresh) if isinstance(thresh, str) else F.lit(thresh)
    picks = top_n(cands.where(F.col("proba") >= gate), n if isinstance(n, int) else F.col(n), keys, most=most)
    return _spread(picks.select(*keys, "d0", "ticker", "proba", "rn"), keys)


def pick_live(latest: DataFrame, thresh: float = 0.30, n: int = 20) -> DataFrame:
    """Frozen live rule on a scored latest slice (``d0``, ``ticker``, ``proba``)."""
    return pick_threshold(latest, thresh, n, keys=())


def exposure_at(decisions: DataFrame, vol: DataFrame, keys: Sequence[str], target: float) -> DataFrame:
    """min(1, target / trailing volatility) as of each decision; 1 where unknown."""
    known = asof_join(decisions.select(*keys, "d0").distinct(), vol.select(*keys, "Date", "uvol"),
                      keys, "d0", "Date", unique_left=True)
    return known.select(*keys, "d0", "uvol", F.when(
        F.col("uvol") > 0, F.least(F.lit(1.0), F.lit(target) / F.col("uvol"))).otherwise(1.0).alias("exposure"))


def pick_risk(cands: DataFrame, vol: DataFrame, thresh: float = 0.30, n: int = 20, min_names: int = 10,
              target: float = 0.20, keys: Sequence[str] = KEYS) -> DataFrame:
    """Breadth gate and volatility-scaled equal weights. The drawdown brake is
    path-dependent and applied by the ledger."""
    quals = cands.where(F.col("proba") >= thresh)
    broad = (quals.groupBy(*keys, "d0").agg(F.count(F.lit(1)).alias("_q"))
             .where(F.col("_q") >= min_names).select(*keys, "d0"))
    scale = exposure_at(broad, vol, keys, target)
    picks = top_n(quals, n, keys).select(*keys, "d0", "ticker", "proba", "rn")
    return (_spread(picks, keys).join(F.broadcast(scale), [*keys, "d0"])
            .withColumn("weight", F.col("weight") * F.col("exposure")))


def pick_long_short(cands: DataFrame, thresh: float = 0.30, longs: int = 10, shorts: int = 10,
                    keys: Sequence[str] = KEYS) -> DataFrame:
    """Dollar-neutral book: the best gated names against the worst; a name on both
    sides stays short; both sides are required."""
    base = cands.select(*keys, "d0", "ticker", "proba")
    worst = top_n(base.where(F.col("proba") <= 1 - thresh), shorts, keys, ascending=True)
    best = top_n(base.where(F.col("proba") >= thresh), longs, keys).join(
        worst.select(*keys, "d0", "ticker"), [*keys, "d0", "ticker"], "left_anti")
    both = best.withColumn("side", F.lit(1)).unionByName(worst.withColumn("side", F.lit(-1)))
    whole = Window.partitionBy(*keys, "d0")
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys, "d0", "side"))
    sides = F.max("side").over(whole) - F.min("side").over(whole)
    return both.select(*keys, "d0", "ticker", "proba", n.alias("_n"), "side", sides.alias("_s")).where("_s = 2").select(
        *keys, "d0", "ticker", "proba", (F.lit(0.5) * F.col("side") / F.col("_n")).alias("weight"))


def _position(rows: DataFrame, by: Sequence[str], order) -> DataFrame:
    """Place of each row in its group under ``order`` and the group's ``size``, for
    groups of any size."""
    keyed = rows.withColumn("_o", order)
    places = ordered_counts(keyed, by, "_o").select(
        *by, "_o", (F.col("below") + 1).alias("place"), F.col("total").alias("size"))
    return keyed.join(places, [*by, "_o"]).drop("_o")


def pick_momentum(mom: DataFrame, decile: float = 0.10, cap_order: str | None = "ticker",
                  min_names: int = 10) -> DataFrame:
    """Names at or above the top-decile cutoff, equal weight.

    ``cap_order`` truncates ties at the cutoff to max(5, floor(share * n) + 1) names in
    ``ticker`` or ``score`` order; None leaves the set uncapped.
    """
    cut = group_quantile(mom, ["d0"], "mom", 1 - decile, "cut").where(F.col("total") >= min_names)
    picks = mom.join(F.broadcast(cut), "d0").where(F.col("mom") >= F.col("cut"))
    if cap_order is None:
        sizes = picks.groupBy("d0").agg(F.count(F.lit(1)).alias("size"))
        return picks.join(F.broadcast(sizes), "d0").select("d0", "ticker", "mom", (F.lit(1.0) / F.col("size")).alias("weight"))
    cap = F.greatest(F.lit(5), F.floor(F.col("total") * F.lit(decile)) + 1)
    order = F.struct("ticker") if cap_order == "ticker" else F.struct((-F.col("mom")).alias("s"), F.col("ticker"))
    kept = _position(picks.withColumn("_cap", cap), ["d0"], order).where(F.col("place") <= F.col("_cap"))
    return kept.select("d0", "ticker", "mom", (F.lit(1.0) / F.least("size", "_cap")).alias("weight"))


def pick_momentum_live(mom: DataFrame, decile: float = 0.10, min_picks: int = 5) -> DataFrame:
    """Uncapped decile; cash when fewer than ``min_picks`` names reach it."""
    cut = group_quantile(mom, ["d0"], "mom", 1 - decile, "cut")
    picks = mom.join(F.broadcast(cut), "d0").where(F.col("mom") >= F.col("cut"))
    enough = picks.groupBy("d0").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_picks)
    return picks.join(F.broadcast(enough), "d0").select(
        "d0", "ticker", "mom", (F.lit(1.0) / F.col("_n")).alias("weight"))


def pick_momentum_topk(own: DataFrame, min_names: int = 10, share: float = 0.10) -> DataFrame:
    """The max(5, floor(share * n) + 1) strongest names on the row clock
    (``d0``, ``ticker``, ``mom``), equal weight."""
    ready = own.where(F.col("mom").isNotNull())
    sizes = (ready.groupBy("d0").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_names)
             .select("d0", F.greatest(F.lit(5), F.floor(F.col("_n") * F.lit(share)) + 1).alias("_cap")))
    kept = _position(ready.join(F.broadcast(sizes), "d0"), ["d0"],
                     F.struct((-F.col("mom")).alias("s"), F.col("ticker"))).where(F.col("place") <= F.col("_cap"))
    return kept.select("d0", "ticker", "mom", (F.lit(1.0) / F.least("size", "_cap")).alias("weight"))


def liquid_universe(bars: DataFrame, n: int = 200, min_price: float = 5.0, min_dv: float = 500_000.0) -> DataFrame:
    """The n most traded names per date above a price and a dollar-volume floor."""
    dv = bars.select("ticker", F.col("Date").alias("d0"), "Close", (F.col("Close") * F.col("Volume")).alias("dv"))
    return top_n(dv.where((F.col("Close") > min_price) & (F.col("dv") > min_dv)), n, [], score="dv")


def blend_scores(cands: DataFrame, mom: DataFrame, ml_weight: float, fill: float | None,
                 keys: Sequence[str] = KEYS) -> DataFrame:
    """Average percentile ranks: the model's over the candidates, momentum's over the
    whole grid; missing momentum takes ``fill`` or drops the row."""
    grid = average_rank(mom, ["d0"], "mom", "mom_rank", pct=True).select("d0", "ticker", "mom_rank")
    base = cands.select(*keys, "d0", "ticker", "proba")
    ranked = average_rank(base, [*keys, "d0"], "proba", "ml_rank", pct=True)
    joined = ranked.join(grid, ["d0", "ticker"], "left" if fill is not None else "inner")
    mom_rank = F.coalesce("mom_rank", F.lit(fill)) if fill is not None else F.col("mom_rank")
    return joined.withColumn("mom_rank", mom_rank).withColumn(
        "score", F.lit(ml_weight) * F.col("ml_rank") + F.lit(1 - ml_weight) * F.col("mom_rank"))


def pick_blend(blended: DataFrame, n: int = 20, keys: Sequence[str] = KEYS, consensus: float | None = None) -> DataFrame:
    """The n best blended scores, equal weight; ``consensus`` first requires both ranks
    to reach it."""
    rows = blended
    if consensus is not None:
        rows = rows.where((F.col("ml_rank") >= consensus) & (F.col("mom_rank") >= consensus))
    picks = top_n(rows.select(*keys, "d0", "ticker", "score"), n, keys, score="score")
    return _spread(picks, keys)


def pick_liquid(cands: DataFrame, dv: DataFrame, min_dv: float = 500_000.0) -> DataFrame:
    """Candidates whose trailing dollar volume on the decision date reaches the floor."""
    liquid = dv.where(F.col("dv") >= min_dv).select("ticker", F.col("Date").alias("d0"), "dv")
    return cands.join(liquid, ["ticker", "d0"])


def weight_inverse_vol(picks: DataFrame, vol: DataFrame, keys: Sequence[str] = KEYS,
                       fallback: str = "equal") -> DataFrame:
    """Scale the book by inverse trailing volatility. Names without one get 0; when no
    name has one the book stays equal (``equal``) or earns nothing (``zero``).

    Each decision holds a fixed number of picks, so the windows are small.
    """
    known = vol.select("ticker", F.col("Date").alias("d0"), "vol")
    joined = picks.join(known, ["ticker", "d0"], "left")
    whole = Window.partitionBy(*keys, "d0")
    inverse = F.when(F.col("vol") > 0, 1 / F.col("vol")).otherwise(0.0)
    gross = F.sum("weight").over(whole)
    scaled = joined.select("*", inverse.alias("_inv"), gross.alias("_gross")).withColumn(
        "_total", F.sum("_inv").over(whole))
    empty = F.col("weight") if fallback == "equal" else F.lit(0.0)
    return scaled.withColumn("weight", F.when(
        F.col("_total") > 0, F.col("_gross") * F.col("_inv") / F.nullif(F.col("_total"), F.lit(0.0))
    ).otherwise(empty)).drop("_inv", "_gross", "_total")


def pick_sticky(cands: DataFrame, days: int = 40, thresh: float = 0.30, n: int = 10,
                keys: Sequence[str] = KEYS) -> DataFrame:
    """Keep names that were fresh picks less than ``days`` calendar days ago, oldest
    first pick first, then add fresh ones, n names in all.

    A pick can only reach the months its age allows, so each fresh pick is repeated
    into those months and met by equality instead of a range join.
    """
    fresh = top_n(cands.where(F.col("proba") >= thresh), n, keys).select(
        *keys, "d0", "month", "ticker", "proba", "rn")
    w = Window.partitionBy(*keys, "ticker").orderBy("d0").rowsBetween(Window.unboundedPreceding, 0)
    first = F.min(F.struct(F.col("d0").alias("d"), F.col("rn").alias("r"))).over(w)
    marked = fresh.withColumn("_first", first)
    ahead = range(1, (days + 27) // 28 + 1)
    reach = F.explode(F.array(*[F.add_months("month", k) for k in ahead]))
    dates = cands.select(*keys, "month", "d0").distinct()
    held = (marked.select(*keys, F.col("d0").alias("since"), "ticker", "_first", reach.alias("month"))
            .join(F.broadcast(dates), [*keys, "month"])
            .where(F.datediff("d0", "since") < days)
            .groupBy(*keys, "d0", "ticker").agg(F.max_by("_first", "since").alias("_first")))
    old = held.select(*keys, "d0", "ticker", F.lit(0).alias("_new"), "_first")
    new = (fresh.join(held.select(*keys, "d0", "ticker"), [*keys, "d0", "ticker"], "left_anti")
           .select(*keys, "d0", "ticker", F.lit(1).alias("_new"),
                   F.struct(F.col("d0").alias("d"), F.col("rn").alias("r")).alias("_first")))
    order = Window.partitionBy(*keys, "d0").orderBy("_new", "_first")
    kept = old.unionByName(new).withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= n)
    return _spread(kept, keys).select(*keys, "d0", "ticker", F.col("_new").alias("fresh"), "rn", "weight")


def pick_trend(signal: DataFrame, bars: DataFrame, stride: int = 1) -> DataFrame:
    """Equal weight of assets above their mean; only every ``stride``-th month decides,
    the months between carry its book, wherever that month had a signal."""
    months = decision_dates(bars).select("d0", (F.col("m") - 1).alias("i"))
    deciders = months.where(F.col("i") % stride == 0).select(F.col("d0").alias("src"), F.col("i").alias("_i"))
    plan = (months.withColumn("_i", F.col("i") - F.col("i") % stride).join(F.broadcast(deciders), "_i")
            .select("d0", "src"))
    ready = signal.select(F.col("Date").alias("d0")).distinct()
    plan = plan.join(ready, "d0", "left_semi")
    held = signal.where("above").select(F.col("Date").alias("src"), "ticker")
    return equal_weight(held.join(F.broadcast(plan), "src").select("d0", "ticker"), [])


def pick_quality(bars: DataFrame, fund: DataFrame, share: float = 0.5) -> DataFrame:
    """Upper share of names by return on equity as filed, among those with a price on the
    decision date, equal weight."""
    dates = decision_dates(bars).select(F.col("d0").alias("Date"))
    rows = bars.join(F.broadcast(dates), "Date").select("ticker", F.col("Date").alias("d0"))
    filed = fund.where(F.col("bvps") > 0).select("ticker", "filed_date", (F.col("eps_ttm") / F.col("bvps")).alias("roe"))
    known = materialize(asof_join(rows, filed, ["ticker"], "d0", "filed_date", unique_left=True).where("roe IS NOT NULL"))
    ranked = average_rank(known, ["d0"], "roe", "pct", pct=True).where(F.col("pct") >= share)
    return equal_weight(ranked, [])


def boundary(cands: DataFrame, thresh: float, n: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Picks and the effective boundary: the gate, or the n-th score of a full book."""
    picks = top_n(cands.where(F.col("proba") >= thresh), n, keys)
    size = F.count(F.lit(1))
    return picks.groupBy(*keys, "d0").agg(
        F.sort_array(F.collect_list("ticker")).alias("picks"),
        F.when(size == n, F.greatest(F.lit(thresh), F.min("proba"))).otherwise(F.lit(thresh)).alias("boundary"))


def variants(cands: DataFrame, params: list[dict], keys: Sequence[str] = KEYS) -> DataFrame:
    """Candidates once per parameter row; every variant is then scored in one plan.
    The parameter list is a literal array, so no join is involved."""
    rows = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in p.items()]) for p in params])
    return cands.select("*", F.explode(rows).alias("_p")).select(
        *cands.columns, *[F.col(f"_p.{k}").alias(k) for k in params[0]])


def evaluated_sessions(bars: DataFrame, lookback: int) -> DataFrame:
    """Dates with at least ``lookback`` sessions of history, inclusive."""
    return calendar(bars).where(F.col("ord") >= lookback).select(F.col("Date").alias("d0"))
