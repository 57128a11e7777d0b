"""Turnover, leg returns and the month ledger.

Books are long tables (keys, ``d0``, ``ticker``, signed ``weight``); decisions list
every evaluated date, cash months included.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.joins import asof_join
from panelspark.functions.ranks import ordered_counts
from panelspark.functions.windows import calendar
from panelspark.session import materialize

HORIZON = 20


def check_stop(stop: float | None) -> None:
    if stop is not None and not 0.0 < stop < 1.0:
        raise ValueError(f"stop must lie in (0, 1) or be None, got {stop}")


def number_decisions(decisions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Running number of the evaluated decisions; skipped months leave no hole."""
    w = Window.partitionBy(*keys).orderBy("d0")
    return decisions.select(*keys, "d0").distinct().withColumn("m", F.row_number().over(w))


def turnover(books: DataFrame, decisions: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Half the L1 change between consecutive evaluated books; the first one trades
    against cash.

    Each weight is emitted once for its own month and once, negated, for the next, so
    one aggregation on (keys, month, ticker) replaces a self outer join.
    """
    keys = list(keys)
    numbered = number_decisions(decisions, keys)
    moves = (books.join(F.broadcast(numbered), [*keys, "d0"])
             .select(*keys, "ticker", F.explode(F.array(
                 F.struct(F.col("m"), F.col("weight").alias("w")),
                 F.struct((F.col("m") + 1).alias("m"), (-F.col("weight")).alias("w")))).alias("_x"))
             .groupBy(*keys, F.col("_x.m").alias("m"), "ticker").agg(F.sum("_x.w").alias("_d"))
             .groupBy(*keys, "m").agg((F.lit(0.5) * F.sum(F.abs("_d"))).alias("turnover")))
    return numbered.join(moves, [*keys, "m"], "left").select(
        *keys, "d0", "m", F.coalesce("turnover", F.lit(0.0)).alias("turnover"))


def leg_returns(picks: DataFrame, px: DataFrame, keys: Sequence[str] = (), horizon: int = HORIZON,
                stop: float | None = None, short: bool = False) -> DataFrame:
    """Simple return of each distinct (keys, d0, ticker) position.

    The exit is the close ``horizon`` sessions ahead on the group's own calendar, or
    on its last session; no later session returns 0. A missing entry or exit drops
    the leg. With a stop, the first close at or beyond it is realised at that close.
    The sessions of each leg (entry and exit, or all of them with a stop) are listed
    from the calendar and met by equality on (ticker, Date), never by a range join. The
    list is written out first: positions are few next to prices, and with their size
    known the planner broadcasts them, so prices are scanned once and not shuffled.
    """
    check_stop(stop)
    keys = list(keys)
    leg = [*keys, "ticker", "d0"]
    days = calendar(px, keys)
    held = picks.select(*leg).distinct().join(
        F.broadcast(days.withColumnRenamed("Date", "d0")), [*keys, "d0"]).select(
        *leg, F.col("ord").alias("o"), F.least(F.col("ord") + horizon, F.col("last_ord")).alias("x"))
    spots = F.array_distinct(F.array("o", "x")) if stop is None else F.sequence("o", "x")
    walk = materialize(held.select(*leg, "o", "x", F.explode(spots).alias("ord")).join(
        F.broadcast(days.select(*keys, "ord", "Date")), [*keys, "ord"]))
    seen = px.select(*keys, "ticker", "Date", "Close").where(F.col("Close").isNotNull()).join(
        walk, [*keys, "ticker", "Date"])
    path = [] if stop is None else [F.array_sort(F.collect_list(F.struct("ord", F.col("Close").alias("p")))).alias("path")]
    priced = seen.groupBy(*leg, "o", "x").agg(
        F.max(F.when(F.col("ord") == F.col("o"), F.col("Close"))).alias("p0"),
        F.max(F.when(F.col("ord") == F.col("x"), F.col("Close"))).alias("end"), *path)
    exit_price = F.col("end")
    if stop is not None:
        def beyond(s):
            ratio = s["p"] / F.col("p0")
            return (s["ord"] > F.col("o")) & (ratio >= 1 / stop if short else ratio <= stop)
        exit_price = F.coalesce(F.get(F.filter("path", beyond), F.lit(0))["p"], exit_price)
    ret = F.col("p0") / exit_price - 1 if short else exit_price / F.col("p0") - 1
    return priced.where(F.col("p0").isNotNull()).select(
        *leg, F.when(F.col("x") == F.col("o"), 0.0).otherwise(ret).alias("ret")).where(F.col("ret").isNotNull())


def gross_returns(books: DataFrame, px: DataFrame, keys: Sequence[str] = (), grid: Sequence[str] = (),
                  horizon: int = HORIZON, stop: float | None = None, stop_short: float | None = None,
                  missing: str = "cash", shorts: bool = False) -> DataFrame:
    """Gross return, name count and short weight per decision.

    ``grid`` are the keys of the price calendar (a subset of ``keys``). With
    ``missing='cash'`` the weight of a dropped leg earns 0; ``'survivors'`` takes the
    mean over the legs that are left.
    """
    keys, grid = list(keys), list(grid)
    legs = leg_returns(books.where(F.col("weight") >= 0), px, grid, horizon, stop).withColumn("side", F.lit(1))
    if shorts:
        legs = legs.unionByName(leg_returns(books.where(F.col("weight") < 0), px, grid, horizon, stop_short, True)
                                .withColumn("side", F.lit(-1)))
    sided = books.withColumn("side", F.when(F.col("weight") < 0, -1).otherwise(1))
    joined = sided.join(legs, [*grid, "ticker", "d0", "side"], "left")
    gross = (F.avg("ret") if missing == "survivors" else F.sum(F.abs("weight") * F.col("ret")))
    return joined.groupBy(*keys, "d0").agg(
        F.coalesce(gross, F.lit(0.0)).alias("gross"),
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(F.col("weight") < 0, -F.col("weight")).otherwise(0.0)).alias("short_weight"))


def run_book(books: DataFrame, decisions: DataFrame, px: DataFrame, keys: Sequence[str] = (),
             grid: Sequence[str] = (), cost_bps: float = 5.0, borrow_apr: float = 0.0,
             horizon: int = HORIZON, stop: float | None = None, stop_short: float | None = None,
             missing: str = "cash", shorts: bool = False) -> DataFrame:
    """Month ledger: gross, cost (turnover and borrow), net and running equity."""
    keys = list(keys)
    books = materialize(books)
    trades = turnover(books, decisions, keys)
    gains = gross_returns(books, px, keys, grid, horizon, stop, stop_short, missing, shorts)
    rows = trades.join(gains, [*keys, "d0"], "left").select(
        *keys, "d0", "m", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("gross", F.lit(0.0)).alias("gross"),
        "turnover", F.coalesce("short_weight", F.lit(0.0)).alias("short_weight"))
    return with_costs(rows, cost_bps, borrow_apr, keys)


def with_costs(rows: DataFrame, cost_bps, borrow_apr: float = 0.0, keys: Sequence[str] = ()) -> DataFrame:
    """Cost, net and equity on ledger rows; ``cost_bps`` may be a column name."""
    bps = F.col(cost_bps) if isinstance(cost_bps, str) else F.lit(float(cost_bps))
    cost = F.col("turnover") * bps / 1e4 + F.col("short_weight") * F.lit(borrow_apr) / 12
    priced = rows.withColumn("cost", cost).withColumn("net", F.col("gross") - F.col("cost"))
    return equity_curve(priced, keys)


def equity_curve(ledger: DataFrame, keys: Sequence[str] = (), net: str = "net", order: str = "d0") -> DataFrame:
    """Running equity, its peak (starting equity 1 included) and drawdown. A group is
    the months of one strategy."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    grown = ledger.withColumn("equity", F.product(1 + F.col(net)).over(w))
    peaked = grown.withColumn("peak", F.greatest(F.lit(1.0), F.max("equity").over(w)))
    return peaked.withColumn("drawdown", F.col("equity") / F.col("peak") - 1)


def cost_sweep(ledger: DataFrame, costs: Sequence[float], keys: Sequence[str] = (),
               borrow_apr: float = 0.0) -> DataFrame:
    """The ledger at every cost level. Books, legs and turnover do not depend on the
    cost, so only month rows multiply."""
    base = ledger.drop("cost", "net", "equity", "peak", "drawdown")
    swept = base.withColumn("cost_bps", F.explode(F.array(*[F.lit(float(c)) for c in costs])))
    return with_costs(swept, "cost_bps", borrow_apr, [*keys, "cost_bps"])


def ensemble(a: DataFrame, b: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Half of each net series on the dates both have."""
    left = a.select(*keys, "d0", F.col("net").alias("net_a"))
    right = b.select(*keys, "d0", F.col("net").alias("net_b"))
    return left.join(right, [*keys, "d0"]).withColumn("net", (F.col("net_a") + F.col("net_b")) / 2)


def benchmark_legs(decisions: DataFrame, market: DataFrame, horizon: int = 21) -> DataFrame:
    """Market return over the full ``horizon`` sessions after each decision; decisions
    without a full window are left out. The entry is the last close at or before it."""
    days = calendar(market)
    placed = market.join(days, "Date").select("Date", "ord", "Close")
    dates = decisions.select("d0").distinct()
    lookup = placed.select(F.col("Date").alias("day"), "ord", F.col("Close").alias("p0"))
    start = asof_join(dates.withColumn("_k", F.lit(0)), lookup.withColumn("_k", F.lit(0)), ["_k"], "d0", "day",
                      unique_left=True)
    return (start.join(placed.select((F.col("ord") - horizon).alias("ord"), F.col("Close").alias("p1")), "ord")
            .select("d0", (F.col("p1") / F.col("p0") - 1).alias("bench")))


def calm_only(ledger: DataFrame, known_vol: DataFrame, keys: Sequence[str] = (), limit: float = 0.25) -> DataFrame:
    """Zero the months decided while volatility as of the decision exceeds the limit."""
    joined = ledger.join(F.broadcast(known_vol.select(*keys, "d0", "uvol")), [*keys, "d0"], "left")
    return joined.withColumn("net", F.when(F.col("uvol") > limit, 0.0).otherwise(F.col("net")))


def stitch(*series: DataFrame) -> DataFrame:
    """All series in one table; order matters only inside windows."""
    out = series[0]
    for other in series[1:]:
        out = out.unionByName(other)
    return out


def period_change(series: DataFrame, value: str, keys: Sequence[str] = (), order: str = "month",
                  out: str = "change") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order)
    return series.withColumn(out, F.col(value) / F.lag(value, 1).over(w) - 1)


def null_books(cands: DataFrame, trials: int, k: int, seed: int = 0, keys: Sequence[str] = ("arm", "fold")) -> DataFrame:
    """Random equal-weight books: ``k`` distinct names per trial and decision, every set of
    names equally likely.

    The names of a decision are numbered once. A trial draws ``k`` different numbers from
    md5 values: step i draws below n - k + i + 1 and takes n - k + i itself where the draw is
    taken already. So trials times k rows are made, whatever the number of names.
    """
    place = [*keys, "d0"]
    names = materialize(ordered_counts(cands.select(*place, "ticker").distinct(), place, "ticker").select(
        *place, "ticker", F.col("below").alias("ordinal"), "total"))
    sizes = names.groupBy(*place).agg(F.max("total").alias("total"))
    runs = sizes.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))
    size = F.least(F.col("total"), F.lit(k)).cast("int")

    def step(taken, i):
        last = F.col("total") - size + i
        code = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("trial").cast("string"),
                                 F.date_format("d0", "yyyy-MM-dd"), i.cast("string")))
        drawn = F.conv(F.substring(code, 1, 12), 16, 10).cast("bigint") % (last + 1)
        return F.array_append(taken, F.when(F.array_contains(taken, drawn), last).otherwise(drawn))

    drawn = F.aggregate(F.sequence(F.lit(0), size - 1), F.array().cast("array<bigint>"), step)
    picks = runs.select(*place, "trial", (F.lit(1.0) / size).alias("weight"), F.explode(drawn).alias("ordinal"))
    return picks.join(names.drop("total"), [*place, "ordinal"]).select(*keys, "trial", "d0", "ticker", "weight")
