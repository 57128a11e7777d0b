"""Trailing features on each ticker's own rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.windows import calendar, gated, own_rows, with_sessions

# Model feature names.
FEATURES = ["ret_1", "ret_5", "ret_20", "mom_20", "vol_20", "range", "range_20",
            "vol_chg", "rsi_14", "ma10_gap", "ma50_gap"]
INSIDER_FEATURES = ["ins_conv_3m", "ins_convval_3m", "ins_missing"]
TRADING_DAYS = 252


def model_columns(df: DataFrame) -> list[str]:
    return [c for c in FEATURES + INSIDER_FEATURES if c in df.columns]


def add_features(bars: DataFrame) -> DataFrame:
    """The eleven price and volume features. One shuffle by ticker; the second
    window stage reuses its partitioning and order."""
    w = own_rows()
    close = F.col("Close")
    log_close = F.ln(close)
    last = F.lag(close, 1).over(w)
    change = close - last
    base = bars.select(
        "*",
        *[(log_close - F.lag(log_close, k).over(w)).alias(f"ret_{k}") for k in (1, 5, 20)],
        (close / F.lag(close, 20).over(w) - 1).alias("mom_20"),
        ((F.col("High") - F.col("Low")) / last).alias("range"),
        F.when(change.isNotNull(), F.greatest(change, F.lit(0.0))).alias("_up"),
        F.when(change.isNotNull(), F.greatest(-change, F.lit(0.0))).alias("_down"),
        gated(F.avg, F.col("Volume"), 20, w).alias("_volume"),
        gated(F.avg, close, 10, w).alias("_ma10"),
        gated(F.avg, close, 50, w).alias("_ma50"))
    gain, loss = gated(F.avg, F.col("_up"), 14, w), gated(F.avg, F.col("_down"), 14, w)
    return base.select(
        *bars.columns, "ret_1", "ret_5", "ret_20", "mom_20",
        gated(F.stddev_samp, F.col("ret_1"), 20, w).alias("vol_20"),
        "range",
        gated(F.avg, F.col("range"), 20, w).alias("range_20"),
        (F.col("Volume") / F.nullif(F.col("_volume"), F.lit(0.0)) - 1).alias("vol_chg"),
        (100 - 100 / (1 + gain / F.nullif(loss, F.lit(0.0)))).alias("rsi_14"),
        (close / F.col("_ma10") - 1).alias("ma10_gap"),
        (close / F.col("_ma50") - 1).alias("ma50_gap"))


def with_complete(bars: DataFrame) -> DataFrame:
    """``bars`` with ``complete``: whether ``add_features`` gives the row every feature, neither null nor NaN.

    A trailing window is full where the last row that spoils it lies before the window, so running maxima of row
    numbers answer what the features' sliding frames would; only the mean volume must be taken, as it may be 0.
    """
    w = own_rows()
    close, last = F.col("Close"), F.lag("Close", 1).over(w)
    log_close = F.ln(close)
    spoilt = lambda c: c.isNull() | F.isnan(c)
    base = bars.select(
        "*", F.row_number().over(w).alias("_n"), (log_close - F.lag(log_close, 1).over(w)).alias("_ret"),
        ((F.col("High") - F.col("Low")) / last).alias("_range"), (close - last).alias("_change"),
        gated(F.avg, F.col("Volume"), 20, w).alias("_volume"))
    past = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = lambda hit: F.coalesce(F.max(F.when(hit, F.col("_n"))).over(past), F.lit(0))
    ret, n = F.col("_ret"), F.col("_n")
    full = ((n >= 50) & (at(spoilt(close)) <= n - 50) & (at(spoilt(ret) | (F.abs(ret) == float("inf"))) <= n - 20)
            & (at(spoilt(F.col("_range"))) <= n - 20) & (at(F.col("_change") < 0) > n - 14)
            & ~spoilt(F.col("Volume") / F.nullif(F.col("_volume"), F.lit(0.0)) - 1))
    return base.select(*bars.columns, full.alias("complete"))


def add_alpha(panel: DataFrame, alpha: DataFrame | None) -> DataFrame:
    """Plug a date-keyed outside series (``Date``, ``alpha_1``); null where absent."""
    return panel if alpha is None else panel.join(alpha.select("Date", "alpha_1"), "Date", "left")


def trailing_dv(bars: DataFrame, n: int = 20) -> DataFrame:
    """Mean close times volume over the last n own rows, 0 before n rows exist."""
    value = gated(F.avg, F.col("Close") * F.col("Volume"), n, own_rows())
    return bars.select("ticker", "Date", F.coalesce(value, F.lit(0.0)).alias("dv"))


def trailing_vol(bars: DataFrame, n: int = 20) -> DataFrame:
    """Annualised deviation of the last n log returns, null before n + 1 rows exist."""
    w = own_rows()
    returns = bars.select("ticker", "Date", (F.ln("Close") - F.ln(F.lag("Close", 1).over(w))).alias("_r"))
    return returns.select("ticker", "Date",
                          (gated(F.stddev_samp, F.col("_r"), n, w) * F.sqrt(F.lit(TRADING_DAYS))).alias("vol"))


def trend_signal(bars: DataFrame, lookback: int = 210, slack: int = 5) -> DataFrame:
    """Close above its mean over the last ``lookback`` sessions of the union
    calendar; evaluated once ``lookback + slack`` sessions exist."""
    placed = with_sessions(bars)
    frame = Window.partitionBy("ticker").orderBy("ord").rangeBetween(-(lookback - 1), 0)
    return placed.select("ticker", "Date", "ord", "Close", F.avg("Close").over(frame).alias("sma")).where(
        F.col("ord") >= lookback + slack).select(
        "ticker", "Date", "Close", "sma", (F.col("Close") > F.col("sma")).alias("above"))


def universe_vol(px: DataFrame, kind: str = "simple", keys: list[str] | None = None,
                 window: int = 60, need: int = 20, year: int = TRADING_DAYS) -> DataFrame:
    """Annualised regime volatility: mean one-session return across tickers, then a
    trailing deviation over sessions.

    A return needs both neighbouring sessions of the union calendar. Dates on which
    no ticker has one are left out of the series.
    """
    keys = keys or []
    placed = with_sessions(px, keys)
    w = Window.partitionBy(*keys, "ticker").orderBy("ord")
    adjacent = F.lag("ord", 1).over(w) == F.col("ord") - 1
    ratio = F.col("Close") / F.lag("Close", 1).over(w)
    step = F.when(adjacent, F.ln(ratio) if kind == "log" else ratio - 1)
    daily = (placed.select(*keys, "Date", step.alias("_r")).groupBy(*keys, "Date")
             .agg(F.avg("_r").alias("uret")).where(F.col("uret").isNotNull()))
    series = Window.partitionBy(*keys).orderBy("Date")
    return daily.select(*keys, "Date", "uret",
                        (gated(F.stddev_samp, F.col("uret"), window, series, need)
                         * F.sqrt(F.lit(year))).alias("uvol"))


def formation_momentum(bars: DataFrame, lookback: int = 252, skip: int = 21,
                       decisions: DataFrame | None = None) -> DataFrame:
    """Close ``skip - 1`` sessions back over close ``lookback - 1`` sessions back,
    minus 1, on the union calendar; both endpoints must exist.

    Only the two endpoint prices of each decision are joined, on (ticker, ord):
    ``d0``, ``ticker``, ``mom``. The decision list defaults to every session.
    """
    days = calendar(bars)
    placed = bars.join(F.broadcast(days), "Date").select("ticker", "ord", "Close")
    dates = days.select(F.col("Date").alias("d0"), "ord")
    if decisions is not None:
        dates = dates.join(F.broadcast(decisions.select("d0").distinct()), "d0")
    dates = dates.where(F.col("ord") >= lookback)
    spots = dates.select("d0", F.explode(F.array(
        F.struct((F.col("ord") - (skip - 1)).alias("ord"), F.lit("ref").alias("end")),
        F.struct((F.col("ord") - (lookback - 1)).alias("ord"), F.lit("base").alias("end")))).alias("s"))
    spots = spots.select("d0", "s.ord", "s.end")
    ends = placed.join(F.broadcast(spots), "ord").groupBy("d0", "ticker").agg(
        F.max(F.when(F.col("end") == "ref", F.col("Close"))).alias("_ref"),
        F.max(F.when(F.col("end") == "base", F.col("Close"))).alias("_base"))
    return ends.where(F.col("_ref").isNotNull() & F.col("_base").isNotNull()).select(
        "d0", "ticker", (F.col("_ref") / F.col("_base") - 1).alias("mom"))


def own_momentum(bars: DataFrame, lookback: int = 252, skip: int = 21) -> DataFrame:
    """Formation momentum on the ticker's own last ``lookback`` closes."""
    w = own_rows()
    return bars.select(
        "ticker", "Date", "Close", "Volume",
        F.when(F.row_number().over(w) >= lookback,
               F.lag("Close", skip - 1).over(w) / F.lag("Close", lookback - 1).over(w) - 1).alias("mom"))
