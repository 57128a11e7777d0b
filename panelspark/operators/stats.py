"""Bootstrap intervals, factor regressions and deflated Sharpe ratios.

Inputs are monthly series, bounded by the months of a strategy; the work runs in
parallel over strategies, draws and scenarios.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.normal import normal_cdf, normal_quantile
from panelspark.operators.evaluate import annualised, return_moments

EULER_MASCHERONI = 0.5772156649015329


def bootstrap_draws(series: DataFrame, value: str, keys: Sequence[str] = ("series",), order: str = "d0",
                    block: int = 6, draws: int = 5000, seed: int = 0) -> DataFrame:
    """Circular moving-block resamples: (keys, draw, pos, value). Block starts come from
    md5, so every recomputation gives the same draws."""
    w = Window.partitionBy(*keys).orderBy(order)
    placed = series.select(*keys, (F.row_number().over(w) - 1).alias("idx"), F.col(value).alias("v"))
    sizes = placed.groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias("n"))
    blocks = sizes.select(*keys, "n", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw")).select(
        "*", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / block).cast("int") - 1)).alias("b"))
    code = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("draw").cast("string"), F.col("b").cast("string")))
    start = F.conv(F.substring(code, 1, 7), 16, 10).cast("bigint") % F.col("n")
    spots = blocks.withColumn("s", start).select(
        *keys, "draw", "n", "b", "s", F.explode(F.sequence(F.lit(0), F.lit(block - 1))).alias("j")).where(
        F.col("b") * block + F.col("j") < F.col("n"))
    idx = ((F.col("s") + F.col("j")) % F.col("n")).cast("int")
    return spots.select(*keys, "draw", (F.col("b") * block + F.col("j")).alias("pos"), idx.alias("idx")).join(
        placed, [*keys, "idx"])


def bootstrap_ci(series: DataFrame, value: str = "net", keys: Sequence[str] = ("series",), order: str = "d0",
                 block: int = 6, draws: int = 5000, seed: int = 0) -> DataFrame:
    """Point values and 95 % intervals of mean, growth rate and Sharpe."""
    keys = list(keys)
    n = F.count(F.lit(1))
    sharpe = F.avg("v") / F.nullif(F.stddev_samp("v"), F.lit(0.0)) * F.sqrt(F.lit(12.0))

    def stats(df: DataFrame, by: list[str]) -> DataFrame:
        return df.groupBy(*by).agg(F.avg("v").alias("mean"), annualised(F.product(1 + F.col("v")), n).alias("cagr"),
                                   sharpe.alias("sharpe"))

    resampled = stats(bootstrap_draws(series, value, keys, order, block, draws, seed), [*keys, "draw"])
    names = ("mean", "cagr", "sharpe")
    bounds = resampled.groupBy(*keys).agg(
        *[F.percentile(s, q).alias(f"{s}_{t}") for s in names for q, t in ((0.025, "lo"), (0.975, "hi"))],
        F.count(F.lit(1)).alias("draws"))
    point = stats(series.select(*keys, F.col(value).alias("v")), keys)
    return point.join(bounds, keys)


def capm(series: DataFrame, factors: DataFrame, keys: Sequence[str] = ("series",), ret: str = "ret",
         min_months: int = 24) -> DataFrame:
    """Market regression of excess returns on common months."""
    rows = series.join(factors.select("month", "mkt_rf", "rf"), "month").withColumn("_y", F.col(ret) - F.col("rf"))
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("months"), F.regr_intercept("_y", "mkt_rf").alias("alpha"),
        F.regr_slope("_y", "mkt_rf").alias("beta"), F.regr_r2("_y", "mkt_rf").alias("r2")).where(
        F.col("months") >= min_months)


def factor_regression(series: DataFrame, factors: DataFrame, cols: Sequence[str], keys: Sequence[str] = ("series",),
                      ret: str = "ret", lags: int = 3, min_months: int = 24) -> DataFrame:
    """Least squares on several factors with Newey-West errors: one row per term.

    Months without a return or one of the factors are left out. One group is the months of one series; series
    run in parallel.
    """
    keys, cols = list(keys), list(cols)
    rows = series.join(factors, "month").withColumn("_y", F.col(ret) - F.col("rf")).select(*keys, "month", "_y", *cols).dropna(
        subset=["_y", *cols])
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + \
        ", term string, months bigint, coef double, se double, t double, r2 double"

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("month")
        n = len(pdf)
        head = {k: pdf[k].iloc[0] for k in keys}
        if n < min_months:
            return pd.DataFrame(columns=[*keys, "term", "months", "coef", "se", "t", "r2"])
        x = np.column_stack([np.ones(n), pdf[cols].to_numpy(float)])
        y = pdf["_y"].to_numpy(float)
        bread = np.linalg.pinv(x.T @ x)
        coef = bread @ x.T @ y
        resid = y - x @ coef
        z = x * resid[:, None]
        meat = z.T @ z
        for lag in range(1, lags + 1):
            cross = z[lag:].T @ z[:-lag]
            meat += (1 - lag / (lags + 1)) * (cross + cross.T)
        se = np.sqrt(np.diag(bread @ meat @ bread))
        r2 = 1 - resid @ resid / ((y - y.mean()) @ (y - y.mean()))
        return pd.DataFrame({**head, "term": ["alpha", *cols], "months": n, "coef": coef, "se": se,
                             "t": coef / se, "r2": r2})

    return rows.groupBy(*keys).applyInPandas(fit, schema)


def expected_max_sharpe(variance, trials):
    """Expected best Sharpe among ``trials`` null trials; 0 for a single one."""
    g = F.lit(EULER_MASCHERONI)
    far = F.greatest(trials, F.lit(2)).cast("double")
    best = (1 - g) * normal_quantile(1 - 1 / far) + g * normal_quantile(1 - 1 / (far * F.lit(math.e)))
    return F.when(trials <= 1, 0.0).otherwise(F.sqrt(variance) * best)


def probabilistic_sharpe(sharpe, target, months, skew, kurt):
    spread = F.sqrt(F.greatest(F.lit(1e-12), 1 - skew * sharpe + (kurt - 1) / 4 * sharpe * sharpe))
    return normal_cdf((sharpe - target) * F.sqrt(months - 1) / spread)


def deflated_sharpe(nets: DataFrame, scenarios: Sequence[tuple[str, int, Sequence[str]]],
                    trial: str = "variant", net: str = "net") -> DataFrame:
    """Probability that the best trial's Sharpe beats what ``n`` null trials would show.

    A scenario is (label, trial count, trials left out of the Sharpe variance).
    """
    moments = return_moments(nets, [trial], net)
    best = moments.agg(F.min(F.struct((-F.col("sharpe_m")).alias("s"), F.col(trial).alias("t"), "months", "skew",
                                      "kurtosis")).alias("b"),
                       *[F.var_samp(F.when(~F.col(trial).isin(list(out)), F.col("sharpe_m"))).alias(f"_v{i}")
                         if out else F.var_samp("sharpe_m").alias(f"_v{i}")
                         for i, (_, _, out) in enumerate(scenarios)])
    rows = best.select("b", F.inline(F.array(*[
        F.struct(F.lit(label).alias("scenario"), F.lit(n).alias("trials"), F.col(f"_v{i}").alias("variance"))
        for i, (label, n, _) in enumerate(scenarios)])))
    rows = rows.select("scenario", "trials", "variance", F.col("b.t").alias("best"), (-F.col("b.s")).alias("sharpe"),
                       F.col("b.months").alias("months"), F.col("b.skew").alias("skew"),
                       F.col("b.kurtosis").alias("kurtosis"))
    rows = rows.withColumn("sharpe_star", expected_max_sharpe(F.col("variance"), F.col("trials")))
    p = [F.col(c) for c in ("months", "skew", "kurtosis")]
    return rows.withColumn("psr0", probabilistic_sharpe(F.col("sharpe"), F.lit(0.0), *p)).withColumn(
        "dsr", probabilistic_sharpe(F.col("sharpe"), F.col("sharpe_star"), *p))
