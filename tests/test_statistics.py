import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark.functions.normal import normal_cdf, normal_quantile
from panelspark.operators import evaluate, reconcile, stability, stats, value
from tests.helpers import bars, day, days


def series(spark, values, name="s"):
    return spark.createDataFrame([(name, d, float(v)) for d, v in zip(days(len(values)), values)], "series STRING, d0 DATE, net DOUBLE")


def test_growth_identity_and_null_sharpe(spark):
    out = evaluate.summarize(series(spark, [0.01] * 12)).first()
    assert out.cagr == pytest.approx(1.01 ** 12 - 1)
    flat = series(spark, [0.0] * 12).agg(evaluate.strict_sharpe().alias("s")).first()
    assert flat.s is None


def test_auc_against_pairs(spark):
    rng = random.Random(4)
    rows = [("f", float(rng.random() < 0.4), round(rng.random(), 1)) for _ in range(80)] + [("one", 1.0, 0.3), ("one", 1.0, 0.4)]
    df = spark.createDataFrame(rows, "fold STRING, label DOUBLE, proba DOUBLE")
    got = {r.fold: r.auc for r in evaluate.auc(df, ["fold"]).collect()}
    pos = [p for f, y, p in rows if f == "f" and y == 1]
    neg = [p for f, y, p in rows if f == "f" and y == 0]
    want = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    assert got["f"] == pytest.approx(want) and got["one"] is None


def test_auc_joins_no_ranks_to_rows(spark):
    """Only groups and slots are joined, never rows by their score; null scores count as rows and positives without a rank."""
    df = spark.createDataFrame([("f", 1.0, 0.9), ("f", 0.0, 0.1), ("f", 1.0, 0.1), ("f", 0.0, None), ("g", 1.0, 0.5)],
                               "fold STRING, label DOUBLE, proba DOUBLE")
    out = evaluate.auc(df, ["fold"])
    joins = [line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
    assert joins and not any("proba" in line for line in joins)
    # Ranks are 1.5, 1.5 and 3: (4.5 - 3) / (2 * 2).
    assert {r.fold: (r.rows, r.positives, r.auc) for r in out.collect()} == {"f": (4, 2, 0.375), "g": (1, 1, None)}


def test_bootstrap_blocks_are_circular_and_repeat(spark):
    s = series(spark, range(10))
    draws = stats.bootstrap_draws(s, "net", block=4, draws=20)
    rows = {}
    for r in draws.orderBy("draw", "pos").collect():
        rows.setdefault(r.draw, []).append(int(r.v))
    assert len(rows) == 20
    for values in rows.values():
        assert len(values) == 10 and all(0 <= v < 10 for v in values)
        for k in range(0, 10, 4):
            block = values[k:k + 4]
            assert all(b == (block[0] + j) % 10 for j, b in enumerate(block))
    again = sorted(map(tuple, stats.bootstrap_draws(s, "net", block=4, draws=20).select("draw", "pos", "idx").collect()))
    assert again == sorted(map(tuple, draws.select("draw", "pos", "idx").collect()))
    ci = stats.bootstrap_ci(series(spark, [0.01 * ((7 * i) % 11 - 4) for i in range(24)]), draws=50).first()
    assert ci.mean_lo <= ci.mean <= ci.mean_hi and ci.draws == 50


def test_factor_regression_against_direct_formula(spark):
    rng = np.random.default_rng(3)
    n, cols = 60, ["a", "b"]
    x = rng.normal(size=(n, 2))
    y = 0.01 + x @ [0.5, -0.2] + rng.normal(scale=0.1, size=n)
    months = pd.date_range("2010-01-31", periods=n, freq="ME").date
    ret = spark.createDataFrame([("s", m, float(v)) for m, v in zip(months, y)], "series STRING, month DATE, ret DOUBLE")
    fac = spark.createDataFrame([(m, float(p), float(q), 0.0) for m, (p, q) in zip(months, x)], "month DATE, a DOUBLE, b DOUBLE, rf DOUBLE")
    got = {r.term: r for r in stats.factor_regression(ret, fac, cols).collect()}
    design = np.column_stack([np.ones(n), x])
    beta, *_ = np.linalg.lstsq(design, y, rcond=None)
    u = y - design @ beta
    meat = np.zeros((3, 3))
    for i in range(n):
        for j in range(n):
            gap = abs(i - j)
            if gap <= 3:
                meat += (1 - gap / 4) * u[i] * u[j] * np.outer(design[i], design[j])
    inverse = np.linalg.inv(design.T @ design)
    se = np.sqrt(np.diag(inverse @ meat @ inverse))
    for k, term in enumerate(["alpha", *cols]):
        assert (got[term].coef, got[term].se) == (pytest.approx(beta[k]), pytest.approx(se[k]))
    assert stats.factor_regression(ret.limit(10), fac, cols).count() == 0
    one = stats.capm(ret, fac.withColumnRenamed("a", "mkt_rf")).first()
    assert one.beta == pytest.approx(np.polyfit(x[:, 0], y, 1)[0])


def test_normal_functions(spark):
    row = spark.range(1).select(normal_cdf(F.lit(1.959963984540054)).alias("c"), normal_quantile(F.lit(0.975)).alias("q")).first()
    assert (row.c, row.q) == (pytest.approx(0.975), pytest.approx(1.959963984540054))


def test_deflated_sharpe_falls_with_trials(spark):
    rng = random.Random(2)
    rows = [(f"P{k}", d, rng.gauss(0.01 + 0.002 * k, 0.03)) for k in range(5) for d in days(60)]
    nets = spark.createDataFrame(rows, "variant STRING, d0 DATE, net DOUBLE")
    out = {r.scenario: r for r in stats.deflated_sharpe(nets, [("one", 1, []), ("few", 5, []), ("many", 38, [])]).collect()}
    assert out["one"].sharpe_star == 0 and out["one"].dsr == pytest.approx(out["one"].psr0)
    assert out["one"].dsr > out["few"].dsr > out["many"].dsr


def test_moments_are_population_forms(spark):
    values = [0.01, -0.03, 0.02, 0.05, -0.01]
    row = evaluate.return_moments(series(spark, values), ["series"]).first()
    x = np.array(values)
    z = (x - x.mean()) / x.std()
    assert (row.skew, row.kurtosis) == (pytest.approx((z ** 3).mean()), pytest.approx((z ** 4).mean()))
    assert row.sharpe_m == pytest.approx(x.mean() / x.std(ddof=1))


QEPS = [1.02 ** i for i in range(13)]


def hand(spark):
    start = pd.Timestamp("2020-01-01")
    rows = [("HAND", (start + pd.Timedelta(days=45 + i * 91)).date(), (start + pd.Timedelta(days=i * 91)).date(), e,
             round(sum(QEPS[max(0, i - 3):i + 1]), 4), 20.0) for i, e in enumerate(QEPS)]
    return spark.createDataFrame(rows, "ticker STRING, filed_date DATE, period_end DATE, qeps DOUBLE, eps_ttm DOUBLE, bvps DOUBLE")


def test_value_hand_check(spark):
    rows = value.iv_panel(hand(spark)).orderBy("filed_date").collect()
    last = rows[-1]
    assert last.g == pytest.approx(0.0792, abs=1e-3) and last.eps_ttm == pytest.approx(4.9257, abs=1e-3)
    assert last.iv == pytest.approx(119.9, abs=0.05) and last.graham_num == pytest.approx(47.08, abs=0.05)
    assert rows[5].g == 0.0 and rows[5].iv == pytest.approx(rows[5].eps_ttm * 8.5)


def test_growth_edges(spark):
    fund = hand(spark)
    assert value.iv_panel(fund.withColumn("qeps", F.when(F.col("qeps") > 1.2, -1.0).otherwise(F.col("qeps")))).agg(F.max("g")).first()[0] == 0
    holed = fund.withColumn("qeps", F.when(F.month("filed_date") == 1, F.lit(None).cast("double")).otherwise(F.col("qeps")))
    assert value.iv_panel(holed).where("g IS NULL").count() == 0
    annual = [("ANN", day(f"{2010 + i}-03-01"), day(f"{2009 + i}-12-31"), 1.1 ** i, 1.1 ** i, 10.0) for i in range(6)]
    got = value.iv_panel(spark.createDataFrame(annual, fund.schema)).orderBy("filed_date").collect()
    assert [round(r.g, 4) for r in got] == [0, 0, 0, 0] + [round(np.log(1.1), 4)] * 2


def month_ends(n):
    return [d.date() for d in pd.date_range("2020-01-31", periods=n, freq="ME")]


def test_identical_qualifiers_enter_together(spark):
    ends = month_ends(3)
    px = bars(spark, [(t, d, 100.0) for t in ("AAA", "BBB") for d in ends])
    iv = spark.createDataFrame([(t, ends[0], 1000.0) for t in ("AAA", "BBB")], "ticker STRING, filed_date DATE, iv DOUBLE")
    rows = value.value_episodes(value.asof_value(px, iv), [0.5]).collect()
    assert sorted((r.ticker, r.entry_date, r.exit_date) for r in rows) == [("AAA", ends[0], None), ("BBB", ends[0], None)]


def test_episode_exit_reentry_and_age(spark):
    ends = month_ends(45)
    prices = [40.0, 100.0, 45.0] + [45.0] * 42
    asof = spark.createDataFrame([("A", d, i + 1, 100.0, p) for i, (d, p) in enumerate(zip(ends, prices))],
                                 "ticker STRING, d DATE, i INT, iv DOUBLE, price DOUBLE")
    got = sorted((r.entry_i, r.exit_i) for r in value.value_episodes(asof, [0.5]).collect())
    assert got[0] == (1, 2) and got[1][0] == 3
    aged = [i for i, d in enumerate(ends, 1) if (d - ends[2]).days > 1095][0]
    # an aged position that still qualifies is sold and bought again in the same month
    assert got[1] == (3, aged) and got[2] == (aged, None)
    index = value.value_index(value.value_episodes(asof, [0.5]), asof, 5.0)
    nets = {r.i: r.net for r in index.collect()}
    assert nets[1] == 0 and nets[2] == pytest.approx(1.5 - 2 * 5e-4) and nets[3] == 0


def test_fair_benchmark_starts_with_first_valued_month(spark):
    ends = month_ends(3)
    rows = [("A", ends[0], 1, None, 10.0), ("A", ends[1], 2, 50.0, 20.0), ("A", ends[2], 3, 50.0, 30.0),
            ("B", ends[1], 2, None, 10.0), ("B", ends[2], 3, 9.0, 99.0)]
    asof = spark.createDataFrame(rows, "ticker STRING, d DATE, i INT, iv DOUBLE, price DOUBLE")
    assert {r.i: r.bench for r in value.fair_benchmark(asof).collect()} == {2: 1.0, 3: 1.5}


def test_stability_tables(spark):
    d1, d2 = day("2020-01-31"), day("2020-02-28")
    rows = [(d1, t, a, b) for t, a, b in (("A", 0.9, 0.9), ("B", 0.8, 0.1), ("C", 0.1, 0.8))] + [(d2, t, 0.1, 0.2) for t in "AB"]
    common = spark.createDataFrame(rows, "Date DATE, ticker STRING, proba_left DOUBLE, proba_right DOUBLE")
    monthly, dist = stability.stability(common, 0.25, 2)
    got = {r.d0: r for r in monthly.collect()}
    assert got[d1].jaccard == pytest.approx(1 / 3) and not got[d1].exact_match
    assert got[d2].jaccard is None and got[d2].exact_match
    counts = {r.distance_bin: (r.names, r.changed) for r in dist.collect()}
    assert len(counts) == 5 and sum(n for n, _ in counts.values()) == 5 and sum(c for _, c in counts.values()) == 2
    summary = stability.stability_summary(monthly).first()
    assert (summary.months, summary.nonempty_months, summary.exact_months) == (2, 1, 0)


def test_reconcile_alignment(spark):
    led = spark.createDataFrame([(day("2020-01-31"), 0.1), (day("2020-02-28"), -0.05)], "d0 DATE, net DOUBLE")
    daily = spark.createDataFrame([(day("2020-01-31"), 100.0), (day("2020-02-10"), 90.0), (day("2020-02-28"), 110.0),
                                   (day("2020-03-31"), 99.0)], "Date DATE, equity DOUBLE")
    rows = reconcile.align_returns(led, daily, "2020-02-01").orderBy("month").collect()
    assert [(str(r.month), round(r.local_return, 6), round(r.ext_return, 6), r.complete) for r in rows] == [
        ("2020-02-01", 0.1, 0.1, True), ("2020-03-01", -0.05, -0.1, False)]


def test_drawdown_dates(spark):
    curve = spark.createDataFrame(list(zip(days(6), [1.0, 2.0, 1.5, 2.0, 1.0, 3.0])), "Date DATE, equity DOUBLE")
    row = evaluate.drawdown_dates(curve).first()
    assert (row.peak_date, row.trough_date, row.max_dd) == (days(6)[1], days(6)[4], -0.5)


def test_gates(spark):
    t = spark.createDataFrame([("a", 0.5, -0.2), ("b", 0.6, -0.5), ("c", 0.6, -0.1)], "variant STRING, sharpe DOUBLE, max_dd DOUBLE")
    assert {r.variant: r.passed for r in evaluate.promotion_gate(t).collect()} == {"a": True, "b": False, "c": True}
    assert evaluate.best_trial(t).first().variant == "b"
    cand, ctrl = series(spark, [0.02, 0.01, 0.03]), series(spark, [0.01, 0.0, 0.02, 0.5])
    row = evaluate.validation_gate(cand, ctrl).first()
    assert row.cand_months == row.ctrl_months == 3 and row.passed
