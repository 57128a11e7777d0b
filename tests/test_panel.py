import datetime
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from panelspark import session
from panelspark.operators import features, folds, labels, model, select
from panelspark.sources import fixtures
from tests.helpers import bars, day, days
from tests.test_ledger import random_market


def test_features_on_a_short_series(spark):
    """One rise of 1 per day from 100, with a fall of 2 on every third day; values by plain loops."""
    close = [100.0]
    for i in range(1, 70):
        close.append(close[-1] + (-2.0 if i % 3 == 0 else 1.0))
    rows = [("A", d, c) for d, c in zip(days(70), close)]
    got = {r.Date: r for r in features.add_features(bars(spark, rows)).collect()}
    for at, d in enumerate(days(70)):
        row, steps = got[d], [close[k] - close[k - 1] for k in range(max(1, at - 13), at + 1)]
        if at == 0:
            assert row.ret_1 is None
            continue
        assert row.ret_1 == pytest.approx(math.log(close[at] / close[at - 1]))
        assert (row.mom_20 is None) == (at < 20)
        if at >= 20:
            logs = [math.log(close[k] / close[k - 1]) for k in range(at - 19, at + 1)]
            assert row.mom_20 == pytest.approx((close[at] - close[at - 20]) / close[at - 20])
            assert row.vol_20 == pytest.approx(statistics.stdev(logs))
            ups, downs = sum(x for x in steps if x > 0), -sum(x for x in steps if x < 0)
            assert row.rsi_14 == pytest.approx(100 * ups / (ups + downs))
        if at >= 49:
            assert row.ma50_gap == pytest.approx(close[at] * 50 / sum(close[at - 49:at + 1]) - 1)


def test_label_rank_and_two_clocks(spark):
    rows = random_market(22, "ABCDE", 90) + [("MKT", d, 50.0 + i) for i, d in enumerate(days(90))]
    panel = labels.add_labels(bars(spark, rows).select("ticker", "Date", "Close"), bars(spark, rows).where("ticker = 'MKT'"))
    pdf = panel.toPandas()
    pct = pdf.groupby("Date")["excess"].rank(pct=True)
    assert ((pct >= 0.8).astype(float) == pdf["label"]).all()
    own = pdf.sort_values("Date").groupby("ticker")["Date"].shift(-20)
    assert (own.dropna() == pdf.loc[own.dropna().index, "label_end"]).all()


def test_latest_needs_no_outcome(spark):
    rows = [(t, d, 100.0 + i % 7 + k) for k, t in enumerate(["A", "MKT"]) for i, d in enumerate(days(80))]
    latest = labels.build_latest(bars(spark, rows)).collect()
    assert [(r.ticker, r.Date) for r in latest] == [("A", days(80)[-1])]


def test_formation_momentum_endpoints(spark):
    ds = days(60)
    px = bars(spark, [("A", d, float(i + 1)) for i, d in enumerate(ds)] + [("B", d, 1.0) for d in ds[:30]])
    got = features.formation_momentum(px, 52, 4).collect()
    last = {r.ticker: r.mom for r in got if r.d0 == ds[-1]}
    assert last == {"A": pytest.approx(57 / 9 - 1)}  # B has no price three sessions back


def test_fold_assignment_matches_ranges(spark):
    ds = days(1095 + 360 + 500, "2000-01-01")
    panel = spark.createDataFrame([("A", d) for d in ds], "ticker STRING, Date DATE").withColumn(
        "label_end", F.date_add("Date", 20))
    got = {(r.fold, r.role, r.Date) for r in folds.assign_folds(panel).select("fold", "role", "Date").collect()}
    want = set()
    cal = folds.fold_calendar(panel).collect()
    assert [r.fold for r in cal] == [0, 1, 2]
    for r in cal:
        for d in ds:
            if r.train_start <= d < r.val_start:
                want.add((r.fold, "train", d))
            elif r.val_start <= d < r.test_start:
                want.add((r.fold, "val", d))
            elif r.test_start <= d < r.test_end:
                want.add((r.fold, "test", d))
    assert got == want
    kept = folds.purge(folds.assign_folds(panel)).where("role = 'train'").groupBy("fold").agg(F.max("label_end").alias("m"))
    start = {r.fold: r.val_start for r in cal}
    assert all((start[r.fold] - r.m).days == 21 for r in kept.collect())


def test_no_fold_before_enough_history(spark):
    panel = spark.createDataFrame([("A", d) for d in days(500)], "ticker STRING, Date DATE").withColumn("label_end", F.col("Date"))
    assert folds.fold_calendar(panel).count() == 0 and folds.assign_folds(panel).count() == 0


def test_fold_cache_contract(spark, tmp_path):
    rows = [("A", day("2020-01-01"), 1.0, 0.0, 0.5, "x", 0), ("A", day("2020-01-02"), 1.0, 1.0, 0.7, "x", 1)]
    df = spark.createDataFrame(rows, folds.FOLD_COLUMNS)
    path = str(tmp_path / "cache")
    folds.write_folds(df, path)
    assert sorted(r.fold for r in folds.read_folds(spark, path).collect()) == [0, 1]
    with pytest.raises(Exception, match="(?i)exist"):
        folds.write_folds(df, path)
    with pytest.raises(ValueError, match="duplicate"):
        folds.write_folds(df.unionByName(df), str(tmp_path / "other"))
    assert [r.fold for r in folds.last_folds(df, 1).collect()] == [1]


def test_split_halves_and_arm_check(spark):
    df = spark.createDataFrame([(i, "test", day("2020-01-01"), "A") for i in range(5)], "fold INT, role STRING, Date DATE, ticker STRING")
    halves = {r.fold: r.half for r in folds.split_halves(df, "fold").collect()}
    assert halves == {0: "tune", 1: "tune", 2: "hold", 3: "hold", 4: "hold"}
    folds.assert_same_test_rows(df, df)
    with pytest.raises(ValueError):
        folds.assert_same_test_rows(df, df.where("fold < 4"))


def test_universe_vol_needs_adjacent_sessions(spark):
    ds = days(30)
    price = {("A", i): 100.0 + i % 3 for i in range(30)} | {("B", i): 50.0 + i % 2 for i in range(30) if i % 4}
    got = features.universe_vol(bars(spark, [(t, ds[i], c) for (t, i), c in price.items()])).orderBy("Date").collect()
    mean = []
    for i in range(1, 30):
        moves = [price[t, i] / price[t, i - 1] - 1 for t in "AB" if (t, i) in price and (t, i - 1) in price]
        mean.append(sum(moves) / len(moves))
    assert [r.Date for r in got] == ds[1:]
    for at, r in enumerate(got, 1):
        assert r.uret == pytest.approx(mean[at - 1])
        assert (r.uvol is None) == (at < 20)
        if at >= 20:
            assert r.uvol == pytest.approx(statistics.stdev(mean[:at]) * math.sqrt(252))


PANEL = "ticker STRING, Date DATE, label_end DATE, Close DOUBLE, label DOUBLE, ret_1 DOUBLE, ret_5 DOUBLE"


def test_no_fold_gives_an_empty_table(spark):
    out = model.score_folds(spark.createDataFrame([], PANEL))
    assert out.count() == 0 and "proba" in out.columns


def test_trees_find_a_planted_signal(spark):
    rng = random.Random(1)
    first, rows = day("2018-01-01"), []
    for i in range(3000):
        x, at = rng.gauss(0, 1), first + datetime.timedelta(i % 1460)
        rows.append((f"T{i}", at, at + datetime.timedelta(5), 1.0, float(x + rng.gauss(0, 0.7) > 0.8), x, rng.gauss(0, 1)))
    from panelspark.operators.evaluate import auc
    scored = model.score_folds(spark.createDataFrame(rows, PANEL), rounds=3, depth=2, min_rows=20)
    pdf = scored.toPandas()
    want = [r[0] for r in rows if datetime.timedelta(1275) <= r[1] - first < datetime.timedelta(1455)]
    assert sorted(pdf.ticker) == sorted(want) and set(pdf.fold) == {0} and pdf.proba.between(0, 1).all()
    assert auc(scored, ["fold"]).first().auc > 0.7


def test_slices_of_folds_are_the_purged_assignment(spark):
    rng = random.Random(2)
    first = day("2018-01-01")
    rows = []
    for i in range(4000):
        at = first + datetime.timedelta(rng.randrange(2000))
        rows.append((f"T{i}", at, at + datetime.timedelta(rng.randrange(40)), 1.0, 0.0, 0.0, 0.0))
    panel = spark.createDataFrame(rows, PANEL)
    want = folds.purge(folds.assign_folds(panel)).select("fold", "role", "ticker").collect()
    spans = folds.fold_calendar(panel).collect()
    got = [(s.fold, r.role, r.ticker) for s in spans for r in folds.fold_rows(panel, s).select("role", "ticker").collect()]
    assert len(spans) > 2 and sorted(got) == sorted(map(tuple, want))


def test_liquid_universe_and_topk(spark):
    d = days(1)[0]
    rows = [(f"T{i}", d, 10.0, 10.0, 10.0, 10.0, 1000.0 * i) for i in range(1, 8)] + [("P", d, 4.0, 4.0, 4.0, 4.0, 1e9)]
    px = spark.createDataFrame(rows, "ticker STRING, Date DATE, Open DOUBLE, High DOUBLE, Low DOUBLE, Close DOUBLE, Volume DOUBLE")
    assert [r.ticker for r in select.liquid_universe(px, 3, 5.0, 15_000.0).orderBy("rn").collect()] == ["T7", "T6", "T5"]
    own = spark.createDataFrame([(d, f"T{i:02d}", i / 10) for i in range(30)], "d0 DATE, ticker STRING, mom DOUBLE")
    assert sorted(r.ticker for r in select.pick_momentum_topk(own).collect()) == [f"T{i}" for i in range(25, 30)]


def odd_bars(spark):
    """Series with nulls, NaN, flat runs, falls to zero and volumes that average 0, and the market's."""
    rng, nan, ds, rows = random.Random(7), float("nan"), days(170), []
    for t in ["A", "B", "C", "D", "E", "F", "G", "MKT"]:
        c = 50.0
        for i, d in enumerate(ds):
            c = c if t == "A" and 60 <= i < 95 else max(1.0, c + rng.choice([-1.0, 0.0, 1.5, -0.5]))
            o, h, l, k, v = c, c + 1, c - 1, c, 10.0
            if t == "B" and 70 <= i < 100:
                v = 0.0
            if t == "C" and i in (40, 121):
                k = None
            if t == "D" and i in (30, 130):
                k = nan
            if t == "E" and i in (55, 110):
                h = None if i == 55 else nan
            if t == "F" and i == 90:
                v = None
            if t == "G" and 60 <= i < 100:
                v = 10.0 if i % 2 else -10.0
            rows.append((t, d, o, h, l, k, v))
    schema = "ticker STRING, Date STRING, Open DOUBLE, High DOUBLE, Low DOUBLE, Close DOUBLE, Volume DOUBLE"
    return spark.createDataFrame([(r[0], str(r[1]), *r[2:]) for r in rows], schema).withColumn("Date", F.col("Date").cast("date"))


def test_complete_rows_are_those_with_all_features(spark):
    rows = odd_bars(spark)
    want = {(r.ticker, r.Date) for r in features.add_features(rows).dropna(subset=features.FEATURES).collect()}
    flagged = features.with_complete(rows)
    got = {(r.ticker, r.Date) for r in flagged.where("complete").collect()}
    assert got == want and 0 < len(want) < flagged.count() == rows.count()
    assert flagged.where("complete IS NULL").count() == 0


def test_labelled_rows_are_the_panel_without_features(spark):
    rows = odd_bars(spark)
    columns = ["ticker", "Date", "Close", "fwd_ret", "mkt_fwd", "excess", "label_end", "label"]
    side = lambda df: sorted(tuple(r) for r in df.select(*columns).collect())
    got = side(labels.labelled_rows(rows))
    assert got == side(labels.build_panel(rows)) and len({r[-1] for r in got}) == 2


def test_suppliers_scores_write_no_features(spark, monkeypatch):
    """The scores of the wide queries need labels only; neither a panel nor rows with features are written."""
    written, plain = [], labels.materialize
    monkeypatch.setattr(labels, "materialize", lambda df: written.append(df.columns) or plain(df))
    sf = "/root/testdata/sf0.001"
    got = fixtures.build_scores(spark, sf, names="supplier")
    assert got.columns == ["arm", "fold", "ticker", "Date", "Close", "label", "proba"] and got.count() > 0
    assert written == [["Date", "ticker", "Close", "complete", "fwd_ret", "label_end", "mkt_fwd"]]
    assert not any(key == f"panel supplier {sf}" for _, key in session._shared)


def test_labels_join_one_cut_a_date(spark):
    """Ranks don't go back to the rows by value: a date's cut is joined by date alone."""
    rows = random_market(22, "ABCDE", 90) + [("MKT", d, 50.0 + i) for i, d in enumerate(days(90))]
    panel = labels.add_labels(bars(spark, rows).select("ticker", "Date", "Close"), bars(spark, rows).where("ticker = 'MKT'"))
    plan = panel._jdf.queryExecution().optimizedPlan().toString()
    keys = [line for line in plan.splitlines() if "Join" in line]
    assert keys and not any("excess" in line for line in keys)


@pytest.mark.parametrize("role", ["train", "val", "test"])
def test_folds_of_one_role(spark, role):
    panel = bars(spark, [("A", d, 1.0) for d in days(1600)])
    every = folds.assign_folds(panel, 400, 90, 90)
    side = lambda df: sorted(tuple(r) for r in df.collect())
    assert side(folds.assign_folds(panel, 400, 90, 90, roles=(role,))) == side(every.where(F.col("role") == role)) != []
