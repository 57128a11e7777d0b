import random

import pytest
from pyspark.sql import functions as F

from panelspark.operators import brake, evaluate, ledger, select
from tests.helpers import as_dict, bars, day, days

BOOK = "d0 DATE, ticker STRING, weight DOUBLE"


def book(spark, months):
    rows = [(d, t, w) for d, names in months for t, w in names.items()]
    return spark.createDataFrame(rows, BOOK)


def dates(spark, ds):
    return spark.createDataFrame([(d,) for d in ds], "d0 DATE")


def test_turnover_replacement_and_resizing(spark):
    a, b, c = days(3)
    for after, want in (({"C": 0.5, "D": 0.5}, 1.0), ({"A": 1 / 3, "B": 1 / 3, "C": 1 / 3}, 1 / 3)):
        books = book(spark, [(a, {"A": 0.5, "B": 0.5}), (b, after)])
        got = [r.turnover for r in ledger.turnover(books, dates(spark, [a, b, c])).orderBy("m").collect()]
        assert got == [pytest.approx(0.5), pytest.approx(want), pytest.approx(0.5)]


def legs(spark, closes, horizon, stop=None, short=False):
    ds = days(len(closes))
    rows = [("X", d, c) for d, c in zip(ds, closes)] + [("OTHER", d, 1.0) for d in ds]
    px = bars(spark, rows)
    picks = spark.createDataFrame([("X", ds[0])], "ticker STRING, d0 DATE")
    got = ledger.leg_returns(picks, px, horizon=horizon, stop=stop, short=short).collect()
    return got[0].ret if got else None


def test_gap_stop_realises_the_actual_close(spark):
    assert legs(spark, [100.0, 80.0, 90.0], 2, 0.85) == pytest.approx(-0.20)
    assert legs(spark, [100.0, 90.0, 90.0], 2, 0.85) == pytest.approx(-0.10)
    with pytest.raises(ValueError):
        legs(spark, [100.0, 80.0], 2, 2.0)


def test_short_leg_and_short_stop(spark):
    assert legs(spark, [100.0, 80.0], 1, short=True) == pytest.approx(0.25)
    assert legs(spark, [100.0, 125.0, 80.0], 2, 0.85, short=True) == pytest.approx(100 / 125 - 1)


def test_missing_entry_or_exit_drops_the_leg(spark):
    assert legs(spark, [None, 100.0, 100.0], 2) is None
    assert legs(spark, [100.0, None, None], 2) is None
    assert legs(spark, [100.0, 70.0, None], 2, 0.85) == pytest.approx(-0.30)


def test_leg_truncation(spark):
    assert legs(spark, [100.0], 20) == 0.0
    assert legs(spark, [100.0, 110.0], 20) == pytest.approx(0.10)


def test_first_month_drawdown_counts(spark):
    rows = spark.createDataFrame([(d, n) for d, n in zip(days(2), (-0.2, 0.125))], "d0 DATE, net DOUBLE")
    assert evaluate.summarize(rows).first().max_dd == pytest.approx(-0.20)


def test_flat_prices_only_cost(spark):
    ds = days(40)
    px = bars(spark, [(t, d, 100.0) for t in "ABCD" for d in ds])
    held = {t: 0.25 for t in "ABCD"}
    books = book(spark, [(ds[0], held), (ds[20], held)])
    nets = [r.net for r in ledger.run_book(books, books, px, cost_bps=25.0).orderBy("d0").collect()]
    assert nets == [pytest.approx(-0.5 * 25e-4), pytest.approx(0.0)]


def random_market(seed, tickers="ABCDEF", n=120):
    rng = random.Random(seed)
    rows = []
    for t in tickers:
        p = 100.0
        for d in days(n):
            p *= 1 + rng.gauss(0, 0.02)
            if rng.random() > 0.15:
                rows.append((t, d, p))
    return rows


def momentum_like_ledger(spark, rows):
    px = bars(spark, rows)
    scored = px.select("ticker", "Date", "Close", (F.crc32("ticker") % 97 / 97.0).alias("proba"))
    cands = select.candidates(scored, [])
    picks = select.pick_threshold(cands, 0.0, 3, keys=[])
    out = ledger.run_book(picks, cands, px, cost_bps=10.0, stop=0.95)
    return {r.d0: (round(r.net, 10), round(r.turnover, 10)) for r in out.collect()}


def test_metamorphic_scale_and_order(spark):
    rows = random_market(11)
    base = momentum_like_ledger(spark, rows)
    assert len(base) > 2
    assert momentum_like_ledger(spark, [(t, d, 2 * c) for t, d, c in rows]) == base
    random.Random(3).shuffle(rows)
    assert momentum_like_ledger(spark, rows) == base


def test_cash_and_survivor_rules(spark):
    ds = days(3)
    px = bars(spark, [("A", ds[0], 100.0), ("A", ds[1], 110.0), ("B", ds[0], 100.0), ("C", ds[1], 1.0)])
    books = book(spark, [(ds[0], {"A": 0.5, "B": 0.5})])
    cash = ledger.run_book(books, books, px, cost_bps=0.0).first()
    alive = ledger.run_book(books, books, px, cost_bps=0.0, missing="survivors").first()
    assert (cash.gross, alive.gross) == (pytest.approx(0.05), pytest.approx(0.10))


def test_borrow_cost(spark):
    ds = days(2)
    px = bars(spark, [(t, d, 100.0) for t in "AB" for d in ds])
    books = book(spark, [(ds[0], {"A": 0.5, "B": -0.5})])
    row = ledger.run_book(books, books, px, cost_bps=0.0, borrow_apr=0.06, shorts=True).first()
    assert row.net == pytest.approx(-0.5 * 0.06 / 12)


def test_brake_matches_plain_fold(spark):
    rng = random.Random(5)
    ds = days(12)
    months, gross = [], []
    for d in ds:
        names = rng.sample("ABCDE", rng.randint(0, 4))
        months.append((d, {t: 1 / len(names) for t in names}))
        gross.append(rng.gauss(0, 0.06) if names else 0.0)
    books = book(spark, months).withColumn("s", F.lit("x"))
    g = spark.createDataFrame([("x", d, v) for d, v in zip(ds, gross)], "s STRING, d0 DATE, gross DOUBLE")
    every = dates(spark, ds).withColumn("s", F.lit("x"))
    got = {(r.cost_bps, r.d0): r for r in brake.brake_ledger(books, g, every, [0.0, 25.0], ["s"], 0.05).collect()}
    seen = set()
    for bps in (0.0, 25.0):
        equity = peak = 1.0
        before = {}
        for (d, raw), raw_gross in zip(months, gross):
            f = 0.5 if equity / peak - 1 < -0.05 else 1.0
            w = {t: v * f for t, v in raw.items()}
            traded = 0.5 * sum(abs(w.get(t, 0) - before.get(t, 0)) for t in set(w) | set(before))
            net = raw_gross * f - traded * bps / 1e4
            equity *= 1 + net
            peak = max(peak, equity)
            before = w
            r = got[(bps, d)]
            assert (r.exposure, r.turnover, r.net, r.equity) == tuple(pytest.approx(x) for x in (f, traded, net, equity))
            seen.add(f)
    assert seen == {0.5, 1.0}


def test_sticky_matches_plain_loop(spark):
    rng = random.Random(9)
    ends = [day(f"2020-{m:02d}-{rng.randint(24, 28)}") for m in range(1, 13)]
    rows = [("x", d, d.replace(day=1), t, rng.random()) for d in ends for t in "ABCDEFGH" if rng.random() > 0.2]
    cands = spark.createDataFrame(rows, "s STRING, d0 DATE, month DATE, ticker STRING, proba DOUBLE")
    got = {}
    for r in select.pick_sticky(cands, 40, 0.3, 4, ["s"]).orderBy("d0", "rn").collect():
        got.setdefault(r.d0, []).append(r.ticker)
    hold = {}
    for d in ends:
        ranked = sorted([(-p, t) for _, dd, _, t, p in rows if dd == d and p >= 0.3])
        fresh = [t for _, t in ranked][:4]
        kept = [t for t, since in hold.items() if (d - since).days < 40]
        want = (kept + [t for t in fresh if t not in kept])[:4]
        assert got.get(d, []) == want
        for t in fresh:
            hold[t] = d


def test_long_short_needs_both_sides(spark):
    d1, d2 = days(2)
    rows = [(d1, "A", 0.9), (d1, "B", 0.8), (d1, "C", 0.1), (d2, "A", 0.9), (d2, "B", 0.95)]
    cands = spark.createDataFrame(rows, "d0 DATE, ticker STRING, proba DOUBLE")
    got = {(r.d0, r.ticker): r.weight for r in select.pick_long_short(cands, 0.3, 2, 1, keys=[]).collect()}
    assert got == {(d1, "A"): 0.25, (d1, "B"): 0.25, (d1, "C"): -0.5}


def test_boundary_full_book_and_gate(spark):
    d1, d2 = days(2)
    rows = [(d1, t, p) for t, p in zip("ABCD", (0.40, 0.35, 0.30, 0.20))] + [(d2, t, p) for t, p in zip("ABC", (0.40, 0.24, 0.20))]
    got = as_dict(select.boundary(spark.createDataFrame(rows, "d0 DATE, ticker STRING, proba DOUBLE"), 0.25, 2, []), "d0")
    assert (got[(d1,)].picks, got[(d1,)].boundary) == (["A", "B"], 0.35)
    assert (got[(d2,)].picks, got[(d2,)].boundary) == (["A"], 0.25)


def test_momentum_cap_truncates_ties_in_both_orders(spark):
    d = days(1)[0]
    rows = [(d, f"T{i:02d}", 1.0) for i in range(12)]
    mom = spark.createDataFrame(rows, "d0 DATE, ticker STRING, mom DOUBLE")
    for order in ("ticker", "score"):
        got = sorted(r.ticker for r in select.pick_momentum(mom, 0.1, order).collect())
        assert got == [f"T{i:02d}" for i in range(5)]
    assert select.pick_momentum(mom, 0.1, None).count() == 12


def test_inverse_vol_fallbacks(spark):
    d1, d2 = days(2)
    picks = spark.createDataFrame([(d1, "A", 0.5), (d1, "B", 0.5), (d2, "A", 1.0)], BOOK)
    vol = spark.createDataFrame([("A", d1, 0.1), ("B", d1, 0.3), ("A", d2, None)], "ticker STRING, Date DATE, vol DOUBLE")
    got = {(r.d0, r.ticker): r.weight for r in select.weight_inverse_vol(picks, vol, []).collect()}
    assert got == {(d1, "A"): pytest.approx(0.75), (d1, "B"): pytest.approx(0.25), (d2, "A"): 1.0}
    zero = select.weight_inverse_vol(picks, vol, [], "zero").where(F.col("d0") == F.lit(d2)).first()
    assert zero.weight == 0.0


def test_null_books_repeat_and_differ_by_seed(spark):
    cands = spark.createDataFrame([(days(1)[0], f"T{i}") for i in range(30)], "d0 DATE, ticker STRING")
    runs = [{(r.trial, r.ticker) for r in ledger.null_books(cands, 4, 5, s, []).collect()} for s in (0, 0, 1)]
    assert runs[0] == runs[1] != runs[2] and len(runs[0]) == 20


def test_null_books_draw_names_evenly_and_all_of_a_short_list(spark):
    d1, d2 = days(2)
    rows = [(d1, f"T{i}") for i in range(12)] + [(d2, "A"), (d2, "B"), (d2, "B")]
    book = ledger.null_books(spark.createDataFrame(rows, "d0 DATE, ticker STRING"), 2000, 5, 0, [])
    drawn = {}
    for r in book.where(F.col("d0") == F.lit(d1)).groupBy("ticker").count().collect():
        drawn[r.ticker] = r["count"]
    # each name is in 5 of 12 books on average, 833 of 2,000; six standard deviations are 132
    assert len(drawn) == 12 and sum(drawn.values()) == 10_000 and all(abs(c - 833) < 132 for c in drawn.values())
    short = book.where(F.col("d0") == F.lit(d2))
    assert {(r.ticker, r.weight, r["count"]) for r in short.groupBy("ticker", "weight").count().collect()} == {
        ("A", 0.5, 2000), ("B", 0.5, 2000)}


def test_trend_stride_carries_the_book(spark):
    ds = [day(f"2020-{m:02d}-15") for m in range(1, 7)]
    px = bars(spark, [(t, d, 1.0) for t in "AB" for d in ds])
    above = [("A", ds[i], i in (3, 4)) for i in range(1, 6)] + [("B", ds[i], True) for i in range(1, 6)]
    signal = spark.createDataFrame(above, "ticker STRING, Date DATE, above BOOLEAN")
    got = {}
    for r in select.pick_trend(signal, px, 3).collect():
        got.setdefault(r.d0, set()).add(r.ticker)
    # month 0 has no signal, so months 1 and 2 stay in cash; month 3 decides for 3, 4, 5
    assert got == {ds[3]: {"A", "B"}, ds[4]: {"A", "B"}, ds[5]: {"A", "B"}}
