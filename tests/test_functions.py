import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark.functions import columns, joins, ranks, windows
from tests.helpers import day, days


def test_month_end_guard(spark):
    rows = [("2026-09-30", "2026-09-30", True), ("2026-10-30", "2026-10-30", True), ("2026-09-11", "2026-09-14", False),
            ("2026-08-20", "2026-09-01", True)]
    df = spark.createDataFrame([(day(a), day(b), c) for a, b, c in rows], "a DATE, b DATE, want BOOLEAN")
    assert all(r.got == r.want for r in df.select(columns.is_month_end("a", "b").alias("got"), "want").collect())


def test_realized_month(spark):
    df = spark.createDataFrame([(day("2020-02-28"),)], "d DATE")
    assert df.select(columns.realized_month("d")).first()[0] == day("2020-03-31")


def test_distance_bins_are_right_closed(spark):
    values = [0.0, 0.01, 0.011, 0.05, 0.1, 0.2]
    df = spark.createDataFrame([(v,) for v in values], "v DOUBLE")
    assert [r[0] for r in df.select(columns.distance_bin("v")).collect()] == [
        "0-1 pp", "0-1 pp", "1-2 pp", "2-5 pp", "5-10 pp", ">10 pp"]


def test_officer_predicate(spark):
    titles = {"CEO": True, "Dir": False, "Dir, President": True, None: False, "cfo": True}
    df = spark.createDataFrame([(t,) for t in titles], "t STRING")
    assert [r[0] for r in df.select(columns.is_csuite("t")).collect()] == list(titles.values())


def random_groups(seed, n=400):
    rng = random.Random(seed)
    # one group holds most rows and many ties
    return [("hot" if rng.random() < 0.6 else rng.choice("abc"),
             None if rng.random() < 0.1 else round(rng.gauss(0, 1), 1 if rng.random() < 0.5 else 6)) for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_average_rank_matches_pandas(spark, seed):
    rows = [(i, g, v) for i, (g, v) in enumerate(random_groups(seed))]
    df = spark.createDataFrame(rows, "i INT, g STRING, v DOUBLE")
    got = {r.i: (r.r, r.p) for r in ranks.average_rank(
        ranks.average_rank(df, ["g"], "v", "r"), ["g"], "v", "p", pct=True).collect()}
    pdf = pd.DataFrame(rows, columns=["i", "g", "v"])
    want, pct = pdf.groupby("g")["v"].rank(), pdf.groupby("g")["v"].rank(pct=True)
    assert len(got) == len(rows)
    for i, w, p in zip(pdf.i, want, pct):
        assert (got[i][0] is None) == np.isnan(w)
        if not np.isnan(w):
            assert got[i] == (pytest.approx(w), pytest.approx(p))


def test_average_rank_without_group(spark):
    rows = [(i, v) for i, (_, v) in enumerate(random_groups(5))]
    df = spark.createDataFrame(rows, "i INT, v DOUBLE")
    got = {r.i: r.r for r in ranks.average_rank(df, [], "v", "r").collect()}
    want = pd.Series({i: v for i, v in rows}, dtype=float).rank()
    assert all(got[i] == pytest.approx(want[i]) for i, v in rows if v is not None)


@pytest.mark.parametrize("q", [0.1, 0.5, 0.9, 1.0])
def test_group_quantile_matches_numpy(spark, q):
    rows = random_groups(3)
    df = spark.createDataFrame(rows, "g STRING, v DOUBLE")
    got = {r.g: (r.total, r.q) for r in ranks.group_quantile(df, ["g"], "v", q).collect()}
    for g in {g for g, _ in rows}:
        values = [v for k, v in rows if k == g and v is not None]
        assert got[g] == (len(values), pytest.approx(np.quantile(values, q)))


def test_bounded_rank_matches(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 2.0), ("a", None), ("b", 3.0)], "g STRING, v DOUBLE")
    got = sorted((r.g, r.v or -1, r.r) for r in df.select("g", "v", ranks.bounded_rank(["g"], "v").alias("r")).collect())
    assert got == [("a", -1, None), ("a", 1.0, 1.0), ("a", 2.0, 2.5), ("a", 2.0, 2.5), ("b", 3.0, 1.0)]


@pytest.mark.parametrize("unique", [False, True])
def test_asof_join(spark, unique):
    rng = random.Random(7)
    base = days(60)
    left = [(rng.choice("ab"), rng.choice(base), i) for i in range(80)]
    if unique:
        left = list({(k, d): (k, d, i) for k, d, i in left}.values())
    right = [(k, d, float(j)) for k in "ab" for j, d in enumerate(rng.sample(base, 8))]
    got = joins.asof_join(spark.createDataFrame(left, "k STRING, d DATE, i INT"),
                          spark.createDataFrame(right, "k STRING, t DATE, v DOUBLE"), ["k"], "d", "t", unique_left=unique)
    result = {r.i: (r.t, r.v) for r in got.collect()}
    assert len(result) == len(left)
    for k, d, i in left:
        past = [(t, v) for kk, t, v in right if kk == k and t <= d]
        assert result[i] == (max(past) if past else (None, None))


def test_sessions_and_decisions(spark):
    rows = [("a", day("2020-01-02"), 1.0), ("b", day("2020-01-03"), 1.0), ("a", day("2020-02-03"), 1.0)]
    df = spark.createDataFrame(rows, "ticker STRING, Date DATE, Close DOUBLE")
    placed = {(r.ticker, r.Date): (r.ord, r.last_ord) for r in windows.with_sessions(df).collect()}
    assert placed == {("a", day("2020-01-02")): (1, 3), ("b", day("2020-01-03")): (2, 3), ("a", day("2020-02-03")): (3, 3)}
    assert [(r.m, r.d0) for r in windows.decision_dates(df).orderBy("m").collect()] == [
        (1, day("2020-01-03")), (2, day("2020-02-03"))]


def test_set_overlap_empty(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], [])], "x ARRAY<STRING>, y ARRAY<STRING>")
    parts = joins.set_overlap(F.col("x"), F.col("y"))
    rows = df.select(*[c.alias(k) for k, c in parts.items()]).collect()
    assert (rows[0].jaccard, rows[0].exact_match) == (pytest.approx(1 / 3), False)
    assert (rows[1].jaccard, rows[1].exact_match) == (None, True)


def test_same_rows(spark):
    a, b = [spark.createDataFrame([(v,) for v in vs], "v INT") for vs in ([1, 1, 2], [1, 2, 2])]
    assert joins.same_rows(a, a) and not joins.same_rows(a, b)


def test_ordered_counts_of_one_large_group(spark):
    n = 200_000
    df = spark.range(n).select(F.lit("g").alias("g"), ((F.col("id") * 7919) % n).cast("double").alias("v"))
    got = ranks.ordered_counts(df, ["g"], "v").agg(
        F.count("*").alias("rows"), F.sum(F.abs(F.col("below") - F.col("v"))).alias("off"), F.max("total").alias("total")).first()
    assert (got.rows, got.off, got.total) == (n, 0.0, n)


def test_ordered_counts_of_many_groups_with_ties_and_nulls(spark):
    rows = [(f"g{i % 3}", None if i % 11 == 0 else float(i % 17)) for i in range(500)] + [("lone", 1.0), ("none", None)]
    df = spark.createDataFrame(rows, "g STRING, v DOUBLE")
    known = [(g, v) for g, v in rows if v is not None]
    want = {(g, v): (sum(x == (g, v) for x in known), sum(h == g and w < v for h, w in known), sum(h == g for h, _ in known))
            for g, v in known}
    got = {(r.g, r.v): (r.n, r.below, r.total) for r in ranks.ordered_counts(df, ["g"], "v").collect()}
    assert got == want
    assert ranks.ordered_counts(df.where("g = 'none'"), [], "v").count() == 0


def test_overlap_by_count(spark):
    from panelspark.functions.joins import overlap_by_count
    left = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "a"), (4, None)], "m int, ticker string")
    right = spark.createDataFrame([(1, "b"), (1, "c"), (2, "a"), (3, "x"), (4, None)], "m int, ticker string")
    got = {r["m"]: tuple(r)[1:] for r in overlap_by_count(left, right, ["m"], empty=1.0).collect()}
    assert got == {1: (2, 2, 1, 3, pytest.approx(1 / 3), False), 2: (1, 1, 1, 1, 1.0, True), 3: (0, 1, 0, 1, 0.0, False),
                   4: (0, 0, 0, 0, 1.0, True)}
