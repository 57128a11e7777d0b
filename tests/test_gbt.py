"""The registered boosted-tree queries run the whole job."""

import random

import pytest

from panelspark.operators import model
from panelspark.plans import queries


def test_registered_fits_are_whole(monkeypatch, spark):
    asked = {}

    def score_folds(rows, **params):
        asked.update(params)
        return rows

    def evaluate_folds(rows, **params):
        asked.update(params)
        return rows

    monkeypatch.setattr(queries.fixtures, "panel", lambda *a: spark.range(1))
    monkeypatch.setattr(queries, "shared", lambda spark, key, build: build())
    monkeypatch.setattr(queries, "tidy", lambda rows: rows)
    monkeypatch.setattr(model, "score_folds", score_folds)
    monkeypatch.setattr(model, "evaluate_folds", evaluate_folds)
    queries.QUERIES["gbt_evaluation"](spark, "none")
    assert asked["rounds"] >= 300 and asked["depth"] == 6 and tuple(asked["seeds"]) == (0, 1, 2)
    assert asked["trials"] == 200


def test_best_round_waits_for_patience():
    errors = [5.0, 4.0, 4.5, 4.2, 3.9, 4.0, 4.1, 4.2, 1.0]
    assert model.best_round(errors, 3) == (5, True)  # the later 1.0 comes too late
    assert model.best_round(errors, 2) == (2, True)
    assert model.best_round(errors, 9) == (9, False)
    assert model.best_round([1.0] * 4, 3) == (1, True)
    assert model.best_round([3.0, 2.95, 2.0], 5, tol=0.1) == (3, False)


def noise(spark, signal):
    rng = random.Random(0)
    rows = [(rng.random(), rng.random()) for _ in range(600)]
    return spark.createDataFrame([(x, y, float(rng.random() < (0.9 if y > 0.5 else 0.1) if signal else rng.random() < 0.5))
                                  for x, y in rows], "x double, y double, label double")


def test_patience_ends_the_fit(monkeypatch, spark):
    monkeypatch.setattr(model, "model_columns", lambda df: ["x", "y"])
    rows = noise(spark, False)
    fitted = model.fit_fold(rows.where("x < 0.5"), rows.where("x >= 0.5"), rounds=30, depth=2, min_rows=10, patience=4)
    assert 1 <= fitted.trees.getNumTrees < 30


def test_first_stop_ends_the_fit(monkeypatch, spark):
    monkeypatch.setattr(model, "model_columns", lambda df: ["x", "y"])
    rows = noise(spark, False)
    fitted = model.fit_fold(rows.where("x < 0.5"), rows.where("x >= 0.5"), rounds=30, depth=2, min_rows=10)
    assert 1 <= fitted.trees.getNumTrees < 30


def test_bad_rounds_before_better_ones(monkeypatch, spark):
    """Errors that rise and fall below the first again: the later round stays, with the trees of the longer fit."""
    monkeypatch.setattr(model, "model_columns", lambda df: ["x", "y"])
    kind, given = model.GBTClassificationModel, []
    errors = [1.0, 1.5, 1.4, 0.5] + [0.9] * 30

    def evaluate(self, dataset):
        given.append(self.getNumTrees)
        return errors[:self.getNumTrees]

    monkeypatch.setattr(kind, "evaluateEachIteration", evaluate)
    rows = noise(spark, True)
    sides = rows.where("x < 0.5"), rows.where("x >= 0.5")
    fitted = model.fit_fold(*sides, rounds=30, depth=2, min_rows=10, patience=3)
    assert given == [4, 8] and fitted.trees.getNumTrees == 4
    longer = model.fit_fold(*sides, rounds=4, depth=2, min_rows=10, patience=9)
    assert [t.toDebugString.split("\n", 1)[1] for t in fitted.trees.trees] == [
        t.toDebugString.split("\n", 1)[1] for t in longer.trees.trees]
    given.clear()
    assert model.fit_fold(*sides, rounds=30, depth=2, min_rows=10, patience=2).trees.getNumTrees == 1


def test_fits_take_as_many_tasks_as_their_rows_fill(monkeypatch, spark):
    """A fold's rows in many small files are fitted on few tasks; more rows take more."""
    class Seen(Exception):
        pass

    met = []

    def fit_fold(train, val, seed, **params):
        met.append((train.rdd.getNumPartitions(), val.rdd.getNumPartitions(), train.count(), val.count()))
        raise Seen

    rows = spark.range(200 * 1700).selectExpr(
        "concat('S', id % 200) AS ticker", "date_add(DATE'2020-01-01', CAST(id / 200 AS INT)) AS Date", "1.0D AS Close",
        "CAST(id % 5 = 0 AS DOUBLE) AS label", "date_add(DATE'2020-01-01', CAST(id / 200 AS INT) + 20) AS label_end")
    plain = model.materialize
    monkeypatch.setattr(model, "materialize", lambda df: plain(df.repartition(8)))
    monkeypatch.setattr(model, "fit_fold", fit_fold)
    with pytest.raises(Seen):
        model.score_folds(rows, parallel=1)
    train, val, train_rows, val_rows = met[0]
    assert val == 1 and 1 < train == -(-train_rows // model.TASK_ROWS) < 8 and val_rows < model.TASK_ROWS


def test_registered_fits_wait_for_better_rounds(monkeypatch, spark):
    """As the reference's fits, the registered ones don't end at the first round without a gain."""
    asked = {}

    def score_folds(rows, **params):
        asked.update(params)
        return rows

    monkeypatch.setattr(queries.fixtures, "panel", lambda *a: spark.range(1))
    monkeypatch.setattr(queries, "shared", lambda spark, key, build: build())
    monkeypatch.setattr(model, "score_folds", score_folds)
    queries.gbt_rows(spark, "none")
    assert asked["patience"] >= 20 and asked["rounds"] >= 300


def test_rounds_tried_first_change_no_tree(monkeypatch, spark):
    monkeypatch.setattr(model, "model_columns", lambda df: ["x", "y"])
    rows = noise(spark, True)
    sides = rows.where("x < 0.5"), rows.where("x >= 0.5")
    made = [model.fit_fold(*sides, rounds=30, depth=2, min_rows=10, patience=2, start=n).trees for n in (0, 3, 17)]
    assert 1 <= made[0].getNumTrees < 30
    assert len({tuple(t.toDebugString.split("\n", 1)[1] for t in m.trees) for m in made}) == 1


@pytest.mark.parametrize("patience", [0, 4])
def test_every_fold_and_seed_is_fitted_once(monkeypatch, spark, patience):
    """With patience the first seed of a fold goes ahead and tells the others how many rounds to try."""
    met = []

    class Fitted:
        class trees:
            getNumTrees = 7

    def fit_fold(train, val, seed, **params):
        met.append((seed, params["patience"], params["start"]))
        return Fitted

    rows = spark.range(20 * 1700).selectExpr(
        "concat('S', id % 20) AS ticker", "date_add(DATE'2020-01-01', CAST(id / 20 AS INT)) AS Date", "1.0D AS Close",
        "CAST(id % 5 = 0 AS DOUBLE) AS label", "date_add(DATE'2020-01-01', CAST(id / 20 AS INT) + 20) AS label_end")
    monkeypatch.setattr(model, "fit_fold", fit_fold)
    monkeypatch.setattr(model, "score", lambda fitted, rows: rows.selectExpr("*", "0.5D AS proba"))
    out = model.score_folds(rows, seeds=(0, 1, 2), patience=patience)
    spread = out.groupBy("fold", "seed").count().collect()
    folds = {r["fold"] for r in spread}
    assert {(r["fold"], r["seed"]) for r in spread} == {(f, s) for f in folds for s in (0, 1, 2)}
    assert sorted(met) == sorted((s, patience, 15 if patience and s else 0) for _ in folds for s in (0, 1, 2))
