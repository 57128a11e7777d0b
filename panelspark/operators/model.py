"""Boosted trees per fold with isotonic calibration, on MLlib."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor, as_completed
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from panelspark.operators import folds
from panelspark.operators.features import model_columns
from panelspark.session import materialize


#: Columns of scored rows besides the arm and the seed.
SCORED = "ticker STRING, Date DATE, Close DOUBLE, label DOUBLE, proba DOUBLE"


#: Rows of one task of a fit.
TASK_ROWS = 50_000


@dataclass
class FoldModel:
    features: VectorAssembler
    trees: GBTClassificationModel
    calibration: IsotonicRegressionModel


def _raw(model: GBTClassificationModel, rows: DataFrame) -> DataFrame:
    scored = model.transform(rows)
    return scored.withColumn("raw", vector_to_array("probability")[1]).drop(
        "prediction", "probability", "rawPrediction")


def best_round(errors: Sequence[float], patience: int, tol: float = 0.0) -> tuple[int, bool]:
    """Rounds up to the best one before ``patience`` rounds without a gain above ``tol``, and whether that many came."""
    best = 0
    for k, error in enumerate(errors):
        if error < errors[best] - tol:
            best = k
        elif k - best >= patience:
            return best + 1, True
    return best + 1, False


def fit_trees(train: DataFrame, val: DataFrame, seed: int, rounds: int, depth: int, min_rows: int, patience: int,
              tol: float, start: int = 0) -> GBTClassificationModel:
    """Trees up to the round of the least validation error.

    Without patience, MLlib ends the fit at the first round without a gain. With it,
    all prefixes of a fit are evaluated in one pass. While no ``patience`` rounds went by without a gain, the fit is done
    with twice the rounds; a fit with the same seed begins with the same trees, so the best prefix is the fit with as many. ``start`` is how many
    rounds are tried first; the result is the same for any.
    """
    def booster(n: int) -> GBTClassifier:
        return GBTClassifier(featuresCol="features", labelCol="label", maxIter=n, maxDepth=depth, seed=seed,
                             minInstancesPerNode=min_rows, subsamplingRate=0.8)

    if not patience:
        both = train.withColumn("is_val", F.lit(False)).unionByName(val.withColumn("is_val", F.lit(True)))
        return booster(rounds).setValidationIndicatorCol("is_val").setParams(validationTol=tol).fit(both)
    n = min(rounds, start or patience + max(1, patience // 2))
    while True:
        trees = booster(n).fit(train)
        best, over = best_round(trees.evaluateEachIteration(val), patience, tol)
        if over or n == rounds:
            return trees if best == n else booster(best).fit(train)
        n = min(rounds, 2 * n)


def fit_calibration(held: DataFrame, raw: str = "raw", label: str = "label") -> IsotonicRegressionModel:
    """Isotonic fit of the labels on raw scores."""
    return IsotonicRegression(featuresCol=raw, labelCol=label).fit(held.select(raw, label))


def calibrated(model: IsotonicRegressionModel, rows: DataFrame) -> DataFrame:
    """``rows`` with ``proba``, the calibrated score within 0 and 1."""
    bounded = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("prediction")))
    return model.transform(rows).withColumn("proba", bounded).drop("prediction")


def fit_fold(train: DataFrame, val: DataFrame, seed: int = 0, rounds: int = 20, depth: int = 5,
             min_rows: int = 200, tol: float = 0.0, patience: int = 0, start: int = 0) -> FoldModel:
    """Fit trees on the training rows, keep the rounds up to the best on the validation rows, calibrate on validation."""
    cols = model_columns(train)
    assembler = VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="error")
    fit, held = [assembler.transform(d.select(*cols, "label")).select("features", "label") for d in (train, val)]
    trees = fit_trees(fit, held, seed, rounds, depth, min_rows, patience, tol, start)
    return FoldModel(assembler, trees, fit_calibration(_raw(trees, held)))


def score(model: FoldModel, rows: DataFrame) -> DataFrame:
    """Calibrated probability of the top class for every row."""
    return calibrated(model.calibration, _raw(model.trees, model.features.transform(rows))).drop("features", "raw")


def tasks(rows: int) -> int:
    """Tasks of a fit. A tree takes a job per level, so tasks of few rows cost more to start than to run."""
    return max(1, -(-rows // TASK_ROWS))


def score_folds(panel: DataFrame, seeds: Sequence[int] = (0,), arm: str = "corrected", parallel: int = 12,
                patience: int = 0, **params) -> DataFrame:
    """Scored test rows of every fold that passes the gate, and seed.

    The panel is written once, in the order of dates; each fold reads its own range of dates from it, without a copy. Each
    fit is a distributed job on as many tasks as its rows fill; several run at once. Scores are written out as they depend on the fitted trees.
    With ``patience`` a fold's first seed is fitted ahead; the others try as many rounds at once as it took and a margin, so that they seldom start anew.
    """
    spark = panel.sparkSession
    rows = materialize(panel.repartitionByRange("Date", "ticker").sortWithinPartitions("Date"))
    sizes = materialize(folds.fold_sizes(folds.purge(folds.assign_folds(rows))))
    gate = folds.gated(sizes).join(sizes, "fold")
    spans = folds.fold_calendar(rows).join(F.broadcast(gate), "fold").orderBy("fold").collect()

    def one(span: Row, seed: int, start: int = 0) -> tuple[DataFrame, int]:
        here = folds.fold_rows(rows, span)
        train, val = [here.where(F.col("role") == r).coalesce(tasks(span[r])) for r in ("train", "val")]
        model = fit_fold(train, val, seed, patience=patience, start=start, **params)
        scored = score(model, here.where("role = 'test'"))
        done = materialize(scored.select(F.lit(arm).alias("arm"), F.lit(span.fold).alias("fold"), F.lit(seed).alias("seed"),
                                         "ticker", "Date", "Close", "label", "proba"))
        return done, model.trees.getNumTrees + 2 * patience

    ahead = seeds[:1] if patience else seeds
    with ThreadPoolExecutor(parallel) as pool:
        firsts = {pool.submit(one, span, s): span for span in spans for s in ahead}
        rest = [pool.submit(one, firsts[f], s, f.result()[1]) for f in as_completed(firsts) for s in seeds[len(ahead):]]
        parts = [f.result()[0] for f in [*firsts, *rest]]
    if not parts:  # the gate left no fold
        return spark.createDataFrame([], StructType.fromDDL(f"arm STRING, fold INT, seed INT, {SCORED}"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def evaluate_folds(scored: DataFrame, px: DataFrame | None = None, thresh: float = 0.30, n: int = 10,
                   cost_bps: float = 5.0, trials: int = 50) -> DataFrame:
    """Per fold and seed: AUC, ledger summary and the random-book null."""
    from panelspark.operators import evaluate, ledger, select
    keys = ["arm", "fold", "seed"]
    rows = materialize(scored)
    cands = materialize(select.candidates(rows, keys))
    book = select.pick_threshold(cands, thresh, n, keys)
    result = ledger.run_book(book, cands, rows, keys, keys, cost_bps=cost_bps)
    null = ledger.null_books(cands, trials, n, keys=keys)
    null_cands = cands.select(*keys, "d0").distinct().withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))
    null_ledger = ledger.run_book(null, null_cands, rows, [*keys, "trial"], keys, cost_bps=cost_bps)
    null_end = evaluate.null_summary(evaluate.summarize(null_ledger, [*keys, "trial"]), keys)
    return (evaluate.auc(rows, keys).join(evaluate.summarize(result, keys), keys)
            .join(null_end, keys))
