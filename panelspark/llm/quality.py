"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Every line is good or bad. A line's evidence is a weighted sum of its own features and those of the lines before and
behind it; a transition weight couples neighbouring labels. Forward-backward gives each line's
probability of being good; their mean, weighted by length, is brought to the scale of the document labels by a
monotone logistic curve.

Training takes the ``sample`` labelled documents of smallest hash among those that are not held out; only their features
reach the driver. Lines of documents labelled 1 are good. Those of documents labelled 0 start as bad;
after the first fit the ones it finds clearly good are taken as good, save the worst line of each, and
the weights are fitted once more.

Scoring needs no shuffle: documents are scored where they are read.

Defined results: a null or empty text is one empty line; a label given more than once counts if all agree; without
both labels every score is the share of label 1 (0.5 without any); repeated rows give repeated results; an empty
table gives an empty result. Id, language, source and labels are never features.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FOLDS = 5
CUT = 0.3
SYMBOL = re.compile(r"[#*$%&|<>]")
OTHER = re.compile(r"[^\w\s]")
DIGIT = re.compile(r"[0-9]")
UPPER = str.maketrans("", "", "abcdefghijklmnopqrstuvwxyz")
N_OWN = 12


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(lines, N_OWN) features and the lines' lengths; lines without a word are left out."""
    rows, sizes, seen = [], [], set()
    for line in (text or "").split("\n"):
        words = line.split()
        if not words:
            continue
        n, size = len(words), len(line)
        chars = size - line.count(" ")
        lower = line.lower()
        upper = sum(a != b for a, b in zip(line, lower)) if len(lower) == size and lower != line else 0
        rows.append((
            np.log1p(n), chars / n, len(SYMBOL.findall(line)) / n, upper / size, len(DIGIT.findall(line)) / size,
            len(OTHER.findall(line)) / n, len(set(words)) / n, float(line in seen), float(line[-1] in ".!?"),
            float(line[:1].isupper()), line.count("!") / n, len(set(zip(words, words[1:], words[2:]))) / max(1, n - 2)))
        seen.add(line)
        sizes.append(size)
    if not rows:
        return np.zeros((1, N_OWN)), np.ones(1)
    return np.array(rows, float), np.array(sizes, float)


def with_neighbours(own: np.ndarray) -> np.ndarray:
    none = np.zeros((1, N_OWN))
    flags = np.zeros((len(own), 2))
    flags[0, 0] = flags[-1, 1] = 1
    return np.hstack([own, np.vstack([none, own[:-1]]), np.vstack([own[1:], none]), flags])


def forward_backward(score: list[np.ndarray], trans: np.ndarray):
    """Chains of two states, state 1 with evidence ``score`` and state 0 with none.

    Returns the probability of state 1 for each line, and the expected transitions of all chains. Chains advance together,
    longest first.
    """
    order = sorted(range(len(score)), key=lambda i: -len(score[i]))
    longest = len(score[order[0]])
    lengths = np.array([len(score[i]) for i in order])
    alive = np.searchsorted(-lengths, -np.arange(1, longest + 1), side="right")
    cols = [np.array([score[order[k]][t] for k in range(alive[t])]) for t in range(longest)]
    emit = [np.stack([np.zeros_like(c), c], axis=1) for c in cols]
    ahead = [emit[0]]
    for t in range(1, longest):
        last = ahead[-1][:alive[t]]
        ahead.append(emit[t] + np.logaddexp(last[:, :1] + trans[0], last[:, 1:] + trans[1]))
    behind: list = [None] * longest
    follow = np.zeros((0, 2))
    for t in range(longest - 1, -1, -1):
        now = np.zeros((alive[t], 2))
        now[:len(follow)] = follow
        behind[t] = now
        if t:
            up = now + emit[t]
            follow = np.logaddexp(up[:, :1] + trans[:, 0], up[:, 1:] + trans[:, 1])
    out = [np.empty(len(s)) for s in score]
    pairs = np.zeros((2, 2))
    for t in range(longest):
        both = ahead[t] + behind[t]
        total = np.logaddexp(both[:, 0], both[:, 1])
        for k, p in enumerate(np.exp(both[:, 1] - total)):
            out[order[k]][t] = p
        if t:
            m = alive[t]
            joint = (ahead[t - 1][:m, :, None] + trans[None] + (emit[t] + behind[t])[:, None, :] - total[:, None, None])
            pairs += np.exp(joint).sum(axis=0)
    return out, pairs


class Chain:
    """Weights of the field, scaling of the features, and the logistic curve of documents."""

    def __init__(self):
        self.mean = self.scale = self.weights = None
        self.trans = np.zeros((2, 2))
        self.curve = (1.0, 0.0)
        self.constant: float | None = None

    def evidence(self, own: np.ndarray) -> np.ndarray:
        x = np.clip((with_neighbours(own) - self.mean) / self.scale, -5, 5)
        return x @ self.weights[:-1] + self.weights[-1]

    def fit_lines(self, docs: list[np.ndarray], truth: list[np.ndarray], rounds: int = 120, ridge: float = 1e-4) -> None:
        """Gradient ascent (Adam) on the conditional likelihood of the lines' labels."""
        full = [with_neighbours(d) for d in docs]
        flat = np.vstack(full)
        self.mean, self.scale = flat.mean(axis=0), flat.std(axis=0) + 1e-6
        flat = np.hstack([np.clip((flat - self.mean) / self.scale, -5, 5), np.ones((len(flat), 1))])
        y = np.concatenate(truth)
        ends = np.cumsum([len(d) for d in docs])
        seen = np.zeros((2, 2))
        for t in truth:
            np.add.at(seen, (t[:-1].astype(int), t[1:].astype(int)), 1)
        w = np.zeros(flat.shape[1] + 4)
        m, v = np.zeros_like(w), np.zeros_like(w)
        for k in range(1, rounds + 1):
            self.weights, self.trans = w[:-4], w[-4:].reshape(2, 2)
            p, pairs = forward_backward(np.split(flat @ self.weights, ends[:-1]), self.trans)
            grad = np.concatenate([flat.T @ (y - np.concatenate(p)), (seen - pairs).ravel()]) / len(y) - ridge * w
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad ** 2
            w = w + 0.1 * (m / (1 - 0.9 ** k)) / (np.sqrt(v / (1 - 0.99 ** k)) + 1e-8)
        self.weights, self.trans = w[:-4], w[-4:].reshape(2, 2)

    def line_probabilities(self, docs: list[np.ndarray]) -> list[np.ndarray]:
        return forward_backward([self.evidence(d) for d in docs], self.trans)[0] if docs else []

    def share(self, docs: list[np.ndarray], sizes: list[np.ndarray]) -> np.ndarray:
        return np.array([np.dot(p, s) / s.sum() for p, s in zip(self.line_probabilities(docs), sizes)])

    def score(self, docs: list[np.ndarray], sizes: list[np.ndarray]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(docs), self.constant)
        a, b = self.curve
        return 1 / (1 + np.exp(-(a * log_odds(self.share(docs, sizes)) + b)))


def log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def fit_curve(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Logistic regression on one variable by Newton steps; the slope stays positive."""
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(a * x + b)))
        r, h = y - p, p * (1 - p)
        info = np.array([[(h * x * x).sum(), (h * x).sum()], [(h * x).sum(), h.sum()]]) + 1e-2 * np.eye(2)
        step = np.linalg.solve(info, np.array([(r * x).sum(), r.sum()]) - 1e-2 * np.array([a - 1, b]))
        a, b = max(0.05, a + step[0]), b + step[1]
    return float(a), float(b)


def train(docs: list[np.ndarray], sizes: list[np.ndarray], labels: np.ndarray) -> Chain:
    model = Chain()
    if len(set(labels.tolist())) < 2:
        model.constant = float(labels.mean()) if len(labels) else 0.5
        return model
    truth = [np.full(len(d), float(y)) for d, y in zip(docs, labels)]
    model.fit_lines(docs, truth)
    again = []
    for p, y, t in zip(model.line_probabilities(docs), labels, truth):
        if not y:
            t = (p > 0.5).astype(float)
            t[np.argmin(p)] = 0
        again.append(t)
    model.fit_lines(docs, again)
    model.curve = fit_curve(log_odds(model.share(docs, sizes)), labels.astype(float))
    return model


def fold(id_col: str = "doc_id"):
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(FOLDS))


def learn(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, sample: int) -> Chain:
    """Fit on the ``sample`` labelled documents of smallest hash outside the held-out fold."""
    one = labels.groupBy(F.col("doc_id").alias("l_id")).agg(
        F.min("quality").alias("q"), F.max("quality").alias("q2")).where("q = q2").where(fold("l_id") != 0)
    chosen = one.orderBy(F.xxhash64("l_id"), "l_id").limit(sample).select("l_id", "q")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(
        F.broadcast(chosen), F.col("doc_id") == F.col("l_id"))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [line_features(t) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "q": batch["q"],
                                "own": [f.astype(np.float32).ravel() for f, _ in found], "size": [s for _, s in found]})

    got = rows.select("doc_id", "q", "text").mapInPandas(
        measure, "doc_id long, q int, own array<float>, size array<double>").orderBy("doc_id", "own").limit(sample).toPandas()
    own = [np.array(a, float).reshape(-1, N_OWN) for a in got["own"]]
    return train(own, [np.array(s, float) for s in got["size"]], got["q"].to_numpy())


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    sample: int = 4000, slice_docs: int = 500) -> DataFrame:
    """One row per document: doc_id, held_out, score (the probability of label 1), predicted."""
    model = learn(docs, labels, id_col, text_col, sample)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            parts = []
            for at in range(0, len(batch), slice_docs):
                found = [line_features(t) for t in batch.iloc[at:at + slice_docs]]
                parts.append(model.score([f for f, _ in found], [s for _, s in found]))
            yield pd.Series(np.concatenate(parts) if parts else np.array([], float))

    return (docs.select(F.col(id_col).alias("doc_id"), F.coalesce(fold(id_col) == 0, F.lit(False)).alias("held_out"),
                        score(F.col(text_col)).alias("score"))
            .withColumn("predicted", (F.col("score") >= CUT).cast("int")))
