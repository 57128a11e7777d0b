"""Hard-negative mining: scores by a matrix product in a residue number system, then selection in windows.

Components become integers, floor(scale * x). A score is an integer inner product; its size is at most the largest
squared length of a vector, which one aggregation finds. As many primes are taken as make their product more than
twice that. For each prime the component matrices hold residues around zero, and float32 products of at most ``STEP``
columns stay below 2**24, so they are exact in any order of summing. The scores' residues are put together by
mixed-radix Chinese remaindering and shifted to their sign.

Every row meets every anchor in blocks: rows and anchors are dealt to blocks, and a cell of the grid holds one
block of each, so that neither all rows nor all anchors are ever in one task, and only ids and integers travel. The first
pass keeps each anchor's best rows of its label in each cell, the second each positive's best rows of other labels whose
score lies in its window; what the cells keep is merged by Spark.

Defined results: rows with a null label, a null vector, or a null or non-finite component take no part; a shorter
vector ends in zeros; repeated rows are rows of their own (a repeated anchor is an anchor twice, and its copy may be its positive);
a row without an id is no anchor and comes last among equal scores; vectors whose squared length passes 2**51 are refused; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.session import materialize

STEP, LARGEST_PRIME, MOST = 64, 1024, 1 << 51
#: Scores held at once, in numbers.
CELL_SCORES = 2_000_000


def primes_for(bound: int) -> list[int]:
    """The largest primes below LARGEST_PRIME whose product is more than twice ``bound``."""
    found, product = [], 1
    for p in range(LARGEST_PRIME - 1, 2, -1):
        if product > 2 * bound:
            break
        if all(p % q for q in range(2, int(p ** 0.5) + 1)):
            found.append(p)
            product *= p
    return found


def residues(values: np.ndarray, prime: int) -> np.ndarray:
    """Integers held as doubles to float32 residues from -prime/2 to prime/2."""
    rest = np.fmod(values, prime)
    return (rest - prime * np.rint(rest / prime)).astype(np.float32)


def scores(anchors: list[np.ndarray], rows: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """Exact inner products, from the residues of both sides for every prime."""
    digits: list[np.ndarray] = []
    for k, p in enumerate(primes):
        a, b = anchors[k], rows[k]
        left = np.zeros((len(a), len(b)), np.int64)
        for at in range(0, a.shape[1], STEP):
            left += (a[:, at:at + STEP] @ b[:, at:at + STEP].T).astype(np.int64)
        for q, digit in zip(primes, digits):  # the mixed-radix digit of this prime
            left = (left - digit) * pow(q, -1, p)
            left %= p
        digits.append(left % p)
    total, weight = np.zeros_like(digits[0]), 1
    for p, digit in zip(primes, digits):
        total += digit * weight
        weight *= p
    total[total > weight // 2] -= weight
    return total


def top(values: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(line, place) of the k largest allowed values of each line, earlier places first among equals."""
    low = np.iinfo(np.int64).min
    held = np.where(allowed, values, low)
    if held.shape[1] > k:
        least = np.partition(held, held.shape[1] - k, axis=1)[:, -k]
        allowed = allowed & (values >= least[:, None])
    line, place = np.nonzero(allowed)
    order = np.lexsort((place, -values[line, place], line))
    line, place = line[order], place[order]
    rank = np.arange(len(line)) - np.searchsorted(line, line)
    return line[rank < k], place[rank < k]


def vectors(column: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(column), width))
    for k, v in enumerate(column):
        out[k, :len(v)] = v
    return out


def meet(pick, width: int, primes: list[int]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows sorted by cell, the block of rows before the anchors; ``pick`` makes the result of some anchors."""
        cell, parts, rows, block = None, [], None, None
        for batch in batches:
            new = np.flatnonzero(np.r_[True, batch["cell"].to_numpy()[1:] != batch["cell"].to_numpy()[:-1]])
            for first, end in zip(new, np.r_[new[1:], len(batch)]):
                some = batch.iloc[first:end]
                if some["cell"].iloc[0] != cell:
                    cell, parts, rows = some["cell"].iloc[0], [], None
                is_row = some["kind"] == 0
                if is_row.any():
                    parts.append(some[is_row])
                anchors = some[~is_row]
                if anchors.empty or not parts:
                    continue
                if rows is None:
                    # Places follow the order of ties: by id, those without one last.
                    rows = pd.concat(parts).sort_values(["no_id", "vec_id", "uid"], ignore_index=True)
                    values = vectors(rows["vector"], width)
                    block = [residues(values, p) for p in primes]
                step = max(1, CELL_SCORES // len(rows))
                for at in range(0, len(anchors), step):
                    lines = anchors.iloc[at:at + step]
                    own = vectors(lines["vector"], width)
                    yield pick(lines, rows, scores([residues(own, p) for p in primes], block, primes))
    return run


def best_rows(k: int):
    def run(lines: pd.DataFrame, rows: pd.DataFrame, score: np.ndarray) -> pd.DataFrame:
        """The k best other rows of each anchor's label."""
        same = (lines["label"].to_numpy()[:, None] == rows["label"].to_numpy()) & (
            lines["uid"].to_numpy()[:, None] != rows["uid"].to_numpy())
        line, place = top(score, same, k)
        return pd.DataFrame({"anchor": lines["uid"].to_numpy()[line], "uid": rows["uid"].to_numpy()[place],
                             "no_id": rows["no_id"].to_numpy()[place], "vec_id": rows["vec_id"].to_numpy()[place],
                             "score": score[line, place]})
    return run


def in_windows(k: int, low: int, high: int):
    def run(lines: pd.DataFrame, rows: pd.DataFrame, score: np.ndarray) -> pd.DataFrame:
        """The k best rows of other labels in the window of each positive of each anchor."""
        found = []
        other = lines["label"].to_numpy()[:, None] != rows["label"].to_numpy()
        wide = 100 * score
        for n in range(int(lines["positives"].map(len).max())):
            with_n = np.flatnonzero(lines["positives"].map(len).to_numpy() > n)
            positive = np.array([p[n] for p in lines["positives"].iloc[with_n]], np.int64)[:, None]
            inside = other[with_n] & (low * positive <= wide[with_n]) & (wide[with_n] <= high * positive)
            line, place = top(score[with_n], inside, k)
            found.append(pd.DataFrame({
                "anchor": lines["uid"].to_numpy()[with_n][line], "place": n + 1, "uid": rows["uid"].to_numpy()[place],
                "no_id": rows["no_id"].to_numpy()[place], "vec_id": rows["vec_id"].to_numpy()[place], "score": score[with_n][line, place]}))
        return pd.concat(found)
    return run


def ranked(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "no_id", "vec_id", "uid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def integers(vec: Column, scale: float) -> Column:
    return F.transform(vec, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double"))


def sound(vec: Column) -> Column:
    return vec.isNotNull() & ~F.exists(vec, lambda x: x.isNull() | F.isnan(x.cast("double")) | (
        F.abs(x.cast("double")) == float("inf")))


def mine(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
         scale: float = 256, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
         row_block: int = 262_144, anchor_block: int = 65_536, least_rows: int = 4096) -> DataFrame:
    """One row per negative: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchors`` says which rows are anchors. Negatives score from ``low`` to ``high`` hundredths of the positive.
    """
    vec, given = F.col(vector_col), F.col(id_col).cast("long")
    table = materialize(rows.where(sound(vec) & F.col(label_col).isNotNull()).select(
        F.monotonically_increasing_id().alias("uid"), given.isNull().alias("no_id"),
        F.coalesce(given, F.lit(0).cast("long")).alias("vec_id"), F.col(label_col).cast("long").alias("label"),
        integers(vec, scale).alias("vector"), F.coalesce(anchors, F.lit(False)).alias("is_anchor")))
    size = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    facts = table.agg(F.count("*").alias("n"), F.count_if("is_anchor").alias("anchors"), F.max(F.size("vector")).alias("width"),
                      F.max(size).alias("size")).first()
    bound = int((facts["size"] or 0) * (1 + 1e-9)) + 1
    if bound > MOST:
        raise ValueError("a squared length passes 2**51")
    primes, width = primes_for(bound), max(1, facts["width"] or 0)
    # As many blocks as keep a block in memory and the tasks busy; the grid's cells follow from both sides' blocks.
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fits = max(1, row_block * 64 // width)
    row_blocks = max(-(-facts["n"] // fits), min(tasks, facts["n"] // least_rows), 1)
    anchor_blocks = max(1, -(-facts["anchors"] // anchor_block))

    def cells(lines: DataFrame, pick, out: str) -> DataFrame:
        block = lambda n: F.pmod(F.xxhash64("uid"), F.lit(n))
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("other")
        held = table.select("uid", "no_id", "vec_id", "label", "vector", F.lit(None).cast("array<long>").alias("positives"),
                            block(row_blocks).alias("own"), every(anchor_blocks)).select(
            "*", (F.col("own") * anchor_blocks + F.col("other")).alias("cell"), F.lit(0).alias("kind"))
        asked = lines.select("uid", "no_id", "vec_id", "label", "vector", "positives", block(anchor_blocks).alias("own"),
                             every(row_blocks)).select(
            "*", (F.col("other") * anchor_blocks + F.col("own")).alias("cell"), F.lit(1).alias("kind"))
        return (held.unionByName(asked).drop("own", "other").repartition(row_blocks * anchor_blocks, "cell")
                .sortWithinPartitions("cell", "kind").mapInPandas(meet(pick, width, primes), out))

    own = table.where("is_anchor")
    first = cells(own.withColumn("positives", F.lit(None).cast("array<long>")), best_rows(positives),
                  "anchor long, uid long, no_id boolean, vec_id long, score long")
    best = materialize(ranked(first, ["anchor"], positives).select(
        "anchor", F.col("rank").alias("place"), F.when(~F.col("no_id"), F.col("vec_id")).alias("positive_id"), F.col("score").alias("positive_score")))
    of = best.groupBy("anchor").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "positive_score"))),
                                                lambda x: x["positive_score"]).alias("positives"))
    lines = own.join(of, own["uid"] == of["anchor"]).select(*own.columns, "positives")
    second = cells(lines, in_windows(negatives, low, high), "anchor long, place int, uid long, no_id boolean, vec_id long, score long")
    found = ranked(second, ["anchor", "place"], negatives).select(
        "anchor", "place", "rank", F.when(~F.col("no_id"), F.col("vec_id")).alias("negative_id"), F.col("score").alias("negative_score"))
    ids = own.select(F.col("uid").alias("anchor"), F.when(~F.col("no_id"), F.col("vec_id")).alias("anchor_id"))
    return found.join(best, ["anchor", "place"]).join(ids, "anchor").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
