"""Mixing sources to target weights: Pfair scheduling of source blocks.

Each source is cut into blocks of ``block_docs`` documents. Time is a row of slots, one block each. In the ideal mix a source has
w * v blocks at virtual time v until its own are used up, where w is its target weight; all others go on in proportion.
Block j of a source is released when its ideal count is j and due when it is j + 1, so its release time and
deadline follow from its weight alone. Earliest deadline first over released blocks meets every deadline, so at any slot
a source has had less than one block more or less than its target (``lag`` says how much).

The schedule is made in periods of slots that don't wait for each other. At a period's start each source has had its ideal count,
rounded down or up. Rounding is two-way: in the order of releases and in that of deadlines the rounded counts up to any source
stay within one of the ideal ones, which is what makes both periods beside the border keep all deadlines; a
flow through unit cells of both orders finds it. Borders, periods, blocks and rows are Spark groups and joins: no list of
sources reaches the driver. A period has four slots for each source, so that (period, source) rows stay fewer than blocks.

Defined results: a null source is the empty name; weights are shares of their sum; a source without weight follows
after the others at its natural share; repeated rows and null ids keep a place each; input columns
named like the result's are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.common import clear_names
from panelspark.session import materialize

NAMES = ["target", "block", "slot", "place", "lag"]
NEAR = 1e-6


def cells(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last unit cell that each of ``x`` touches when laid end to end."""
    ends = np.cumsum(x)
    first, last = np.floor(ends - x + NEAR).astype(int), np.ceil(ends - NEAR).astype(int) - 1
    return first, np.maximum(first, last)


def two_way(x: np.ndarray, order: np.ndarray) -> np.ndarray:
    """0 or 1 for each of ``x``, all between them and of whole sum, so that the sums up to any place in the given order and in
    ``order`` differ from those of ``x`` by less than one. A unit flow from the cells of one order to those of the other."""
    many, m = int(round(float(x.sum()))), len(x)
    if not many:
        return np.zeros(m, int)
    left, right = cells(x), tuple(c[np.argsort(order)] for c in cells(x[order]))
    # Nodes: source, cells of the first order, elements in and out, cells of the second, sink.
    enter, leave, sink = 1 + many, 1 + many + m, 1 + 2 * many + 2 * m
    to, free, out = [], [], [[] for _ in range(sink + 1)]

    def edge(a: int, b: int) -> None:
        out[a].append(len(to))
        to.append(b)
        free.append(1)
        out[b].append(len(to))
        to.append(a)
        free.append(0)

    for c in range(many):
        edge(0, 1 + c)
        edge(leave + m + c, sink)
    middle = []
    for i in range(m):
        middle.append(len(to))
        edge(enter + i, leave + i)
        for c in {int(left[0][i]), min(int(left[1][i]), many - 1)}:
            edge(1 + c, enter + i)
        for c in {int(right[0][i]), min(int(right[1][i]), many - 1)}:
            edge(leave + i, leave + m + c)
    while True:
        depth, todo = [-1] * (sink + 1), deque([0])
        depth[0] = 0
        while todo:
            a = todo.popleft()
            for e in out[a]:
                if free[e] and depth[to[e]] < 0:
                    depth[to[e]] = depth[a] + 1
                    todo.append(to[e])
        if depth[sink] < 0:
            break
        at, path = [0] * (sink + 1), []
        while True:
            a = to[path[-1]] if path else 0
            if a == sink:
                for e in path:
                    free[e], free[e ^ 1] = 0, 1
                path = []
                continue
            while at[a] < len(out[a]) and not (free[out[a][at[a]]] and depth[to[out[a][at[a]]]] == depth[a] + 1):
                at[a] += 1
            if at[a] < len(out[a]):
                path.append(out[a][at[a]])
            elif path:
                path.pop()
                at[to[path[-1]] if path else 0] += 1
            else:
                break
    return np.array([1 - free[e] for e in middle])


def border(rows: pd.DataFrame) -> pd.DataFrame:
    """The rounded counts of all sources at one border, from their ideal counts x and weights w."""
    rows = rows.sort_values("src")
    x, w = rows["x"].to_numpy(), rows["w"].to_numpy()
    whole = np.floor(x + NEAR)
    part = np.flatnonzero(x - whole > NEAR)
    release, due = whole[part] / w[part], (whole[part] + 1) / w[part]
    by_release = part[np.argsort(-release, kind="stable")]
    by_due = np.argsort(due[np.argsort(-release, kind="stable")], kind="stable")
    whole[by_release] += two_way(x[by_release] - whole[by_release], by_due)
    return pd.DataFrame({"k": rows["k"], "src": rows["src"], "count": whole.astype(np.int64)})


def period(rows: pd.DataFrame) -> pd.DataFrame:
    """Earliest deadline first over a period's blocks: rows (k, start, src, w, v_end, v, x, first, stop), v the virtual time at
    the start and x the ideal count there."""
    rows = rows.sort_values("src")
    w, end, x, first, stop = (rows[c].to_numpy() for c in ("w", "v_end", "x", "first", "stop"))
    v0, start, sources = float(rows["v"].iloc[0]), int(rows["start"].iloc[0]), rows["src"].tolist()
    order = np.argsort(end, kind="stable")
    ends, drop = end[order], np.cumsum(w[order])
    speed = np.concatenate([[w.sum()], w.sum() - drop])
    times = np.concatenate([[0.0], np.cumsum(np.diff(np.concatenate([[v0], ends])) * speed[:-1])])
    marks = np.concatenate([[v0], ends])

    def slots(v: np.ndarray) -> np.ndarray:
        """Slots from the period's start to virtual time v."""
        at = np.clip(np.searchsorted(marks, v, "right") - 1, 0, len(speed) - 1)
        return times[at] + (v - marks[at]) * np.maximum(speed[at], 0)

    def virtual(t: np.ndarray) -> np.ndarray:
        at = np.clip(np.searchsorted(times, t, "right") - 1, 0, len(speed) - 1)
        return marks[at] + (t - times[at]) / np.where(speed[at] > 0, speed[at], np.inf)

    many = stop - first
    owner = np.repeat(np.arange(len(rows)), many)
    block = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many) + first[owner]
    due = np.minimum((block + 1) / w[owner], end[owner])
    release = np.floor(np.maximum(slots(np.maximum(block / w[owner], v0)), 0) + NEAR).astype(int)
    coming = np.lexsort((owner, release)).tolist()
    release_of, due_of, ready, done, slot_of = release.tolist(), due.tolist(), [], 0, np.empty(len(owner), np.int64)
    for slot in range(len(owner)):
        while done < len(coming) and (release_of[coming[done]] <= slot or not ready):
            b = coming[done]
            heapq.heappush(ready, (due_of[b], sources[owner[b]], b))
            done += 1
        slot_of[heapq.heappop(ready)[2]] = slot
    ideal = np.minimum(w[owner] * np.minimum(virtual(slot_of + 1.0), end[owner]), w[owner] * end[owner])
    return pd.DataFrame({"src": rows["src"].to_numpy()[owner], "block": block, "slot": start + slot_of, "lag": ideal - (block + 1),
                         "w": w[owner]})


def running(table: DataFrame, order: list[str], sums: dict[str, str]) -> DataFrame:
    """Running sums over the whole table without one task for it: inside range partitions, then over their totals."""
    cut = materialize(table.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    own, over = Window.partitionBy("__part").orderBy(*order), Window.orderBy("t_part")
    totals = cut.groupBy(F.col("__part").alias("t_part")).agg(*[F.sum(c).alias(f"__{n}") for n, c in sums.items()]).select(
        "t_part", *[(F.sum(f"__{n}").over(over) - F.col(f"__{n}")).alias(f"__{n}") for n in sums])
    inner = cut.select("*", *[F.sum(c).over(own.rowsBetween(Window.unboundedPreceding, 0)).alias(n) for n, c in sums.items()])
    return inner.join(F.broadcast(totals), F.col("__part") == F.col("t_part")).select(
        *table.columns, *[(F.col(n) + F.col(f"__{n}")).alias(n) for n in sums])


def block_slots(sources: DataFrame, slots: int, many: int, weight: float, period_slots: int) -> DataFrame:
    """sources (src, blocks, w), w above zero, to (src, block, slot, lag, w) of every block. ``slots``, ``many`` and ``weight``: the
    sums of blocks, sources and weights."""
    length = max(period_slots, 4 * many)
    last = -(-slots // length)
    ends = running(sources.withColumn("v_end", F.col("blocks") / F.col("w")), ["v_end", "src"], {"gone": "blocks", "less": "w"})
    # Up to the end of a source, time runs at the speed of it and of all that end later.
    until = F.col("gone") + F.col("v_end") * (F.lit(weight) - F.col("less"))
    top = F.least(F.floor(until / length + 1e-9).cast("long"), F.lit(last - 1).cast("long"))
    active = materialize(ends.select(
        "src", "w", "v_end", "blocks", (F.col("gone") - F.col("blocks")).alias("before"),
        (F.lit(weight) - F.col("less") + F.col("w")).alias("speed"), F.explode(F.sequence(F.lit(0).cast("long"), top)).alias("k")))
    # Of the sources that still have blocks at a border the one that ends first knows its virtual time.
    borders = active.groupBy("k").agg(F.min_by(F.struct("before", "speed"), F.struct("v_end", "src")).alias("s")).select(
        F.col("k").alias("b_k"), F.greatest(F.lit(0.0), (F.col("k") * length - F.col("s.before")) / F.col("s.speed")).alias("v"))
    met = materialize(active.join(borders, F.col("k") == F.col("b_k")).select("k", "src", "w", "v_end", "blocks", "v", F.least(
        F.col("w") * F.col("v"), F.col("blocks").cast("double")).alias("x")))
    counts = materialize(met.groupBy("k").applyInPandas(border, "k long, src string, count long"))
    first = counts.select(F.col("k").alias("f_k"), F.col("src").alias("f_src"), F.col("count").alias("first"))
    following = counts.select((F.col("k") - 1).alias("n_k"), F.col("src").alias("n_src"), F.col("count").alias("stop"))
    ready = (met.join(first, (F.col("k") == F.col("f_k")) & (F.col("src") == F.col("f_src")))
             .join(following, (F.col("k") == F.col("n_k")) & (F.col("src") == F.col("n_src")), "left")
             .select("k", (F.col("k") * length).alias("start"), "src", "w", "v_end", "v", "x", "first",
                     F.coalesce("stop", "blocks").alias("stop")))
    return ready.groupBy("k").applyInPandas(period, "src string, block long, slot long, lag double, w double")


def schedule(sources: DataFrame, period_slots: int = 1000) -> DataFrame:
    """sources (src, blocks, w) to (src, block, slot, lag, target): those with a weight, then the others at their natural share."""
    sources = materialize(sources.where("blocks > 0"))
    facts = {r["ranked"]: r for r in sources.groupBy((F.col("w") > 0).alias("ranked")).agg(
        F.sum("blocks").alias("slots"), F.count("*").alias("many"), F.sum("w").alias("weight")).collect()}
    out, before = None, 0
    for ranked in (True, False):
        if ranked not in facts:
            continue
        f = facts[ranked]
        own = sources.where((F.col("w") > 0) == ranked)
        own = own if ranked else own.withColumn("w", F.col("blocks").cast("double"))
        weight = f["weight"] if ranked else float(f["slots"])
        part = block_slots(own, f["slots"], f["many"], weight, period_slots).select(
            "src", "block", (F.col("slot") + before).alias("slot"), "lag", (F.col("w") / F.lit(weight) * int(ranked)).alias("target"))
        out, before = part if out is None else out.unionByName(part), before + f["slots"]
    return materialize(out) if out is not None else sources.sparkSession.createDataFrame(
        [], "src string, block long, slot long, lag double, target double")


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, exponent: float = 0.5, block_docs: int = 8,
        period: int = 1000, seed: int = 7, id_col: str = "doc_id", source_col: str = "source",
        bucket_rows: int = 20_000) -> DataFrame:
    """docs with target (the weight's share), block, slot, place (in the block) and lag; order by slot and place.

    ``weights`` gives the target weights; without, they are the sources' numbers of documents to the power ``exponent``.
    Within a source the order is that of a seeded hash of the id.
    """
    docs = clear_names(docs, NAMES)
    src: Column = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    # The input travels as one column, so its names can't meet those used here.
    rows = docs.select(F.struct(*docs.columns).alias("row"), src.alias("src"), F.col(id_col).alias("id"),
                       F.xxhash64(F.lit(seed), F.col(id_col)).alias("draw"))
    counted = docs.groupBy(src.alias("src")).agg(F.count("*").alias("n"))
    if weights is None:
        weighed = counted.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(float(exponent))))
    else:
        given = docs.sparkSession.createDataFrame([(str(s), max(0.0, float(w))) for s, w in weights.items()], "g_src string, w double")
        weighed = counted.join(given, F.col("src") == F.col("g_src"), "left").select(
            "src", "n", F.coalesce("w", F.lit(0.0)).alias("w"))
    sources = materialize(weighed.withColumn("blocks", F.ceil(F.col("n") / block_docs)))
    total = sources.agg(F.sum("n").alias("n")).first()["n"] or 0
    planned = schedule(sources.select("src", "blocks", "w"), period).withColumnRenamed("src", "s_src")

    # The rows of a source are numbered in two steps, so that a hot source is not sorted in one task.
    parts = max(16, -(-total // bucket_rows))
    rows = rows.withColumn("part", F.pmod(F.shiftright("draw", 20), F.lit(parts)))
    heads = rows.groupBy("src", "part").agg(F.count("*").alias("n")).select(
        F.col("src").alias("h_src"), F.col("part").alias("h_part"),
        (F.sum("n").over(Window.partitionBy("src").orderBy("part")) - F.col("n")).alias("head"))
    own = Window.partitionBy("src", "part").orderBy("draw", "id")
    at = F.col("head") + F.col("number") - 1
    return (rows.withColumn("number", F.row_number().over(own))
            .join(heads, (F.col("src") == F.col("h_src")) & (F.col("part") == F.col("h_part")))
            .withColumns({"at_block": F.floor(at / block_docs), "place": F.pmod(at, F.lit(block_docs))})
            .join(planned, (F.col("src") == F.col("s_src")) & (F.col("at_block") == F.col("block")))
            .select("row.*", *NAMES))


def in_order(docs: DataFrame, **options) -> DataFrame:
    """docs, laid out in the order of the mix; columns stay as they are."""
    mixed = mix(docs.select(F.struct(*docs.columns).alias("row"), *[F.col(options.get(k, d)) for k, d in (
        ("id_col", "doc_id"), ("source_col", "source"))]), **options)
    return mixed.repartitionByRange("slot", "place").sortWithinPartitions("slot", "place").select("row.*")
