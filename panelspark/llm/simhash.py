"""SimHash near-dedup: a hierarchical index over fingerprints in Gray order.

Two fingerprints that differ in at most two bits agree in one of three fields of bits. A field's
value is an upper node of the index: its members share that masked pattern and meet in one bucket. A
bucket with more than ``limit`` members is factored again by the three fields of its remaining
bits, up to three times, after which the bits left free bound its size. Inside a bucket the members are sorted by
Gray rank; runs of eight make the next level's nodes, each with the bits its members share.
Pairs of nodes are descended together; a pair whose shared bits already differ in more than two
places is pruned with everything below it. A bucket sends on one edge for each member and link
root, never all pairs; the components of those edges are the classes.

Defined results: a null or empty text has fingerprint zero and links like any other; of repeated
rows one stays; a null id counts as larger than any other; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import attach, components, keep_one
from panelspark.session import materialize

SEED, RUN, LEVELS = 42, 8, 3


def hash_text(text: str | None, words: int = 3) -> list[int]:
    """XXH64 of every shingle; the whole sequence where there are fewer words."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return []
    joined = b" ".join(parts)
    if len(parts) <= words:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    ends, at = [], -1
    for p in parts:
        at += len(p) + 1
        ends.append(at)
    starts = [0, *[e + 1 for e in ends]]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[s:e], SEED) for s, e in zip(starts, ends[words - 1:])]


def fingerprints(texts: list, chunk: int = 50_000, words: int = 3) -> np.ndarray:
    """One unsigned fingerprint per text; at most ``chunk`` hashes are unpacked at a time."""
    votes, sizes = np.zeros((len(texts), 64), np.int64), np.zeros(len(texts), np.int64)
    held, starts, owners, count = [], [], [], 0

    def flush():
        if held:
            bits = np.unpackbits(np.concatenate(held).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            np.add.at(votes, owners, np.add.reduceat(bits, starts, axis=0, dtype=np.int64))

    for i, text in enumerate(texts):
        hashes = np.array(hash_text(text, words), dtype=np.uint64)
        sizes[i] = len(hashes)
        for part in range(0, len(hashes), chunk):
            piece = hashes[part:part + chunk]
            held.append(piece)
            starts.append(count)
            owners.append(i)
            count += len(piece)
            if count >= chunk:
                flush()
                held, starts, owners, count = [], [], [], 0
    flush()
    return np.packbits(2 * votes > sizes[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def field_masks(levels: int = LEVELS) -> list[list[tuple[int, int]]]:
    """For each level the (path, mask) of its nodes: thirds of the bits that are still free."""
    out, paths = [], [(0, 0)]
    for _ in range(levels):
        nodes = []
        for path, mask in paths:
            free = [b for b in range(63, -1, -1) if not mask >> b & 1]
            third = -(-len(free) // 3)
            for k in range(3):
                nodes.append((path * 4 + k + 1, mask | sum(1 << b for b in free[k * third:(k + 1) * third])))
        out.append(nodes)
        paths = nodes
    return out


def gray_rank(values: np.ndarray) -> np.ndarray:
    rank = values.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return parent
        parent = up


def link(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union of the pairs; parents are smaller than their children, all paths short."""
    while len(a):
        low, high = np.minimum(parent[a], parent[b]), np.maximum(parent[a], parent[b])
        apart = low != high
        a, b, low, high = a[apart], b[apart], low[apart], high[apart]
        parent = parent.copy()
        np.minimum.at(parent, high, low)
        parent = roots(parent)
    return parent


def link_buckets(bucket: np.ndarray, values: np.ndarray, bits: int, slice_rows: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
    """Members of the same bucket within ``bits`` differing bits: the members in index order and each one's root."""
    order = np.lexsort((gray_rank(values), bucket))
    bucket, values = bucket[order], values[order]
    n = len(values)
    parent = np.arange(n)
    for step in (1, 2):  # neighbours in Gray order first: dense groups become one class at once
        near = np.flatnonzero((bucket[step:] == bucket[:-step])
                              & (np.bitwise_count(values[step:] ^ values[:-step]) <= bits)) if n > step else np.array([], int)
        parent = link(parent, near, near + step)
    one = ~np.uint64(0)
    levels = [(values, values, bucket, parent, parent, np.arange(n + 1))]
    while len(levels[-1][0]) > len(np.unique(levels[-1][2])):
        low, high, own, first, last, _ = levels[-1]
        new = np.r_[True, own[1:] != own[:-1]]
        begin = np.flatnonzero(new)
        place = np.arange(len(own)) - np.repeat(begin, np.diff(np.r_[begin, len(own)]))
        heads = np.flatnonzero(place % RUN == 0)
        levels.append((np.bitwise_and.reduceat(low, heads), np.bitwise_or.reduceat(high, heads), own[heads],
                       np.minimum.reduceat(first, heads), np.maximum.reduceat(last, heads), np.r_[heads, len(own)]))
    top = np.arange(len(levels[-1][0]))
    todo = [(len(levels) - 1, top, top)]
    while todo:
        level, a, b = todo.pop()
        if len(a) > slice_rows:
            half = len(a) // 2
            todo += [(level, a[half:], b[half:]), (level, a[:half], b[:half])]
            continue
        low, high, _, first, last, kids = levels[level]
        shared = ~(low[a] ^ high[a]) & ~(low[b] ^ high[b]) & one
        near = np.bitwise_count((low[a] ^ low[b]) & shared) <= bits
        joined = (first[a] == last[a]) & (first[b] == last[b]) & (first[a] == first[b])
        a, b = a[near & ~joined], b[near & ~joined]
        if level == 0:
            parent = link(parent, a, b)
            continue
        na, nb = kids[a + 1] - kids[a], kids[b + 1] - kids[b]
        each = np.repeat(np.arange(len(a)), na * nb)
        place = np.arange(len(each)) - np.repeat(np.cumsum(na * nb) - na * nb, na * nb)
        x, y = kids[a][each] + place // nb[each], kids[b][each] + place % nb[each]
        good = x <= y
        if len(x):
            todo.append((level - 1, x[good], y[good]))
    return values, values[parent]


def bucket_edges(bits: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows sorted by bucket: an edge from each member to its root."""
        def edges(rows: pd.DataFrame) -> pd.DataFrame:
            bucket = np.cumsum(np.r_[True, (rows["path"].to_numpy()[1:] != rows["path"].to_numpy()[:-1])
                                     | (rows["upper"].to_numpy()[1:] != rows["upper"].to_numpy()[:-1])])
            member, root = link_buckets(bucket, rows["fp"].to_numpy().astype(np.int64).view(np.uint64), bits)
            apart = member != root
            return pd.DataFrame({"a": member[apart].view(np.int64), "b": root[apart].view(np.int64)})

        held = None
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            if rows.empty:
                continue
            tail = (rows["path"] == rows["path"].iloc[-1]) & (rows["upper"] == rows["upper"].iloc[-1])
            held = rows[tail]
            if not tail.all():
                yield edges(rows[~tail])
        if held is not None:
            yield edges(held)
    return run


def fingerprint_edges(fps: DataFrame, bits: int = 2, limit: int = 100_000) -> DataFrame:
    """fps (fp), distinct, to edges (a, b) that connect all fingerprints within ``bits`` bits.

    Two bits leave one of three fields alike, so ``bits`` is 2 at most.
    """
    if bits > 2:
        raise ValueError("three fields find at most two differing bits")
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    edges, rest = None, fps.select("fp", F.lit(0).alias("path"))
    for level, nodes in enumerate(field_masks()):
        under = F.array(*[F.struct(F.lit(p).alias("path"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("upper"),
                                   F.lit(p // 4).alias("above")) for p, m in nodes])
        spread = rest.select("fp", F.col("path").alias("__path"), F.explode(under).alias("n")).where(
            "n.above = __path").select("fp", "n.path", "n.upper")
        sizes = spread.groupBy("path", "upper").agg(F.count("*").alias("members")).where("members > 1")
        spread = materialize(spread.join(sizes, ["path", "upper"]))
        last = level + 1 == LEVELS
        small = spread if last else spread.where(F.col("members") <= limit)
        found = (small.select("path", "upper", "fp").repartition("path", "upper")
                 .sortWithinPartitions("path", "upper").mapInPandas(bucket_edges(bits), "a long, b long"))
        edges = found if edges is None else edges.union(found)
        if last or spread.where(F.col("members") > limit).isEmpty():
            return edges
        rest = spread.where(F.col("members") > limit).select("fp", "path").distinct()
    return edges


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 2) -> DataFrame:
    """One row per (doc_id, text): fp, repeats, members, component_id and the class's first (doc_id, mark)."""
    @F.pandas_udf("long")
    def simhash(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(fingerprints(batch.tolist()).view(np.int64))

    rows = materialize(docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("mark"),
        simhash(F.col(text_col)).alias("fp")).groupBy("doc_id", "mark", "fp").agg(F.count("*").alias("repeats")))
    # A null id sorts last, so that it never is the smallest.
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("mark").alias("mark"))
    fps = materialize(rows.groupBy("fp").agg(
        F.min(first).alias("first"), F.count("*").alias("rows"), F.sum("repeats").alias("docs")))
    labels = components(fingerprint_edges(fps, bits))
    labelled = materialize(fps.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "label", F.coalesce("label", "fp")))
    heads = labelled.groupBy("label").agg(F.min("first").alias("head"), F.sum("docs").alias("members"),
                                          F.count("*").alias("fps"))
    several = heads.where("fps > 1")
    alone = labelled.join(several.select("label"), "label", "left_anti").select(
        "fp", "rows", F.col("first").alias("head"), F.col("docs").alias("members"))
    joined = labelled.select("fp", "rows", "label").join(several.drop("fps"), "label").select(
        "fp", "rows", "head", "members")
    return attach(rows, materialize(alone.union(joined)), "fp", "rows", rows.count(), F.xxhash64("doc_id", "mark"))


def near_components(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, fingerprint, component_id, members."""
    return (classes(docs, **options)
            .select("*", F.explode(F.sequence(F.lit(1).cast("long"), "repeats")).alias("copy"))
            .select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                    F.col("head.id").alias("component_id"), "members"))


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one document of each class, the one of smallest id; columns stay as they are."""
    multi = classes(docs, id_col=id_col, text_col=text_col, **options).where("members > 1").select(
        F.col("doc_id").alias("__id"), F.col("mark").alias("__mark"),
        (F.col("doc_id").eqNullSafe(F.col("head.id")) & (F.col("mark") == F.col("head.mark"))).alias("stays"), "repeats")
    keyed = docs.withColumns({"__id": F.col(id_col).cast("long"), "__mark": F.xxhash64(text_col)})
    return keep_one(docs, keyed, ["__id", "__mark"], materialize(multi))
