"""Exact dedup: tree merge of sorted digest runs.

Every partition sorts its digests into a run. In each round the nodes that differ in one digit of
their number exchange runs: a row moves to the node whose digit is that of its digest. There the
runs that arrive are merged in order and of equal digests one row stays, with the smallest
identifier and the number of rows seen. After the last round a digest lives on one node only. A
group of copies of any size reaches a node as at most ``fan`` rows for each node of the round before.

Equality is that of SHA-256, checked at every level against a second hash and the length.

Defined results: a null text is empty; a null id counts as larger than any other; of repeated rows
with equal id and text one stays; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import WHITE, attach, keep_one
from panelspark.session import materialize

RUN = "node long, digest binary, mark long, bytes long, keep_id long, rows long"
ORDER = ["digest", "mark", "bytes"]


def normal(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{WHITE}]+", " ")


def with_digest(docs: DataFrame, text_col: str) -> DataFrame:
    """docs with digest (SHA-256), mark (XXH64) and bytes of the normalised text."""
    return docs.withColumn("__text", normal(F.col(text_col))).withColumns({
        "digest": F.unhex(F.sha2("__text", 256)), "mark": F.xxhash64("__text"),
        "bytes": F.octet_length("__text").cast("long")}).drop("__text")


def merge_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by node and digest: one row for each, the smallest id and the sum of rows."""
    held = None
    for batch in batches:
        rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
        if rows.empty:
            continue
        last = [rows[c].to_numpy() for c in ("node", *ORDER)]
        new = np.ones(len(rows), bool)
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in last])
        starts = np.flatnonzero(new)
        out = rows.iloc[starts].copy()
        ids = rows["keep_id"].astype("Int64")
        out["keep_id"] = ids.groupby(np.cumsum(new)).min().to_numpy(dtype=object, na_value=None)
        out["rows"] = np.add.reduceat(rows["rows"].to_numpy(), starts)
        held = out.iloc[-1:]
        yield out.iloc[:-1]
    if held is not None:
        yield held


def merge_tree(rows: DataFrame, nodes_for: int, fan: int, node_rows: int) -> DataFrame:
    """rows (doc_id, digest, mark, bytes, repeats) to one row per digest: keep_id, rows. ``fan`` is a power of two."""
    if fan < 2 or fan & (fan - 1):
        raise ValueError("fan must be a power of two")
    rounds = 1
    while fan ** rounds * node_rows < nodes_for:
        rounds += 1
    rounds = max(2, rounds)
    width = fan ** rounds
    level = rows.select(
        (F.spark_partition_id() % width).cast("long").alias("node"), *ORDER,
        F.col("doc_id").alias("keep_id"), F.col("repeats").alias("rows"))
    level = level.sortWithinPartitions("node", *ORDER).mapInPandas(merge_runs, RUN)
    for r in range(rounds):
        step, bits = fan ** r, r * (fan.bit_length() - 1)
        digit, own = (F.shiftrightunsigned(c, bits).bitwiseAND(F.lit(fan - 1)) for c in ("mark", "node"))
        level = level.withColumn("node", (F.col("node") + (digit - own) * step).cast("long"))
        level = level.repartition(width, "node").sortWithinPartitions("node", *ORDER).mapInPandas(merge_runs, RUN)
    return level.select(*ORDER, "keep_id", "rows")


def decide(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan: int = 8,
           node_rows: int = 250_000) -> DataFrame:
    """One row per (doc_id, text): digest, mark, bytes, repeats, keep_id, rows (of the group)."""
    rows = materialize(
        with_digest(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("__raw")), "__raw")
        .groupBy("doc_id", *ORDER).agg(F.count("*").alias("repeats")))
    total = rows.count()
    groups = materialize(merge_tree(rows, total, fan, node_rows))
    tag = F.struct(*ORDER)
    several = groups.where("rows > 1").select(tag.alias("tag"), "keep_id", "rows")
    return attach(rows.withColumn("tag", tag), several, "tag", "rows", total,
                  F.xxhash64("doc_id", "mark")).drop("tag").withColumns({
                      "keep_id": F.when(F.col("rows").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")),
                      "rows": F.coalesce("rows", F.lit(1))})


def exact_groups(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    return (decide(docs, **options)
            .select("*", F.explode(F.sequence(F.lit(1).cast("long"), "repeats")).alias("copy"))
            .select("doc_id", "keep_id", F.col("rows").alias("group_size"),
                    (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
                    F.lower(F.hex("digest")).alias("text_sha256")))


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without copies; all columns stay as they are."""
    multi = decide(docs, id_col, text_col, **options).where("rows > 1").select(
        F.col("doc_id").alias("__id"), F.col("digest").alias("__digest"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("stays"), "repeats")
    keyed = docs.withColumns({"__id": F.col(id_col).cast("long"),
                              "__digest": F.unhex(F.sha2(normal(F.col(text_col)), 256))})
    return keep_one(docs, keyed, ["__id", "__digest"], materialize(multi))
