"""Helpers the corpus operators share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.session import materialize

#: Characters that separate words, as a regular expression class body.
WHITE = r"\x20\x09-\x0D"

#: A key is hot when it holds at least this part of all rows, so there are at most HOT hot keys.
HOT = 1000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def clear_names(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``df`` without input columns that an operator's own result columns would clash with."""
    return df.drop(*[c for c in df.columns if c.lower() in {n.lower() for n in names}])


def attach(left: DataFrame, right: DataFrame, key: str, rows: str, total: int, spread: Column) -> DataFrame:
    """Left join of ``right``, one row per ``key``, onto ``left`` whatever the skew.

    ``rows`` is right's number of left rows with the key and ``total`` the number of left rows.
    At most HOT keys hold a HOT-th of the rows each; those are broadcast, which bounds the
    broadcast by HOT rows. Their left rows are dealt out by ``spread`` (a long) in the join of
    the remaining keys, so no task meets a whole hot group.
    """
    payload = [c for c in right.columns if c not in (key, rows)]
    is_hot = F.col(rows) * HOT >= F.lit(total)
    hot = right.where(is_hot).select(F.col(key).alias("__key"), F.struct(rows, *payload).alias("__hot"))
    cold = right.where(~is_hot).select(
        F.col(key).alias("__cold_key"), F.lit(0).cast("long").alias("__cold_spread"),
        F.struct(rows, *payload).alias("__cold"))
    kind = left.schema[key].dataType
    marked = left.join(F.broadcast(hot), F.col(key) == F.col("__key"), "left").withColumns({
        "__left_key": F.when(F.col("__hot").isNull(), F.col(key)).otherwise(F.lit(None).cast(kind)),
        "__left_spread": F.when(F.col("__hot").isNull(), F.lit(0).cast("long")).otherwise(spread)})
    joined = marked.join(
        cold, F.col("__left_key").eqNullSafe(F.col("__cold_key"))
        & (F.col("__left_spread") == F.col("__cold_spread")), "left")
    found = F.coalesce("__hot", "__cold")
    return joined.select(*left.columns, *[found[c].alias(c) for c in (rows, *payload)])


def maybe_in(df: DataFrame, key: Column, keys: DataFrame, name: str, among: bool = True, bits: int = 26) -> DataFrame:
    """Rows of ``df`` whose ``key`` may be among ``keys`` (column ``name``), or those where it surely isn't (``among`` False).

    The keys' hashes are marked in a bit map of 2**bits places, which alone is broadcast: 8 MB at 26 whatever the number
    of keys. Rows that share a place with a key pass as well; with very many keys all do. So wide rows
    are left where they are, and the plan is the same at every size.
    """
    place = lambda k: F.pmod(F.xxhash64(k), F.lit(1 << bits))
    spot = place(F.col(name)).alias("p")
    maps = keys.select(spot).groupBy(F.shiftright("p", 15).alias("__bucket")).agg(
        F.bitmap_construct_agg(F.col("p").bitwiseAND(F.lit(32767))).alias("__map"))
    at = F.col("__at").bitwiseAND(F.lit(32767))
    byte = F.conv(F.hex(F.substring("__map", (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), (at.bitwiseAND(F.lit(7)) + 1).cast("int"))
    marked = F.coalesce(byte.bitwiseAND(bit) != 0, F.lit(False))
    met = df.withColumn("__at", place(key)).join(F.broadcast(maps), F.shiftright("__at", 15) == F.col("__bucket"), "left")
    return met.where(marked if among else ~marked).select(*df.columns)


def keep_one(docs: DataFrame, keyed: DataFrame, keys: Sequence[str], multi: DataFrame) -> DataFrame:
    """Rows of ``docs`` that stay after duplicates go.

    ``keyed`` is docs with the two columns ``keys`` added. ``multi``, a written table, lists the keys of rows in groups of
    several rows: ``keys``, ``stays`` (this key's row stays) and ``repeats`` (rows with the same
    key). Of repeated rows with one key the first one met stays. Rows that surely aren't listed stay where they are
    read; only the others meet the list.
    """
    right = multi.select(*[F.col(k).alias(f"__m{i}") for i, k in enumerate(keys)], "stays", "repeats").where(
        ~F.col("stays") | (F.col("repeats") > 1))
    match = [F.col(k).eqNullSafe(F.col(f"__m{i}")) for i, k in enumerate(keys)]
    listed = right.select(F.xxhash64(*[F.col(f"__m{i}") for i in range(len(keys))]).alias("__hash"))
    own = F.xxhash64(*keys)
    away = maybe_in(keyed, own, listed, "__hash", among=False).select(*docs.columns)
    near = maybe_in(keyed, own, listed, "__hash")
    kept = away.unionByName(near.join(right, match, "left_anti").select(*docs.columns))
    again = materialize(right.where(F.col("stays") & (F.col("repeats") > 1)))
    if again.isEmpty():
        return kept
    first = (near.select(*keys, F.struct(*docs.columns).alias("__row")).join(again, match, "left_semi")
             .groupBy(*keys).agg(F.first("__row").alias("__row")).select("__row.*"))
    return kept.unionByName(first)


def components(edges: DataFrame) -> DataFrame:
    """Connected components: ``edges`` (a, b), both long, to (node, label), the smallest node reachable.

    Labels hop to the smallest neighbour's and then to their own label's label, both as joins;
    a round is written to the shared folder, so that no plan grows with the rounds.
    """
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = both.groupBy("a").agg(F.min("b").alias("m")).select(
        F.col("a").alias("node"), F.least("a", "m").alias("label"))
    labels = materialize(labels)
    while True:
        over = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        jumped = labels.join(over, "label").select("node", F.col("label").alias("old"), F.col("next").alias("label"))
        near = both.join(jumped.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(
            F.min("label").alias("m"))
        new = materialize(jumped.join(near.withColumnRenamed("a", "node"), "node").select(
            "node", "old", F.least("label", "m").alias("label")))
        labels = new.select("node", "label")
        if new.where("old != label").isEmpty():
            return labels
