"""Sharding: two-pass external shuffle.

Pass one scatters whole records by a seeded hash into buckets that fit in memory. The hash takes the id, the text and the number of the
input partition, so neither one id nor one text, however often repeated, meets in one bucket. Pass
two sorts a bucket, shuffles it (Spark's ``shuffle`` is Fisher-Yates) and writes it. A record's place in
the whole order is its bucket's offset plus its place in the bucket; the order is cut into shards whose
row counts differ by one at most.

The shuffle's seed is fixed and every bucket is sorted first, so a task that runs again writes the same.

Defined results: a null text has size 16 and the CRC-32 of no bytes; null and repeated ids keep a row each; input
columns named like the result's are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.common import clear_names
from panelspark.session import materialize

NAMES = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
OVERHEAD = 16
GROUP = 1000


def shuffle_records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 11,
                    bucket_bytes: int = 16 << 20) -> DataFrame:
    """bucket, place in the bucket, size, text_crc32 and row, the input's columns; written bucket by bucket."""
    docs = clear_names(docs, NAMES)
    data = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + OVERHEAD
    total = docs.agg(F.sum(data).alias("bytes")).first()["bytes"] or 0
    buckets = max(1, -(-total // bucket_bytes))
    scatter = F.pmod(F.xxhash64(F.lit(seed), id_col, text_col, F.spark_partition_id()), F.lit(buckets))
    # The input travels as one column, so its names can't meet those used here.
    crc = F.crc32(F.coalesce(text_col, F.lit("")).cast("binary"))
    record = F.struct(F.xxhash64(F.lit(seed), F.col(id_col), crc).alias("draw"), F.col(id_col).alias("id"),
                      crc.alias("text_crc32"), data.alias("size"), F.struct(*docs.columns).alias("row"))
    comparable = F.struct(F.col("record.draw"), F.col("record.id"), F.col("record.text_crc32"))
    passed = (docs.select(scatter.alias("bucket"), record.alias("record"))
              .repartition(min(buckets, 1 << 16), "bucket").sortWithinPartitions("bucket", comparable)
              .groupBy("bucket").agg(F.collect_list("record").alias("records"))
              .select("bucket", F.posexplode(F.shuffle("records", seed)).alias("place", "record"))
              .select("bucket", "place", "record.size", "record.text_crc32", "record.row"))
    return materialize(passed)


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", **options) -> DataFrame:
    """docs with size, text_crc32, law (``rows``), shard, slot and grown_shard (null)."""
    done = shuffle_records(docs, id_col=id_col, **options)
    # Offsets in two steps: inside groups of buckets, then over the groups.
    counts = done.groupBy("bucket").agg(F.count("*").alias("n")).withColumn("g", F.floor(F.col("bucket") / GROUP))
    inner = counts.select("bucket", "g", (F.sum("n").over(
        Window.partitionBy("g").orderBy("bucket")) - F.col("n")).alias("inner"))
    outer = counts.groupBy("g").agg(F.sum("n").alias("n")).select("g", (F.sum("n").over(
        Window.orderBy("g")) - F.col("n")).alias("outer"))
    offsets = inner.join(outer, "g").select("bucket", (F.col("inner") + F.col("outer")).alias("offset"))
    # One row per bucket of bucket_bytes. Unless it is broadcast from the start, all records may be shuffled again for it.
    offsets = F.broadcast(offsets)
    rows = done.count()
    at, n, k = F.col("offset") + F.col("place"), F.lit(max(1, rows)), F.lit(shards)
    return (done.join(offsets, "bucket")
            .withColumn("shard", F.floor(at * k / n).cast("int"))
            .withColumns({
                "law": F.lit("rows"), "grown_shard": F.lit(None).cast("int"),
                "slot": at - F.ceil(F.col("shard").cast("long") * n / k)})
            .select("row.*", *NAMES))


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """One folder of Parquet files per shard, in slot order."""
    done = shard(docs, **options)
    done.repartition("shard", F.floor(F.col("slot") / 100_000)).sortWithinPartitions("shard", "slot").write.partitionBy(
        "shard").parquet(path)
