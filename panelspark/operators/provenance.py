"""File fingerprints, record hashes and manifest differences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.session import materialize


def fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 and size of every file under a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"),
                        F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def bundle_digest(files: DataFrame, pattern: str | None = None, fan: int = 1000) -> DataFrame:
    """One digest over names and contents, ordered by the number in the name, then by name.

    A hash tree: the files are numbered in that order by range partitions, each run of ``fan`` of them has a digest of its
    lines, each run of ``fan`` digests has one, up to a single one. No task meets more than ``fan`` of them, and the
    digest does not depend on the partitions.
    """
    rows = files.where(F.col("name").rlike(pattern)) if pattern else files
    number = F.coalesce(F.regexp_extract("name", r"(\d+)", 1).try_cast("bigint"), F.lit(-1))
    line = F.concat_ws(" ", "name", "sha256").alias("line")
    nodes = materialize(number_rows(rows.select(number.alias("n"), "name", "sha256", line), ["n", "name", "sha256"]))
    many = nodes.count()
    left = many
    while True:
        items = F.sort_array(F.collect_list(F.struct("at", "line")))
        nodes = nodes.groupBy(F.floor(F.col("at") / fan).alias("at")).agg(
            F.sha2(F.concat_ws("\n", F.transform(items, lambda x: x["line"])), 256).alias("line"))
        left = -(-left // fan)
        if left <= 1:
            break
    digest = F.coalesce(F.max("line"), F.sha2(F.lit(""), 256)).alias("digest")
    return nodes.agg(F.lit(many).cast("long").alias("files"), digest)


def number_rows(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``at``, their place from 0 in an order over all rows.

    Range partitions are written once, so that both reads see the same; only their sizes are added up.
    """
    # The id's upper bits are the partition, the lower 33 the place in it.
    own = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(
        "_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    sizes = own.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_many"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_many").over(before), F.lit(0)).alias("_start"))
    place = F.col("_start") + F.col("_id").bitwiseAND((1 << 33) - 1)
    return own.withColumn("_part", part).join(F.broadcast(starts), "_part").select(*rows.columns, place.alias("at"))


def record_hash(cols: Sequence[str]) -> Column:
    """Hash of a record that does not depend on the column order."""
    return F.sha2(F.to_json(F.struct(*sorted(cols)), {"ignoreNullFields": "false"}), 256)


def diff_manifest(old: DataFrame, new: DataFrame) -> DataFrame:
    """Paths that are missing, new or changed between two (path, sha256) tables."""
    a = old.select("path", F.col("sha256").alias("_a"))
    b = new.select("path", F.col("sha256").alias("_b"))
    status = (F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "new")
              .when(F.col("_a") != F.col("_b"), "changed"))
    return a.join(b, "path", "full").select("path", status.alias("status")).where(F.col("status").isNotNull())
