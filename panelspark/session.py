"""Session defaults and tables written to cut long plans."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

# Settings that matter at cluster scale: AQE splits skewed join partitions and
# coalesces small ones, so shuffle.partitions may be set high.
CLUSTER_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.session.timeZone": "UTC",
}

_own_folder: str | None = None
_shared: dict[tuple[str, str], tuple[str, object]] = {}


def build_session(app: str = "panelspark", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**CLUSTER_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; a private one is made
    only where the setting is absent and the master is local, as in tests."""
    global _own_folder
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        root = named
    elif not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    else:
        if _own_folder is None:
            _own_folder = tempfile.mkdtemp(prefix="spark-panelspark-")
            atexit.register(shutil.rmtree, _own_folder, ignore_errors=True)
        root = _own_folder
    return f"{root.rstrip('/')}/panelspark-{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` once as a table in the work folder and read it back.

    Used where a result feeds several branches: the branches then scan a small
    columnar table whose size the planner knows, instead of repeating the whole plan,
    and a lost executor costs no recomputation beyond its own tasks. ``partition_by``
    lays the table out for pruning; rebalancing keeps files even when one value is hot.
    """
    path = f"{work_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    if partition_by:
        df.hint("rebalance", *partition_by).write.partitionBy(*partition_by).parquet(path)
    else:
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def shared(spark: SparkSession, key: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A table several jobs of this application use, built on first use."""
    known = _shared.get((spark.sparkContext.applicationId, key))
    if known is not None:
        try:
            return spark.read.schema(known[1]).parquet(known[0])
        except AnalysisException:
            pass  # the folder was cleared: build again
    df = build()
    path = f"{work_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _shared[(spark.sparkContext.applicationId, key)] = (path, df.schema)
    return spark.read.schema(df.schema).parquet(path)
