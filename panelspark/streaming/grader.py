"""File-stream grader: bars arrive as files, matured picks are graded once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from panelspark.operators.paper import grade_pending
from panelspark.sources.bars import BAR_COLUMNS, dedupe_bars

STREAM_SCHEMA = "ticker STRING, Date DATE, Open DOUBLE, High DOUBLE, Low DOUBLE, Close DOUBLE, Volume DOUBLE"


def bars_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(STREAM_SCHEMA)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def stream_grade(stream: DataFrame, log_path: str, grade_path: str, bars_path: str, checkpoint: str,
                 snapshot_path: str | None = None) -> StreamingQuery:
    """Start the grader over what has arrived.

    Each micro-batch is written to its own batch folder of the bar table, so a replayed
    batch replaces itself, and pending picks are graded against all bars so far. Grades
    are idempotent because graded picks are no longer pending.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{bars_path}/batch={batch_id}")
        bars = dedupe_bars(spark.read.parquet(bars_path).select(*BAR_COLUMNS))
        grade_pending(spark, bars, log_path, grade_path, snapshot_path)

    return (stream.writeStream.option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).foreachBatch(run).start())
