"""Keyed streaming grader: open picks wait in a state store, and no bar is read twice.

The state of a ticker holds the bars that the windows of its open picks still need, at most ``horizon`` for each, and nothing for
tickers without picks. Bars may come late, in any order and repeatedly: a window is the first ``horizon`` dates after the
decision, and it closes when the watermark has passed its last date, by a bar of the ticker or by a timer. A closed
window leaves the state as one leg. Each micro-batch appends its legs to its own folder and joins the own legs that wait for
their market's leg; legs are one row per pick, so no batch reads bars of earlier ones.

The picks are those logged when the query starts. A pick whose decision lies before what the stream still holds isn't graded here
and stays pending for ``paper.grade_pending``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from panelspark.operators.paper import COST_BPS, HORIZON, PICK_KEY, pending, verify_signals
from panelspark.sources.bars import VALUES
from panelspark.sources.tables import GRADE_SCHEMA, LOG_SCHEMA, append_table, read_snapshots, read_table

LEG = ("ticker STRING, decision_date DATE, side STRING, run_id STRING, model STRING, market STRING, entry_date DATE, "
       "exit_date DATE, entry DOUBLE, exit DOUBLE")


OPEN, CLOSE = VALUES.index("Open"), VALUES.index("Close")


def rank(values: list) -> list:
    """Nulls first, as in Spark's order of structs."""
    return [(v is not None, v or 0.0) for v in values]


def windows(picks: DataFrame) -> DataFrame:
    """One row per ticker with the windows it is asked for: its own picks, and the decisions it is the market of."""
    own = picks.select("ticker", F.struct(F.lit("own").alias("side"), "run_id", "model", "market",
                                          F.col("decision_date").cast("string").alias("day"), "stop_frac").alias("w"))
    nothing = F.lit(None).cast("string")
    market = picks.select(F.col("market").alias("ticker"), "decision_date").distinct().select("ticker", F.struct(
        F.lit("market").alias("side"), nothing.alias("run_id"), nothing.alias("model"), nothing.alias("market"),
        F.col("decision_date").cast("string").alias("day"), F.lit(None).cast("double").alias("stop_frac")).alias("w"))
    return own.union(market).groupBy("ticker").agg(F.to_json(F.sort_array(F.collect_list("w"))).alias("asked"))


def follow(horizon: int):
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """New bars of one ticker to the legs whose windows close."""
        bars, open_, known = {}, [], set()
        if state.exists:
            held = json.loads(state.get[0])
            bars, open_, known = held["bars"], held["open"], set(held["known"])
        mark = pd.Timestamp(state.getCurrentWatermarkMs(), unit="ms").strftime("%Y-%m-%d")
        for frame in frames:
            if frame.empty:  # a timer
                continue
            for w in json.loads(frame["asked"].iloc[0]):
                name = json.dumps([w.get(c) for c in ("side", "run_id", "model", "day")])
                if name not in known:
                    known.add(name)
                    # What lies before the watermark may have gone by, unless the state still holds it.
                    if w["day"] >= mark or (bars and w["day"] >= min(bars)):
                        open_.append(w)
            for day, *values in frame[["day", *VALUES]].astype({v: object for v in VALUES}).itertuples(index=False):
                own = [None if pd.isna(v) else float(v) for v in values]
                if day not in bars or rank(own) < rank(bars[day]):  # of differing copies the same one in any order
                    bars[day] = own
        days, still, waiting, legs, need = sorted(bars), [], [], [], set()
        for w in open_:
            window = [d for d in days if d > w["day"]][:horizon]
            if len(window) < horizon or window[-1] > mark:
                still.append(w)
                need.update(window)
                waiting += window[horizon - 1:]
                continue
            entry = bars[window[0]][OPEN]
            out = window[-1]
            if w["side"] == "own":
                out = next((d for d in window if bars[d][CLOSE] <= entry * w["stop_frac"]), out)
            legs.append((key[0], w["day"], w["side"], w.get("run_id"), w.get("model"), w.get("market"), window[0], out, entry, bars[out][CLOSE]))
        need.update(d for d in days if d > mark)
        # Names of windows stay only while their bars could come again as new.
        state.update((json.dumps({"bars": {d: bars[d] for d in days if d in need}, "open": still, "known": sorted(known)}),))
        if waiting:
            ahead = int(pd.Timestamp(min(waiting)).value // 1_000_000)
            state.setTimeoutTimestamp(max(ahead, state.getCurrentWatermarkMs() + 1))
        frame = pd.DataFrame(legs, columns=["ticker", "decision_date", "side", "run_id", "model", "market", "entry_date", "exit_date",
                                            "entry", "exit"])
        for c in ("decision_date", "entry_date", "exit_date"):
            frame[c] = pd.to_datetime(frame[c]).dt.date
        yield frame
    return step


def legs(stream: DataFrame, picks: DataFrame, late: str = "30 days", horizon: int = HORIZON) -> DataFrame:
    """A stream of bars and the picks to follow, to a stream of closed legs."""
    timed = stream.withColumn("at", F.col("Date").cast("timestamp")).withWatermark("at", late)
    asked = timed.join(windows(picks), "ticker").where(F.col("Open").isNotNull() & F.col("Close").isNotNull()).select(
        "ticker", F.col("Date").cast("string").alias("day"), *VALUES, "asked", "at")
    return asked.groupBy("ticker").applyInPandasWithState(
        follow(horizon), LEG, "held STRING", "append", GroupStateTimeout.EventTimeTimeout)


def state_partitions(log: DataFrame, names: int = 100) -> int:
    """A state partition for every ``names`` tickers of the log and one a core at least; never more than the session's setting.

    Every micro-batch opens, asks and commits each partition, whether or not it holds a ticker. A checkpoint keeps the number it began with.
    """
    spark = log.sparkSession
    tickers = log.select(F.explode(F.array("ticker", "market")).alias("ticker")).distinct().count()
    return min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(spark.sparkContext.defaultParallelism, -(-tickers // names)))


def grade_legs(spark: SparkSession, leg_path: str, log_path: str, grade_path: str, cost_bps: float, now: str | None = None) -> None:
    """Grades of pending picks both of whose legs are there."""
    rows = read_table(spark, leg_path, LEG)
    todo = pending(read_table(spark, log_path, LOG_SCHEMA), read_table(spark, grade_path, GRADE_SCHEMA))
    own = rows.where("side = 'own'").drop("side").dropDuplicates(PICK_KEY)
    market = rows.where("side = 'market'").select(
        F.col("ticker").alias("market"), "decision_date", (F.col("exit") / F.col("entry") - 1).alias("market_ret")).distinct()
    ret = F.col("exit") / F.col("entry") - 1 - F.lit(2 * cost_bps / 1e4)
    done = (own.join(market, ["market", "decision_date"]).join(todo.select(*PICK_KEY, "series", "manifest_sha256"), PICK_KEY)
            .withColumn("ret", ret).withColumn("excess", F.col("ret") - F.col("market_ret")))
    rounded = done.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in done.dtypes]).withColumn(
        "graded_at_utc", F.lit(now) if now else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX"))
    append_table(rounded, grade_path, GRADE_SCHEMA)


def stream_grade_keyed(stream: DataFrame, log_path: str, grade_path: str, leg_path: str, checkpoint: str,
                       snapshot_path: str | None = None, late: str = "30 days", horizon: int = HORIZON,
                       cost_bps: float = COST_BPS) -> StreamingQuery:
    """Start the grader over what has arrived; ``snapshot_path`` has each logged pick checked before any bar is read."""
    spark = stream.sparkSession
    log = read_table(spark, log_path, LOG_SCHEMA)
    todo = pending(log, read_table(spark, grade_path, GRADE_SCHEMA))
    if snapshot_path is not None:
        bad = verify_signals(todo, read_snapshots(spark, snapshot_path)).where(~F.col("ok")).take(1)
        if bad:
            raise ValueError(f"log row does not match its snapshot: {bad[0].run_id} {bad[0].ticker}")

    def run(batch: DataFrame, batch_id: int) -> None:
        # A batch that runs again replaces its own legs.
        batch.write.mode("overwrite").parquet(f"{leg_path}/batch={batch_id}")
        grade_legs(batch.sparkSession, leg_path, log_path, grade_path, cost_bps)

    # A started query keeps the settings it was started with.
    setting = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(state_partitions(log)))
    try:
        return (legs(stream, log, late, horizon).writeStream.option("checkpointLocation", checkpoint)
                .trigger(availableNow=True).foreachBatch(run).start())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", setting)
