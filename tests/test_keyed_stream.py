"""The keyed grader against the batch grader, bars in any order."""

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from panelspark.operators import paper
from panelspark.sources import tables
from panelspark.streaming import grader, keyed
from tests.helpers import days
from tests.test_paper import BARS

COLUMNS = ["run_id", "decision_date", "ticker", "model", "entry_date", "exit_date", "entry", "exit", "ret", "market_ret", "excess"]


def bars_of(rng, names, ds):
    return [(n, d, 100 + rng.randrange(20), 130.0, 70.0, 100.0 + rng.randrange(-12, 12), 1.0)
            for n in names for d in ds if n == "MKT" or rng.random() > 0.2]


def log_of(spark, ds, names):
    rows = [("s", f"r{k}", "now", ds[k], n, 0.5, 100.0, 0.95, "next", "m", "u", "MKT", "c", "h")
            for k in range(0, len(ds) - 5, 7) for n in names if n != "MKT"]
    return spark.createDataFrame(rows, tables.LOG_SCHEMA)


def test_batches_late_and_repeated_bars(spark, tmp_path):
    rng, root, names, ds = random.Random(3), str(tmp_path), ["AAA", "BBB", "CCC", "MKT"], days(90, "2026-01-05")
    rows = [(n, d, float(o), h, lo, c, v) for n, d, o, h, lo, c, v in bars_of(rng, names, ds)]
    log = log_of(spark, ds, names)
    tables.append_table(log, f"{root}/log", tables.LOG_SCHEMA)
    tables.write_snapshot(log, f"{root}/snap")
    parts, held = [], []
    for first in range(0, 90, 20):
        own = [r for r in rows if ds[first] <= r[1] <= ds[min(89, first + 19)]]
        late = [r for r in own if (ds[min(89, first + 19)] - r[1]).days < 9 and rng.random() < 0.4]
        parts.append([r for r in own if r not in late] + held + rng.sample(own, 5))
        held = late
    parts.append([*held, ("~", ds[-1] + timedelta(60), 1.0, 1.0, 1.0, 1.0, 1.0)])
    counts = []
    for part in parts:
        rng.shuffle(part)
        spark.createDataFrame(part, BARS).coalesce(1).write.mode("append").parquet(f"{root}/in")
        query = keyed.stream_grade_keyed(grader.bars_stream(spark, f"{root}/in", 1), f"{root}/log", f"{root}/grades", f"{root}/legs",
                                         f"{root}/ckpt", f"{root}/snap")
        query.awaitTermination()
        counts.append(tables.read_table(spark, f"{root}/grades", tables.GRADE_SCHEMA).count())
    picks = log.select("run_id", "decision_date", "ticker", "model", "market", "stop_frac", F.lit(0.0).alias("ref_close"), F.lit(0.0).alias("stop"))
    want = paper.grade(picks, spark.createDataFrame(rows, BARS)).select(
        *[F.round(c, 6).alias(c) if c in ("entry", "exit", "ret", "market_ret", "excess") else c for c in COLUMNS])
    got = tables.read_table(spark, f"{root}/grades", tables.GRADE_SCHEMA).select(*COLUMNS)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert counts[-1] == want.count() > 20 and any(0 < c < counts[-1] for c in counts) and counts == sorted(counts)


def test_state_partitions_follow_the_tickers(spark, tmp_path):
    """Few tickers take a partition a core, not all that the session would shuffle to, and the session's setting stays."""
    root, ds, key = str(tmp_path), days(40, "2026-01-05"), "spark.sql.shuffle.partitions"
    tables.append_table(log_of(spark, ds, ["AAA", "BBB"]), f"{root}/log", tables.LOG_SCHEMA)
    rows = [(n, d, 100.0, 130.0, 70.0, 100.0, 1.0) for n in ("AAA", "BBB", "MKT") for d in [*ds, ds[-1] + timedelta(60)]]
    spark.createDataFrame(rows, BARS).coalesce(1).write.parquet(f"{root}/in")
    cores, before = spark.sparkContext.defaultParallelism, spark.conf.get(key)
    spark.conf.set(key, str(3 * cores))
    try:
        query = keyed.stream_grade_keyed(grader.bars_stream(spark, f"{root}/in"), f"{root}/log", f"{root}/grades", f"{root}/legs", f"{root}/ckpt")
        query.awaitTermination()
        assert spark.conf.get(key) == str(3 * cores)
        many = spark.range(20 * cores - 1).select(F.col("id").cast("string").alias("ticker"), F.lit("MKT").alias("market"))
        assert [keyed.state_partitions(many, names) for names in (10, 5, 1000)] == [2 * cores, 3 * cores, cores]
    finally:
        spark.conf.set(key, before)
    assert {s["numShufflePartitions"] for p in query.recentProgress for s in p["stateOperators"]} == {cores}
    assert tables.read_table(spark, f"{root}/grades", tables.GRADE_SCHEMA).count() == 6


def test_snapshot_check(spark, tmp_path):
    root, ds = str(tmp_path), days(30, "2026-01-05")
    log = log_of(spark, ds, ["AAA"])
    tables.append_table(log, f"{root}/log", tables.LOG_SCHEMA)
    tables.write_snapshot(log.withColumn("signal_close", F.col("signal_close") + 1), f"{root}/snap")
    stream = spark.readStream.schema(grader.STREAM_SCHEMA).parquet(root)
    with pytest.raises(ValueError):
        keyed.stream_grade_keyed(stream, f"{root}/log", f"{root}/grades", f"{root}/legs", f"{root}/ckpt", f"{root}/snap")


def test_state_holds_open_windows_only():
    """Bars behind the watermark go unless an open pick needs them."""
    import json

    import pandas as pd

    class State:
        exists, get, mark = False, (None,), 0

        def update(self, value):
            self.exists, self.get = True, value

        def getCurrentWatermarkMs(self):
            return self.mark

        def setTimeoutTimestamp(self, at):
            assert at > self.mark

    state, step = State(), keyed.follow(3)
    asked = json.dumps([{"side": "own", "run_id": "r", "model": "m", "market": "K", "day": "2026-01-03", "stop_frac": 0.5}])
    frame = lambda ds: pd.DataFrame({"day": ds, "Open": 1.0, "High": 3.0, "Low": 0.5, "Close": 2.0, "Volume": 1.0, "asked": asked})
    assert next(step(("T",), iter([frame(["2026-01-02", "2026-01-04", "2026-01-06", "2026-01-07"])]), state)).empty
    state.mark = int(pd.Timestamp("2026-01-06").value // 1_000_000)
    assert next(step(("T",), iter([frame(["2026-01-05"])]), state)).empty is False  # the late bar is in the window
    assert json.loads(state.get[0])["open"] == [] and list(json.loads(state.get[0])["bars"]) == ["2026-01-07"]
