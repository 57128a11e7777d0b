import pytest
from pyspark.sql import functions as F

from panelspark.operators import paper
from panelspark.sources import tables
from panelspark.streaming import grader
from tests.helpers import days

BARS = "ticker STRING, Date DATE, Open DOUBLE, High DOUBLE, Low DOUBLE, Close DOUBLE, Volume DOUBLE"
PICK = "run_id STRING, decision_date DATE, ticker STRING, model STRING, market STRING, stop_frac DOUBLE, ref_close DOUBLE, stop DOUBLE"


def market_rows(n=21):
    ds = days(n, "2026-09-01")
    closes = [95.0, 80.0] + [90.0] * (n - 2)
    asset = [("AAA", d, 100.0, 100.0, 70.0, c, 1.0) for d, c in zip(ds[1:], closes)]
    mkt = [("MKT", d, 50.0, 60.0, 40.0, 50.0 + 0.25 * i, 1.0) for i, d in enumerate(ds)]
    return ds, asset, mkt


def test_grade_next_open_gap_stop_and_costs(spark):
    ds, asset, mkt = market_rows()
    picks = spark.createDataFrame([("r", ds[0], "AAA", "m", "MKT", 0.85, 100.0, 85.0)], PICK)
    row = paper.grade(picks, spark.createDataFrame(asset + mkt, BARS)).first()
    assert (row.entry, row.exit, row.entry_date, row.exit_date) == (100.0, 80.0, ds[1], ds[2])
    assert row.ret == pytest.approx(-0.20 - 2 * 5e-4)
    assert row.market_ret == pytest.approx(55.0 / 50.0 - 1) and row.excess == pytest.approx(row.ret - row.market_ret)


def test_grade_waits_for_the_full_window(spark):
    ds, asset, mkt = market_rows()
    picks = spark.createDataFrame([("r", ds[0], "AAA", "m", "MKT", 0.85, 100.0, 85.0)], PICK)
    assert paper.grade(picks, spark.createDataFrame(asset[:-1] + mkt, BARS)).count() == 0


def test_grade_legacy(spark):
    ds, asset, mkt = market_rows()
    picks = spark.createDataFrame([("r", ds[0], "AAA", "m", "MKT", 0.85, 98.0, 70.0)], PICK)
    row = paper.grade_legacy(picks, spark.createDataFrame(asset + mkt, BARS)).first()
    assert row.ret == pytest.approx(90.0 / 98.0 - 1 - 1e-3) and row.market_ret == pytest.approx(55.0 / 50.25 - 1)


def log_frame(spark, ds):
    rows = [("s", "r1", "now", ds[0], "AAA", 0.5, 100.0, 0.85, "next", "m", "u", "MKT", "c", "h"),
            ("s", "r2", "now", ds[10], "AAA", 0.6, 100.0, 0.85, "next", "m", "u", "MKT", "c", "h")]
    return spark.createDataFrame(rows, tables.LOG_SCHEMA)


def test_pending_and_duplicate_guard(spark):
    ds, *_ = market_rows()
    log = log_frame(spark, ds)
    done = log.where("run_id = 'r1'").select("run_id", "ticker", "model")
    assert [r.run_id for r in paper.pending(log, done).collect()] == ["r2"]
    paper.assert_new_run(log.where("run_id = 'r2'"), log.where("run_id = 'r1'"))
    with pytest.raises(ValueError):
        paper.assert_new_run(log, log)


def test_verification(spark, tmp_path):
    ds, *_ = market_rows()
    log = log_frame(spark, ds)
    path = str(tmp_path / "snap")
    tables.write_snapshot(log, path)
    good = tables.read_snapshots(spark, path)
    assert all(r.ok for r in paper.verify_signals(log, good).collect())
    for bad in (good.withColumn("signal_close", F.col("signal_close") + 1), good.unionByName(good), good.limit(0),
                good.withColumn("record_sha256", F.lit("x"))):
        assert not any(r.ok for r in paper.verify_signals(log, bad).collect())
    near = log.withColumn("signal_value", F.col("signal_value") * 1.000001)
    assert all(r.ok for r in paper.verify_signals(near, good).collect())


def test_stream_grades_once_as_bars_arrive(spark, tmp_path):
    ds, asset, mkt = market_rows(35)
    root = str(tmp_path)
    tables.append_table(log_frame(spark, ds), f"{root}/log", tables.LOG_SCHEMA)
    tables.write_snapshot(log_frame(spark, ds), f"{root}/snap")
    everything = spark.createDataFrame(asset + mkt, BARS)

    def run():
        stream = grader.bars_stream(spark, f"{root}/in")
        query = grader.stream_grade(stream, f"{root}/log", f"{root}/grades", f"{root}/bars", f"{root}/ckpt", f"{root}/snap")
        query.awaitTermination()
        return sorted(r.run_id for r in tables.read_table(spark, f"{root}/grades", tables.GRADE_SCHEMA).collect())

    everything.where(F.col("Date") <= F.lit(ds[25])).write.mode("append").parquet(f"{root}/in")
    assert run() == ["r1"]
    assert run() == ["r1"]
    everything.where(F.col("Date") > F.lit(ds[25])).write.mode("append").parquet(f"{root}/in")
    assert run() == ["r1", "r2"]
