"""Pick log: verification, grading and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.functions.joins import asof_join
from panelspark.functions.windows import own_rows
from panelspark.sources.tables import GRADE_SCHEMA, LOG_SCHEMA, append_table, read_snapshots, read_table

HORIZON = 20
COST_BPS = 5.0
PICK_KEY = ["run_id", "ticker", "model"]
CHECKED = ["signal_value", "signal_close", "stop_frac"]


def pending(log: DataFrame, grades: DataFrame) -> DataFrame:
    return log.join(grades.select(*PICK_KEY), PICK_KEY, "left_anti")


def repeated_runs(new: DataFrame, log: DataFrame) -> DataFrame:
    """New (decision_date, universe, market) combinations that were already logged."""
    key = ["decision_date", "universe", "market"]
    return new.select(*key).distinct().join(log.select(*key), key, "left_semi")


def assert_new_run(new: DataFrame, log: DataFrame) -> None:
    if not repeated_runs(new, log).isEmpty():
        raise ValueError("a run for this decision date, universe and market exists")


def is_close(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= F.lit(1e-8) + F.lit(1e-5) * F.abs(b)


def verify_signals(log: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Log rows with ``ok``: exactly one snapshot signal, close numbers, an intact hash
    and the same decision date."""
    from panelspark.operators.provenance import record_hash
    hashed = ["decision_date", "model", "ticker", *CHECKED, "run_id"]
    intact = snapshots.withColumn("_intact", record_hash(hashed) == F.col("record_sha256"))
    found = intact.groupBy(*PICK_KEY).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_intact").alias("_intact"), F.min("decision_date").alias("_d"),
        *[F.min(c).alias(f"_{c}") for c in CHECKED])
    close = F.lit(True)
    for c in CHECKED:
        close = close & is_close(F.col(f"_{c}"), F.col(c))
    ok = (F.col("_n") == 1) & F.col("_intact") & (F.col("_d") == F.col("decision_date")) & close
    return log.join(found, PICK_KEY, "left").select(*log.columns, F.coalesce(ok, F.lit(False)).alias("ok"))


def _numbered(bars: DataFrame) -> DataFrame:
    return bars.select("ticker", "Date", "Open", "Close", F.row_number().over(own_rows()).alias("rn"))


def _window(picks: DataFrame, numbered: DataFrame, name: str, horizon: int) -> DataFrame:
    """The next ``horizon`` own rows after each (name, decision_date), met by equality on
    (ticker, row number)."""
    probe = picks.select(F.col(name).alias("ticker"), "decision_date").distinct()
    seen = asof_join(probe, numbered.select("ticker", "Date", "rn"), ["ticker"], "decision_date", "Date",
                     unique_left=True)
    steps = seen.select("ticker", "decision_date", F.coalesce("rn", F.lit(0)).alias("r0")).select(
        "*", F.explode(F.sequence(F.col("r0") + 1, F.col("r0") + horizon)).alias("rn"))
    return steps.join(numbered, ["ticker", "rn"]).withColumn("k", F.col("rn") - F.col("r0"))


def grade(picks: DataFrame, bars: DataFrame, horizon: int = HORIZON, cost_bps: float = COST_BPS) -> DataFrame:
    """Grade picks (run_id, decision_date, ticker, model, market, stop_frac) that have
    ``horizon`` later sessions in both series.

    Entry is the next open; the exit is the first close at or under the stop, else the
    last close; costs are two-way; the market runs from its open to its last close.
    """
    numbered = _numbered(bars)
    ahead = _window(picks, numbered, "ticker", horizon)
    rows = picks.join(ahead, ["ticker", "decision_date"]).withColumn(
        "_entry", F.max(F.when(F.col("k") == 1, F.col("Open"))).over(
            Window.partitionBy(*PICK_KEY, "decision_date")))
    done = F.struct("k", "Date", "Close")
    stopped = F.min(F.when(F.col("Close") <= F.col("_entry") * F.col("stop_frac"), done))
    final = F.max(done)
    own = rows.groupBy(*PICK_KEY, "decision_date", "market").agg(
        F.count(F.lit(1)).alias("_n"), F.max("_entry").alias("entry"), F.min("Date").alias("entry_date"),
        F.coalesce(stopped, final).alias("_x")).where(F.col("_n") == horizon)
    mkt = _window(picks, numbered, "market", horizon).groupBy(F.col("ticker").alias("market"), "decision_date").agg(
        F.count(F.lit(1)).alias("_m"), (F.max_by("Close", "k") / F.min_by("Open", "k") - 1).alias("market_ret")
    ).where(F.col("_m") == horizon)
    ret = F.col("exit") / F.col("entry") - 1 - F.lit(2 * cost_bps / 1e4)
    return own.join(mkt, ["market", "decision_date"]).select(
        "run_id", "decision_date", "ticker", "model", "entry_date", F.col("_x.Date").alias("exit_date"), "entry",
        F.col("_x.Close").alias("exit"), "market_ret").withColumn("ret", ret).withColumn(
        "excess", F.col("ret") - F.col("market_ret"))


def grade_legacy(picks: DataFrame, bars: DataFrame, horizon: int = HORIZON, cost_bps: float = COST_BPS) -> DataFrame:
    """Earlier rule: entry at the reference close, an absolute stop price, and the market
    from its first to its last close of the window."""
    numbered = _numbered(bars)
    ahead = _window(picks, numbered, "ticker", horizon)
    rows = picks.join(ahead, ["ticker", "decision_date"])
    done = F.struct("k", "Close")
    stopped = F.min(F.when(F.col("Close") <= F.col("stop"), done))
    own = rows.groupBy("decision_date", "ticker", "model", "market", "ref_close", "stop").agg(
        F.count(F.lit(1)).alias("_n"), F.coalesce(stopped, F.max(done))["Close"].alias("exit")
    ).where(F.col("_n") == horizon)
    mkt = _window(picks, numbered, "market", horizon).groupBy(F.col("ticker").alias("market"), "decision_date").agg(
        F.count(F.lit(1)).alias("_m"), (F.max_by("Close", "k") / F.min_by("Close", "k") - 1).alias("market_ret")
    ).where(F.col("_m") == horizon)
    ret = F.col("exit") / F.col("ref_close") - 1 - F.lit(2 * cost_bps / 1e4)
    return own.join(mkt, ["market", "decision_date"]).select(
        "decision_date", "ticker", "model", ret.alias("ret"), "market_ret").withColumn(
        "excess", F.col("ret") - F.col("market_ret"))


def grade_pending(spark: SparkSession, bars: DataFrame, log_path: str, grade_path: str, snapshot_path: str | None,
                  now: str | None = None) -> None:
    """Grade what is pending and mature, once: already graded picks are left out, and log
    rows that fail verification stop the job."""
    todo = pending(read_table(spark, log_path, LOG_SCHEMA), read_table(spark, grade_path, GRADE_SCHEMA))
    if snapshot_path is not None:
        bad = verify_signals(todo, read_snapshots(spark, snapshot_path)).where(~F.col("ok")).take(1)
        if bad:
            raise ValueError(f"log row does not match its snapshot: {bad[0].run_id} {bad[0].ticker}")
    # Grading only looks ahead of a decision, so earlier bars and other names are not read.
    todo_from = todo.agg(F.min("decision_date")).scalar()
    names = todo.select("ticker").union(todo.select("market")).distinct()
    recent = bars.where(F.col("Date") > todo_from).join(names, "ticker", "left_semi")
    graded = grade(todo, recent).join(todo.select(*PICK_KEY, "series", "manifest_sha256"), PICK_KEY)
    rounded = graded.select(*[
        F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in graded.dtypes]).withColumn(
        "graded_at_utc", F.lit(now) if now else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX"))
    append_table(rounded, grade_path, GRADE_SCHEMA)
