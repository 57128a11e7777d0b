"""Walk-forward folds, purging and the scored-fold cache."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from panelspark.functions.joins import same_rows

TRAIN_DAYS, VAL_DAYS, TEST_DAYS, EMBARGO_DAYS = 1095, 180, 180, 20
FOLD_COLUMNS = "ticker STRING, Date DATE, Close DOUBLE, label DOUBLE, proba DOUBLE, arm STRING, fold INT"


def fold_calendar(panel: DataFrame, train: int = TRAIN_DAYS, val: int = VAL_DAYS, test: int = TEST_DAYS) -> DataFrame:
    """One row per walk-forward fold with half-open day ranges."""
    span = panel.agg(F.min("Date").alias("_a"), F.max("Date").alias("_b"))
    first = F.date_add("_a", train)
    steps = F.floor(F.datediff(F.date_sub("_b", val + test), first) / test).cast("int")
    fold = span.where(steps >= 0).select("_a", F.explode(F.sequence(F.lit(0), steps)).alias("fold"))
    start = F.date_add(F.date_add("_a", train), F.col("fold") * test)
    return fold.select(
        "fold", F.date_sub(start, train).alias("train_start"), start.alias("val_start"),
        F.date_add(start, val).alias("test_start"), F.date_add(start, val + test).alias("test_end"))


def assign_folds(panel: DataFrame, train: int = TRAIN_DAYS, val: int = VAL_DAYS, test: int = TEST_DAYS,
                 roles: Sequence[str] = ("train", "val", "test")) -> DataFrame:
    """Every panel row once per (fold, role) whose range holds its date, for the ``roles`` asked for.

    Folds lie on a regular grid, so the memberships follow from the day offset; no
    range join is needed. The only side input is the date span, a scalar subquery.
    """
    span = panel.agg(F.struct(F.min("Date").alias("a"), F.max("Date").alias("b"))).scalar()
    day = F.datediff("Date", "_s.a")
    last = F.floor((F.datediff("_s.b", "_s.a") - train - val - test) / test).cast("int")

    def members(role: str, start: int, length: int):
        # fold k covers [start + k*test, start + length + k*test) in day offsets
        low = F.greatest(F.floor((day - start - length) / test) + 1, F.lit(0)).cast("int")
        high = F.least(F.floor((day - start) / test).cast("int"), last)
        if length <= test:  # ranges that don't overlap hold a day once at most
            return F.when(low <= high, F.array(F.struct(low.alias("fold"), F.lit(role).alias("role"))))
        return F.when(low <= high, F.transform(
            F.sequence(low, high), lambda k: F.struct(k.alias("fold"), F.lit(role).alias("role"))))

    spans = {"train": (0, train), "val": (train, val), "test": (train + val, test)}
    none = F.array().cast("array<struct<fold:int,role:string>>")
    found = F.concat(*[F.coalesce(members(r, *spans[r]), none) for r in roles])
    placed = panel.withColumn("_s", span).select(
        *panel.columns, "_s", F.explode(found).alias("_m"))
    val_start = F.date_add("_s.a", F.lit(train) + F.col("_m.fold") * test)
    return placed.select(*panel.columns, "_m.fold", "_m.role", val_start.alias("val_start"),
                         F.date_add(val_start, val).alias("test_start"))


def purge(assigned: DataFrame, embargo: int = EMBARGO_DAYS) -> DataFrame:
    """Drop training and validation rows whose outcome reaches the next range."""
    role = F.col("role")
    keep = ((role == "test")
            | ((role == "train") & (F.col("label_end") < F.date_sub("val_start", embargo)))
            | ((role == "val") & (F.col("label_end") < F.date_sub("test_start", embargo))))
    return assigned.where(keep)


def purge_legacy(assigned: DataFrame, embargo: int = EMBARGO_DAYS) -> DataFrame:
    """The earlier rule: training rows cut by date only, validation left alone."""
    return assigned.where((F.col("role") != "train") | (F.col("Date") < F.date_sub("val_start", embargo)))


def gate_folds(assigned: DataFrame, train: int = 500, val: int = 100, test: int = 100) -> DataFrame:
    """Keep folds with enough rows in every role."""
    return assigned.join(F.broadcast(gated(fold_sizes(assigned), train, val, test)), "fold", "left_semi")


def gated(sizes: DataFrame, train: int = 500, val: int = 100, test: int = 100) -> DataFrame:
    """Folds with enough rows in every role."""
    return sizes.where((F.col("train") > train) & (F.col("val") > val) & (F.col("test") > test)).select("fold")


def fold_rows(panel: DataFrame, span: Row, embargo: int = EMBARGO_DAYS) -> DataFrame:
    """Purged rows of one fold with their role; ``span`` is the fold's row of the calendar.

    All bounds are literals, so a panel kept in the order of dates is read only where the fold lies.
    """
    train, val, test, end = [F.lit(span[c]) for c in ("train_start", "val_start", "test_start", "test_end")]
    day = F.col("Date")
    role = F.when(day >= test, "test").when(day >= val, "val").otherwise("train")
    keep = ((day >= test) | ((day >= val) & (F.col("label_end") < F.date_sub(test, embargo)))
            | ((day < val) & (F.col("label_end") < F.date_sub(val, embargo))))
    return panel.where((day >= train) & (day < end) & keep).withColumn("role", role)


def fold_sizes(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("fold").agg(*[
        F.count_if(F.col("role") == r).alias(r) for r in ("train", "val", "test")])


def assert_same_test_rows(a: DataFrame, b: DataFrame) -> None:
    """Two ablation arms must share fold count and test rows."""
    key = ["fold", "Date", "ticker"]
    left, right = [d.where(F.col("role") == "test").select(*key) for d in (a, b)]
    if not same_rows(left, right):
        raise ValueError("test rows differ between the arms")


def trailing_split(panel: DataFrame, val: int = VAL_DAYS, train: int = TRAIN_DAYS,
                   embargo: int = EMBARGO_DAYS) -> DataFrame:
    """Live split: the newest ``val`` days validate, the ``train`` days before them
    train after purging."""
    start = F.date_sub("_b", val)
    role = (F.when(F.col("Date") >= start, "val")
            .when((F.col("Date") >= F.date_sub(start, train)) & (F.col("label_end") < F.date_sub(start, embargo)),
                  "train"))
    newest = panel.agg(F.max("Date")).scalar()
    return panel.withColumn("_b", newest).withColumn("role", role).where("role IS NOT NULL").drop("_b")


def write_folds(scored: DataFrame, path: str) -> None:
    """Scored test rows, partitioned by arm and fold; an existing path is refused."""
    assert_unique(scored, ["arm", "Date", "ticker"])
    (scored.select("ticker", "Date", "Close", "label", "proba", "arm", "fold").hint("rebalance", "arm", "fold")
     .write.mode("errorifexists").partitionBy("arm", "fold").parquet(path))


def read_folds(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    df = spark.read.schema(FOLD_COLUMNS).parquet(path)
    if check:
        assert_unique(df, ["arm", "Date", "ticker"])
    return df


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def assert_unique(df: DataFrame, keys: list[str]) -> None:
    repeated = duplicates(df, keys).take(1)
    if repeated:
        raise ValueError(f"duplicate rows for {keys}: {repeated[0].asDict()}")


def split_halves(df: DataFrame, key: str) -> DataFrame:
    """Tag the first half of the distinct key values (rounded down) ``tune``, the
    rest ``hold``."""
    from pyspark.sql import Window
    values = df.select(key).distinct()
    numbered = values.select(key, F.row_number().over(Window.orderBy(key)).alias("_i"),
                             F.count(F.lit(1)).over(Window.partitionBy()).alias("_n"))
    tags = numbered.select(key, F.when(F.col("_i") <= F.floor(F.col("_n") / 2), "tune").otherwise("hold").alias("half"))
    return df.join(F.broadcast(tags), key)


def last_folds(df: DataFrame, k: int) -> DataFrame:
    """Rows of the newest k folds."""
    newest = df.select("fold").distinct().orderBy(F.desc("fold")).limit(k)
    return df.join(F.broadcast(newest), "fold", "left_semi")
