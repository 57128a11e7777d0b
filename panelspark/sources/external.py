"""Another engine's results: equity JSON, order symbols and text logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESULT_SCHEMA = (
    "STRUCT<charts: MAP<STRING, STRUCT<series: MAP<STRING, STRUCT<values: ARRAY<ARRAY<DOUBLE>>>>>>, "
    "orders: MAP<STRING, STRUCT<symbol: STRUCT<value: STRING, id: STRING>>>, "
    "statistics: MAP<STRING, STRING>>"
)
CHART, SERIES = "Strategy Equity", "Equity"
EXCHANGE_ZONE = "America/New_York"

# Intermediate symbols that neither the first nor the current name shows.
SYMBOL_OVERRIDES = {"BSIG": "AAMI", "NYMT": "ADAM"}
PICK_PATTERN = r"^(\d{4}-\d{2})-\d{2} .*? picks: ([A-Z0-9,.-]+)$"


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document per file."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.col("_metadata.file_name").alias("source"), F.col("value").alias("payload"))


def parse_results(documents: DataFrame) -> DataFrame:
    return documents.select("source", F.from_json("payload", RESULT_SCHEMA).alias("r"))


def exchange_day(epoch_seconds) -> F.Column:
    """Calendar day in the exchange's zone, whatever the session zone."""
    utc = F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(secs=epoch_seconds)
    return F.convert_timezone(F.lit("UTC"), F.lit(EXCHANGE_ZONE), utc).cast("date")


def daily_equity(documents: DataFrame) -> DataFrame:
    """Last close per exchange day; a repeated timestamp keeps its later entry."""
    values = F.col("r.charts")[CHART]["series"][SERIES]["values"]
    points = parse_results(documents).select("source", F.posexplode(values).alias("pos", "v"))
    rows = points.select("source", "pos", F.col("v")[0].cast("bigint").alias("ts"), F.col("v")[4].alias("close"))
    return rows.groupBy("source", exchange_day(F.col("ts")).alias("Date")).agg(
        F.max_by("close", F.struct("ts", "pos")).alias("equity"))


def symbol_map(documents: DataFrame) -> DataFrame:
    """(source, symbol, current): current names, first names from permanent ids and the
    fixed overrides, which win."""
    orders = parse_results(documents).select("source", F.explode(F.map_values("r.orders")).alias("o"))
    named = orders.where(F.coalesce(F.col("o.symbol.value"), F.lit("")) != "").select(
        "source", F.col("o.symbol.value").alias("current"), F.col("o.symbol.id").alias("id"))
    first = F.split("id", r"\s+")[0]
    entries = named.select("source", "current", F.explode(F.array("current", F.when(first != "", first))).alias("symbol"))
    known = entries.where(F.col("symbol").isNotNull()).groupBy("source", "symbol").agg(F.max("current").alias("current"))
    fixed = F.inline(F.array(*[F.struct(F.lit(k).alias("symbol"), F.lit(v).alias("current"))
                               for k, v in SYMBOL_OVERRIDES.items()]))
    extra = documents.select("source").distinct().select("source", fixed)
    return known.join(extra.select("source", "symbol"), ["source", "symbol"], "left_anti").unionByName(
        extra.select("source", "symbol", "current"))


def picks_from_log(lines: DataFrame) -> DataFrame:
    """(source, month, symbol) from log lines that announce picks."""
    month = F.regexp_extract("value", PICK_PATTERN, 1)
    picks = F.regexp_extract("value", PICK_PATTERN, 2)
    return lines.where(F.col("value").rlike(PICK_PATTERN)).select(
        "source", F.to_date(F.concat(month, F.lit("-01"))).alias("month"), F.explode(F.split(picks, ",")).alias("symbol"))


def current_symbols(picks: DataFrame, mapping: DataFrame) -> DataFrame:
    """Picks under today's names; unknown symbols stay as they are. The mapping has one
    row per traded symbol and is left to the planner."""
    return picks.join(mapping, ["source", "symbol"], "left").select(
        "source", "month", "symbol", F.coalesce("current", "symbol").alias("ticker"))


def pick_sets(picks: DataFrame) -> DataFrame:
    return picks.groupBy("source", "month").agg(
        F.sort_array(F.collect_set("ticker")).alias("ext_picks"), F.count(F.lit(1)).alias("ext_n"))
