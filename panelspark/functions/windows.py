"""Window helpers on the two clocks of a bar panel.

*Own rows*: features shift by the ticker's own bars. Bars are unique per
(ticker, Date), so a ticker's window never holds more rows than the calendar has
days, whatever share of the raw input the ticker has.

*Sessions*: holding periods and formation windows shift by the union calendar.
Session ordinals rank the distinct dates only, never bar-sized data.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def own_rows(key: str | Sequence[str] = "ticker", order: str = "Date"):
    keys = [key] if isinstance(key, str) else list(key)
    return Window.partitionBy(*keys).orderBy(order)


def gated(agg: Callable[[Column], Column], value: Column, n: int, window, need: int | None = None) -> Column:
    """``agg`` over the last ``n`` rows, null until ``need`` (default n) values are present."""
    frame = window.rowsBetween(-(n - 1), 0)
    enough = F.count(value).over(frame) >= (n if need is None else need)
    return F.when(enough, agg(value).over(frame))


def calendar(df: DataFrame, keys: Sequence[str] = (), on: str = "Date") -> DataFrame:
    """Distinct dates per key group with ``ord`` (1..n) and ``last_ord``.

    One row per day and group; that is the size bound behind the broadcasts of
    this table.
    """
    days = df.select(*keys, on).where(F.col(on).isNotNull()).distinct()
    by_day = Window.partitionBy(*keys).orderBy(on)
    whole = Window.partitionBy(*keys)
    return days.select(
        *keys, on,
        F.row_number().over(by_day).cast("int").alias("ord"),
        F.count(F.lit(1)).over(whole).cast("int").alias("last_ord"),
    )


def with_sessions(df: DataFrame, keys: Sequence[str] = (), on: str = "Date") -> DataFrame:
    """Attach the session ordinal of the group's own calendar to every row."""
    return df.join(F.broadcast(calendar(df, keys, on)), [*keys, on])


def decision_dates(df: DataFrame, keys: Sequence[str] = (), on: str = "Date") -> DataFrame:
    """Last date of each month per key group: ``d0``, ``month`` and the running
    decision number ``m`` (1..n)."""
    months = (df.groupBy(*keys, F.trunc(on, "month").cast("date").alias("month"))
              .agg(F.max(on).alias("d0")))
    order = Window.partitionBy(*keys).orderBy("month")
    return months.select(*keys, "month", "d0", F.row_number().over(order).cast("int").alias("m"))
