import datetime as dt


def day(text: str) -> dt.date:
    return dt.date.fromisoformat(text)


def days(n: int, start: str = "2020-01-01") -> list[dt.date]:
    return [day(start) + dt.timedelta(days=i) for i in range(n)]


def bars(spark, rows):
    """rows: (ticker, Date, Close) with the other prices equal to the close."""
    full = [(t, d, c, c, c, c, 1000.0) for t, d, c in rows]
    return spark.createDataFrame(full, "ticker STRING, Date DATE, Open DOUBLE, High DOUBLE, Low DOUBLE, Close DOUBLE, Volume DOUBLE")


def as_dict(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}
