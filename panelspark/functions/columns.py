"""Column-level rules: month keys, valuation formulas, predicates, bins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Distance bin edges (right-closed) and their labels.
DISTANCE_EDGES = [0.01, 0.02, 0.05, 0.10]
DISTANCE_LABELS = ["0-1 pp", "1-2 pp", "2-5 pp", "5-10 pp", ">10 pp"]

# Officer titles that count as conviction holders.
OFFICER_TITLES = ["CEO", "CFO", "COO", "PRESIDENT"]

# Intrinsic value constants.
AAA_YIELD = 4.4
BASE_MULTIPLE = 8.5
NUMBER_FACTOR = 22.5


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def month_key(c) -> Column:
    """First day of the month a date falls in."""
    return F.trunc(_col(c), "month").cast("date")


def realized_month(c) -> Column:
    """Last day of the month after the decision month."""
    return F.last_day(F.add_months(F.trunc(_col(c), "month"), 1))


def next_business_day(c) -> Column:
    day = _col(c)
    gap = F.when(F.dayofweek(day) == 6, 3).when(F.dayofweek(day) == 7, 2).otherwise(1)
    return F.date_add(day, gap)


def is_month_end(asof, today) -> Column:
    """True when the data month is complete: an earlier month than today's, or
    the last weekday of its own month."""
    a, t = _col(asof), _col(today)
    return (month_key(a) < month_key(t)) | (month_key(next_business_day(a)) != month_key(a))


def graham_iv(eps, growth, aaa: float = AAA_YIELD) -> Column:
    e, g = _col(eps), _col(growth)
    multiple = F.lit(BASE_MULTIPLE) + F.lit(200.0) * g
    return F.when((e > 0) & (multiple > 0), e * multiple * F.lit(4.4) / F.lit(float(aaa)))


def graham_number(eps, bvps) -> Column:
    e, b = _col(eps), _col(bvps)
    return F.when((e > 0) & (b > 0), F.sqrt(F.lit(NUMBER_FACTOR) * e * b))


def is_csuite(title) -> Column:
    return F.coalesce(F.upper(_col(title)).rlike("|".join(OFFICER_TITLES)), F.lit(False))


def distance_bin(c) -> Column:
    value = _col(c)
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for edge, label in zip(DISTANCE_EDGES, DISTANCE_LABELS):
        out = out.when(value <= edge, label)
    return out.otherwise(DISTANCE_LABELS[-1])


def number_from_text(c) -> Column:
    """Numeric value of text such as ``$1,234`` or ``+5%``; null if not a number."""
    return F.regexp_replace(_col(c).cast("string"), r"[$,%]", "").try_cast("double")


def padded(c, width: int = 2) -> Column:
    """Digits padded with zeros to ``width``; longer ones stay whole."""
    text = _col(c).cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def hash_unit(*parts) -> Column:
    """Reproducible value in [0, 1) from the md5 of the joined parts."""
    text = F.concat_ws("|", *[_col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 6), 16, 10).cast("double") / F.lit(16777216.0)


def correlation(a, b) -> Column:
    """Pearson correlation of the pairs without nulls; null where either side is constant."""
    x, y = F.when(_col(b).isNotNull(), _col(a)), F.when(_col(a).isNotNull(), _col(b))
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))
