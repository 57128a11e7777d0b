"""Output shaping for registered queries: types and rounding only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tidy(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Round doubles, widen integers, so both engines report the same values."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(name)
        if kind in ("double", "float"):
            c = F.round(c.cast("double"), special.get(name, digits)) + F.lit(0.0)
        elif kind in ("int", "smallint", "tinyint"):
            c = c.cast("bigint")
        out.append(c.alias(name))
    return df.select(*out)
