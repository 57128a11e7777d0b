"""Normal distribution as vectorised functions; used on summary rows only."""

from __future__ import annotations

from statistics import NormalDist

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_STANDARD = NormalDist()


@F.pandas_udf(DoubleType())
def normal_cdf(z: pd.Series) -> pd.Series:
    return z.map(_STANDARD.cdf, na_action="ignore").astype(float)


@F.pandas_udf(DoubleType())
def normal_quantile(p: pd.Series) -> pd.Series:
    return p.map(_STANDARD.inv_cdf, na_action="ignore").astype(float)
