"""Closed-form statistics as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ripplework.functions.numeric import binomial_upper


def wilson_interval(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson interval of a rate; (0, 1) without trials."""
    p = F.try_divide(k.cast("double"), n)
    d = 1.0 + F.try_divide(F.lit(z * z), n)
    centre = (p + F.try_divide(F.lit(z * z / 2.0), n)) / d
    half = z / d * F.sqrt(F.try_divide(p * (1.0 - p), n) + F.try_divide(F.lit(z * z / 4.0), n * n))
    lo = F.when(n > 0, F.greatest(F.lit(0.0), centre - half)).otherwise(F.lit(0.0))
    hi = F.when(n > 0, F.least(F.lit(1.0), centre + half)).otherwise(F.lit(1.0))
    return lo, hi


@F.pandas_udf(DoubleType())
def _upper_bound(k: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series(binomial_upper(k.to_numpy(), n.to_numpy()))


def with_binomial_upper(rows: DataFrame, k: str, n: str, out: str) -> DataFrame:
    """One-sided 95% upper bound of a rate, computed once per distinct pair of counts."""
    pairs = rows.select(k, n).distinct().withColumn(out, _upper_bound(k, n))
    return rows.join(pairs, [k, n])
