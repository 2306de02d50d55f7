"""One rule for missing numbers: NaN is null, as it is in the profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def number(c: Column) -> Column:
    """As double; NaN is null (infinities stay)."""
    d = c.cast("double")
    return F.when(~F.isnan(d), d)


def without_nan(df: DataFrame) -> DataFrame:
    """NaN becomes null in every floating column."""
    cols = {f.name: F.col(f"`{f.name}`") for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.withColumns({n: F.when(~F.isnan(c), c) for n, c in cols.items()}) if cols else df
