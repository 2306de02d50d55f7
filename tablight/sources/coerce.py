"""Ingestion coercions (S4-S7): identifier columns to text, text to numbers,
text to dates, and the display preview sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablight.functions.ordering import row_index
from tablight.operators.profile import is_temporal_type, parse_timestamp


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def is_id_name(name: str) -> bool:
    """S4 rule: ``id``, ``*_id``, ``* id`` (any case) or ending in ``ID``."""
    low = name.lower()
    return low == "id" or low.endswith("_id") or low.endswith(" id") or name.endswith("ID")


def as_number(c: Column) -> Column:
    """The double a text stands for (``,`` counts as the decimal point),
    null if it is no plain number.  The pattern keeps out type suffixes such
    as ``12D``, which a cast alone would accept."""
    s = F.regexp_replace(c, ",", ".")
    plain = s.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$")
    return F.when(plain, s.try_cast("double"))


def coerce(df: DataFrame, threshold: float = 0.6) -> DataFrame:
    """S4 + S5 in one aggregate and one select.

    ID-named columns become text.  A text column becomes double when, after
    replacing ``,`` by ``.``, more than ``threshold`` of its non-null values
    parse; values that do not parse become null."""
    text = [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.StringType) and not is_id_name(f.name)]
    convert = set()
    if text:
        row = df.agg(*[F.count(as_number(_q(c))).alias(f"p{i}")
                       for i, c in enumerate(text)],
                     *[F.count(_q(c)).alias(f"n{i}") for i, c in enumerate(text)]).collect()[0]
        convert = {c for i, c in enumerate(text) if row[f"p{i}"] > row[f"n{i}"] * threshold}
    out = []
    for f in df.schema.fields:
        c = _q(f.name)
        if is_id_name(f.name):
            out.append(c.cast("string").alias(f.name))
        elif f.name in convert:
            out.append(as_number(c).alias(f.name))
        else:
            out.append(c)
    return df.select(*out)


def parse_dates(df: DataFrame, col: str, min_share: float = 0.5) -> DataFrame:
    """Replace a text column by its parsed timestamp when more than
    ``min_share`` of the non-null values parse."""
    p = parse_timestamp(_q(col))
    row = df.agg(F.count(p).alias("p"), F.count(_q(col)).alias("n")).collect()[0]
    if row["n"] and row["p"] / row["n"] > min_share:
        return df.withColumn(col, p)
    return df


def preview(df: DataFrame, key: str, n: int = 150, seed: int = 42) -> DataFrame:
    """Display sample of <= n rows.  With a date/time column: every
    (rows // n)-th row in ``key`` order, first n; otherwise n rows chosen by a
    seeded hash, shown in ``key`` order.  Nulls shown as 0 / "N/A"."""
    from tablight.operators.relational import fill_display
    total = df.count()
    if total <= n:
        out = df
    elif any(is_temporal_type(f.dataType) for f in df.schema.fields):
        step = total // n
        idx = row_index(df, [], [key])
        out = idx.where(F.col("_rn") % step == 0).orderBy(key).limit(n).drop("_rn", "_n")
    else:
        out = (df.withColumn("_h", F.xxhash64(_q(key), F.lit(seed)))
               .orderBy("_h", key).limit(n).drop("_h"))
    return fill_display(out.orderBy(key))

