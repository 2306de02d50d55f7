"""Relational basics (R1-R12): sort, page, project, missing-data filters,
fills, distinct counts, top-k and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablight.functions.missing import without_nan
from tablight.functions.ordering import row_index
from tablight.operators.profile import is_numeric_type


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def sort_rows(df: DataFrame, by: str, desc: bool = False, key: str | None = None,
              as_text: bool = False) -> DataFrame:
    """Sort by one column, nulls and NaN last both ways, ties by ``key``;
    ``as_text`` compares the text form (mixed-type fallback)."""
    c = _q(by).cast("string") if as_text else _q(by)
    if isinstance(df.schema[by].dataType, (T.FloatType, T.DoubleType)):
        c = F.when(~F.isnan(_q(by)), c)
    order = [c.desc_nulls_last() if desc else c.asc_nulls_last()]
    if key:
        order.append(_q(key).asc())
    return df.orderBy(*order)


def sort_positions(df: DataFrame, by: str, key: str, desc: bool = False, as_text: bool = False) -> DataFrame:
    """R1/R2 as a table: every row with its 0-based ``position`` in the order of
    ``sort_rows``, found without a global window.  Descending order takes numbers."""
    text = as_text or not isinstance(df.schema[by].dataType, T.NumericType)
    if desc and text:
        raise ValueError("descending positions need a numeric column")
    c = _q(by).cast("string") if as_text else _q(by)
    if isinstance(df.schema[by].dataType, (T.FloatType, T.DoubleType)):
        c = F.when(~F.isnan(_q(by)), c)
    filler = df.select(c.alias("c")).schema["c"].dataType
    zero = F.lit(0).cast(filler) if not text else F.lit("").cast(filler) if as_text else c
    keyed = df.withColumns({"_last": F.when(c.isNull(), 2).otherwise(1),
                            "_by": F.coalesce(-c if desc else c, zero)})
    got = row_index(keyed, [], ["_last", "_by", key], out="position")
    return got.drop("_last", "_by", "_n")


def page(df: DataFrame, by: str, page_no: int = 1, size: int = 50, desc: bool = False,
         key: str | None = None, max_size: int = 500) -> DataFrame:
    """One page of the sorted table (page >= 1, 1 <= size <= 500).
    The engine only keeps ``page_no * size`` rows per task (TakeOrdered)."""
    page_no = max(1, int(page_no))
    size = max(1, min(int(size), max_size))
    return sort_rows(df, by, desc, key).offset((page_no - 1) * size).limit(size)


def page_info(df: DataFrame, size: int = 50, max_size: int = 500) -> DataFrame:
    """R3 totals: total rows and pages (at least one page)."""
    size = max(1, min(int(size), max_size))
    return df.agg(F.count(F.lit(1)).alias("total_rows")).withColumn(
        "total_pages", F.greatest(F.lit(1), F.ceil(F.col("total_rows") / F.lit(size))).cast("long"))


def keep_metrics(df: DataFrame, metrics: list[str]) -> DataFrame:
    """Every non-numeric column plus the chosen numeric ones."""
    keep = [f.name for f in df.schema.fields
            if not is_numeric_type(f.dataType) or f.name in set(metrics)]
    return df.select(*[_q(c) for c in keep])


def drop_missing(df: DataFrame, how: str = "any", subset: list[str] | None = None) -> DataFrame:
    """Drop rows with any / all nulls (optionally in a subset)."""
    return df.dropna(how=how, subset=subset)


def drop_sparse_columns(df: DataFrame, max_null_ratio: float = 0.5) -> DataFrame:
    """Drop columns whose null (or NaN) share exceeds the threshold (one aggregate)."""
    known = without_nan(df)
    row = known.agg(F.count(F.lit(1)).alias("_n"),
                    *[F.count(_q(c)).alias(f"c{i}") for i, c in enumerate(df.columns)]).collect()[0]
    n = row["_n"] or 0
    keep = [c for i, c in enumerate(df.columns)
            if n == 0 or (n - row[f"c{i}"]) / n <= max_null_ratio]
    return df.select(*[_q(c) for c in keep])


def fill_display(df: DataFrame, number: float = 0, text: str = "N/A") -> DataFrame:
    """Nulls and NaN become 0 in numeric columns, nulls ``"N/A"`` in text columns."""
    df, exprs = without_nan(df), []
    for f in df.schema.fields:
        c = _q(f.name)
        if is_numeric_type(f.dataType):
            exprs.append(F.coalesce(c, F.lit(number).cast(f.dataType)).alias(f.name))
        elif isinstance(f.dataType, T.StringType):
            exprs.append(F.coalesce(c, F.lit(text)).alias(f.name))
        else:
            exprs.append(c)  # dates, booleans, nested values keep their type
    return df.select(*exprs)


def finite(df: DataFrame) -> DataFrame:
    """NaN and +-Inf become null in floating columns."""
    exprs = []
    for f in df.schema.fields:
        c = _q(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            bad = F.isnan(c) | (c == F.lit(float("inf"))) | (c == F.lit(float("-inf")))
            exprs.append(F.when(bad, F.lit(None).cast(f.dataType)).otherwise(c).alias(f.name))
        else:
            exprs.append(c)
    return df.select(*exprs)


def nunique(df: DataFrame, approx: bool = False, rsd: float = 0.01) -> DataFrame:
    """Non-null distinct count per column, long format (column, nunique).

    Exact counts go through one long value table (one shuffle for all
    columns, not one per column); ``approx`` uses HyperLogLog++ in a single
    pass with no shuffle of rows."""
    spark, df = df.sparkSession, without_nan(df)
    if approx:
        row = df.agg(*[F.approx_count_distinct(_q(c), rsd).alias(f"c{i}")
                       for i, c in enumerate(df.columns)]).collect()[0]
        return spark.createDataFrame([(c, i, int(row[f"c{i}"])) for i, c in enumerate(df.columns)],
                                     "column string, position int, nunique long").drop("position")
    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("position"), _q(c).cast("string").alias("v"))
        for i, c in enumerate(df.columns)]))).where(F.col("v").isNotNull())
    counts = long.groupBy("position", "v").agg(F.count(F.lit(1)).alias("_c")) \
        .groupBy("position").agg(F.count(F.lit(1)).alias("nunique"))
    names = spark.createDataFrame([(i, c) for i, c in enumerate(df.columns)],
                                  "position int, column string")
    return (names.join(counts, "position", "left")
            .select("column", F.coalesce("nunique", F.lit(0)).cast("long").alias("nunique")))


def distinct_counts(df: DataFrame, cols: list[str], blank_as_null: bool = False) -> dict[str, int]:
    """Distinct non-null values per column as a dict (one row per column
    reaches the driver).  One long value table and one shuffle for all
    columns, instead of an aggregate with several DISTINCTs, which would
    copy every row once per column."""
    if not cols:
        return {}
    df = without_nan(df.select(*[_q(c) for c in dict.fromkeys(cols)]))

    def val(c):
        v = _q(c).cast("string")
        return F.nullif(F.trim(v), F.lit("")) if blank_as_null else v
    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("position"), val(c).alias("v")) for i, c in enumerate(cols)])))
    res = (long.where(F.col("v").isNotNull()).groupBy("position", "v").agg(F.count(F.lit(1)).alias("_c"))
           .groupBy("position").agg(F.count(F.lit(1)).alias("n")).collect())
    got = {r["position"]: int(r["n"]) for r in res}
    return {c: got.get(i, 0) for i, c in enumerate(cols)}


def non_binary(prof: DataFrame) -> DataFrame:
    """Profile rows of columns with more than two distinct values."""
    return prof.where(F.col("nunique") > 2)


def top_k(df: DataFrame, by: str, k: int, key: str, bottom: bool = False) -> DataFrame:
    """K largest (or smallest) rows, ties by ``key``."""
    c = _q(by)
    if isinstance(df.schema[by].dataType, (T.DoubleType, T.FloatType)):
        df = df.where(~F.isnan(c))
    return df.where(c.isNotNull()).orderBy(c.asc() if bottom else c.desc(), _q(key).asc()).limit(k)


def retain(df: DataFrame, ts: str, ttl_hours: float = 24.0, keep: int = 15,
           by: list[str] | None = None, key: str | None = None) -> DataFrame:
    """Drop rows older than ``ttl`` before the newest timestamp (per key
    group when ``by`` is given), then keep the newest ``keep`` rows per group.

    The newest rows of a group hold its newest timestamp, so they are taken first
    (a salted top-k: a group of a third of all rows is spread over many tasks)
    and only they are compared with it; no row is joined.  Rows older than any
    group may keep are ruled out in the scan.  Null timestamps and keys are
    dropped.  Without keys the newest rows come from a TakeOrdered top-k.
    """
    from tablight.functions.ordering import top_k_per_group
    by = by or []
    tie = [_q(key).desc()] if key else []
    span = F.expr(f"INTERVAL {int(ttl_hours * 3600)} SECONDS")
    dated = df.where(_q(ts).isNotNull())
    for b in by:
        dated = dated.where(_q(b).isNotNull())
    newest = dated.groupBy(*[_q(b) for b in by]).agg(F.max(_q(ts)).alias("_mx"))
    oldest = newest.agg(F.min("_mx").alias("_mx")).first()["_mx"]
    if oldest is None:
        return dated.limit(0)
    fresh = dated.where(_q(ts) >= F.lit(oldest).cast(df.schema[ts].dataType) - span)
    if not by:
        return fresh.orderBy(_q(ts).desc(), *tie).limit(keep)
    salt = [key] if key else [c for c in df.columns if c not in by]
    top = top_k_per_group(fresh, by, [_q(ts).desc(), *tie], keep, salt)
    mx = F.max(_q(ts)).over(Window.partitionBy(*[_q(b) for b in by]))
    return top.withColumn("_mx", mx).where(_q(ts) >= F.col("_mx") - span).drop("_mx", "_k")
