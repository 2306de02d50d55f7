"""Column profiling.

``profile(df)`` makes a few narrow passes over the whole table:

* one wide aggregate (null, boolean-looking and date-parsable counts, sums,
  extremes), no shuffle of rows;
* distinct values and the largest count per column, from a table of hashed
  keys (12 bytes a cell, whatever the texts' length);
* exact quartiles by selection (``functions.selection``), which orders no rows;
* one more wide aggregate for central moments and outliers.

``profile_state`` is the form for tables of any size: one pass, no shuffle,
sketches per column that can be stored and merged (``merge_states``), read by
``profile_of_state`` and used by ``profile(approx=True)``.

A profile has one row per input column and is tiny, so every rule on it (type,
identifier, dominance, ...) is a ``CASE`` expression over it.
"""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablight.functions import keywords as K
from tablight.functions.missing import without_nan
from tablight.functions.ordering import top_k_per_group
from tablight.functions.selection import quantiles
from tablight.functions.text import compact_col, contains_any, ends_any, starts_any

PROFILE_SCHEMA = T.StructType([
    T.StructField("column", T.StringType()),
    T.StructField("position", T.IntegerType()),
    T.StructField("dtype", T.StringType()),
    T.StructField("is_numeric", T.BooleanType()),
    T.StructField("is_integer", T.BooleanType()),
    T.StructField("is_temporal", T.BooleanType()),
    T.StructField("is_text", T.BooleanType()),
    T.StructField("n_rows", T.LongType()),
    T.StructField("non_null", T.LongType()),
    T.StructField("nunique", T.LongType()),
    T.StructField("top_count", T.LongType()),
    T.StructField("date_parsed", T.LongType()),
    T.StructField("bool_values", T.LongType()),
    T.StructField("mean", T.DoubleType()),
    T.StructField("min", T.DoubleType()),
    T.StructField("max", T.DoubleType()),
    T.StructField("stddev", T.DoubleType()),
    T.StructField("variance", T.DoubleType()),
    T.StructField("skewness", T.DoubleType()),
    T.StructField("kurtosis", T.DoubleType()),
    T.StructField("q1", T.DoubleType()),
    T.StructField("median", T.DoubleType()),
    T.StructField("q3", T.DoubleType()),
    T.StructField("outlier_count", T.LongType()),
])

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
            T.DecimalType)
_INTEGER = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)


def is_numeric_type(dt: T.DataType) -> bool:
    return isinstance(dt, _NUMERIC)


def is_temporal_type(dt: T.DataType) -> bool:
    return isinstance(dt, _TEMPORAL)


# Only text shaped like a date is handed to the (costly) parsers.
_DATE_SHAPE = ("^\\d{4}([-/]\\d{1,2}([-/]\\d{1,2})?)?([ T].*)?$"
               "|^\\d{1,2}[/.]\\d{1,2}[/.]\\d{4}( .*)?$")


def parse_timestamp(c: Column) -> Column:
    """Text -> timestamp: ISO cast first, then the fixed format list."""
    s = F.trim(c.cast("string"))
    parsed = F.coalesce(F.try_to_timestamp(s),
                        *[F.try_to_timestamp(s, F.lit(fmt)) for fmt in K.DATE_FORMATS])
    return F.when(s.rlike(_DATE_SHAPE), parsed)


def _as_text(c: Column, dt: T.DataType) -> Column:
    return c if isinstance(dt, T.StringType) else c.cast("string")


def _key(c: Column, dt: T.DataType) -> tuple[Column, Column]:
    """96 bits that tell a column's values apart: whole numbers are their own
    key, anything else is hashed twice."""
    if isinstance(dt, (*_INTEGER, T.BooleanType)):
        return c.cast("long"), F.lit(0)
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        c = c.cast("double") + 0.0  # one zero
    elif not isinstance(dt, (T.DecimalType, *_TEMPORAL)):
        c = _as_text(c, dt)
    return F.xxhash64(c), F.hash(c)


def _counts_exprs(i: int, c: Column, dt: T.DataType) -> list[Column]:
    """What a value says of its column by itself: n, bool-like, date, sum, extremes."""
    zero = F.lit(0).cast("long")
    out = [F.count(c).alias(f"nn{i}")]
    if isinstance(dt, T.BooleanType):
        return out + [F.count(c).alias(f"bv{i}")]
    if is_numeric_type(dt):
        d = c.cast("double")
        return out + [F.count_if(d.isin(0.0, 1.0)).alias(f"bv{i}"), F.sum(d).alias(f"s{i}"), F.min(d).alias(f"min{i}"),
                      F.max(d).alias(f"max{i}")]
    if isinstance(dt, T.StringType):
        return out + [F.count_if(c.isin(*K.BOOLEAN_TEXT)).alias(f"bv{i}"),
                      F.count(parse_timestamp(c)).alias(f"dp{i}")]
    return out + [F.coalesce(F.max(zero), zero).alias(f"bv{i}")]


#: Cells (a value of a row) that one task counts by their keys at once.
CELLS = 1 << 22


def _turns(df: DataFrame, columns: int, n: int) -> tuple[int, int]:
    """(columns counted together, slices of their keys counted apart) that leave
    no task of ``df``, a table of ``n`` rows, more than ``CELLS`` cells."""
    if n * columns <= CELLS:
        return columns, 1
    most = df.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    return max(1, min(columns, CELLS // most)), -(-most // CELLS)


def _distinct(df: DataFrame, fields: list[T.StructField], n: int) -> dict[int, tuple[int, int]]:
    """{position: (distinct values, rows of the most frequent one)}.  What a task
    keeps follows its cells, not only its bytes, so many cells are counted in turns."""
    entries = []
    for i, f in enumerate(fields):
        c = F.col(f"`{f.name}`")
        one, two = _key(c, f.dataType)
        entries.append(F.struct(F.lit(i).alias("pos"), F.when(c.isNotNull(), one).alias("k1"), two.alias("k2")))
    width, slices = _turns(df, len(entries), n)
    counted = []
    for i in range(0, len(entries), width):
        cells = df.select(F.inline(F.array(*entries[i:i + width]))).where(F.col("k1").isNotNull())
        for s in range(slices):
            part = cells if slices == 1 else cells.where(F.pmod(F.xxhash64("k1", "k2"), F.lit(slices)) == s)
            counts = part.groupBy("pos", "k1", "k2").agg(F.count(F.lit(1)).alias("cnt"))
            counted.append(counts.groupBy("pos").agg(F.count(F.lit(1)).alias("n"), F.max("cnt").alias("top")))
    out = {}
    for r in reduce(DataFrame.unionAll, counted).collect():
        nunique, top = out.get(r["pos"], (0, 0))
        out[r["pos"]] = nunique + int(r["n"]), max(top, int(r["top"]))
    return out


def _quartiles(df: DataFrame, fields: list[T.StructField], pos: list[int]) -> dict[int, tuple]:
    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("pos"), F.col(f"`{fields[i].name}`").cast("double").alias("v")) for i in pos])))
    found = quantiles(long, ["pos"], "v", {"q1": .25, "q2": .5, "q3": .75}).collect()
    return {r["pos"]: (r["q1"], r["q2"], r["q3"]) for r in found}


def profile_raw(df: DataFrame, approx: bool = False) -> DataFrame:
    """Raw per-column statistics (``PROFILE_SCHEMA``), one row per column.  NaN is
    a missing value."""
    from tablight.functions.partitioning import spread
    if approx:
        return _raw_of_state(profile_state(df))
    spark, fields = df.sparkSession, list(df.schema.fields)
    wide_input = spread(df)
    # an input of few splits was dealt out anew: it is small, and kept for the passes
    kept = wide_input is not df
    base = without_nan(wide_input)
    if kept:
        base = base.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        cols = [F.col(f"`{f.name}`") for f in fields]
        first = base.agg(F.count(F.lit(1)).alias("n"), *[
            e for i, f in enumerate(fields) for e in _counts_exprs(i, cols[i], f.dataType)]).first().asDict()
        num_pos = [i for i, f in enumerate(fields) if is_numeric_type(f.dataType) and first[f"nn{i}"]]
        card = _distinct(base, fields, int(first["n"]))
        quart = _quartiles(base, fields, num_pos) if num_pos else {}
        aggs = []
        for i in num_pos:
            d, q = cols[i].cast("double"), quart[i]
            away = d - F.lit(first[f"s{i}"] / first[f"nn{i}"])
            lo, hi = q[0] - 1.5 * (q[2] - q[0]), q[2] + 1.5 * (q[2] - q[0])
            aggs += [F.sum(away * away).alias(f"m2{i}"), F.sum(away * away * away).alias(f"m3{i}"),
                     F.sum(away * away * away * away).alias(f"m4{i}"),
                     F.count_if((d < F.lit(lo)) | (d > F.lit(hi))).alias(f"o{i}")]
        second = base.agg(*aggs).first().asDict() if aggs else {}
    finally:
        if kept:
            base.unpersist()
    rows = []
    for i, f in enumerate(fields):
        nn, q = int(first[f"nn{i}"]), quart.get(i, (None, None, None))
        mean = var = skew = kurt = outliers = None
        if i in quart:
            mean, m2 = first[f"s{i}"] / nn, second[f"m2{i}"]
            var = m2 / (nn - 1) if nn > 1 else None
            skew = (second[f"m3{i}"] / nn) / (m2 / nn) ** 1.5 if m2 > 0 else None
            kurt = (second[f"m4{i}"] / nn) / (m2 / nn) ** 2 - 3 if m2 > 0 else None
            outliers = int(second[f"o{i}"])
        nunique, top = card.get(i, (0, 0))
        rows.append((f.name, i, f.dataType.simpleString(), is_numeric_type(f.dataType), isinstance(f.dataType, _INTEGER),
                     is_temporal_type(f.dataType), isinstance(f.dataType, T.StringType), int(first["n"]), nn, nunique, top,
                     int(first.get(f"dp{i}") or 0), int(first[f"bv{i}"] or 0), mean, first.get(f"min{i}"),
                     first.get(f"max{i}"), var ** 0.5 if var is not None else None, var, skew, kurt, *q, outliers))
    return spark.createDataFrame(rows, PROFILE_SCHEMA)


# --------------------------------------------------------------------------
# P1 as a state that can be stored and merged
# --------------------------------------------------------------------------

#: Registers of the distinct-value sketch (2^14: 0.8 % standard error), items that
#: the sketch of frequent values follows, and values of the quantile sketch.
HLL_BITS, TOP_ITEMS, KLL_SIZE = 14, 1_000, 800


def profile_state(df: DataFrame) -> DataFrame:
    """One row per column: exact counts, sums and extremes, central moments, and
    sketches of the distinct, the frequent and (numbers) the ordered values.
    One pass; what leaves a task is a few sketches, no values but the frequent
    ones (as 64-bit hashes)."""
    df = without_nan(df)
    fields, spark = list(df.schema.fields), df.sparkSession
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, f in enumerate(fields):
        c = F.col(f"`{f.name}`")
        one, _ = _key(c, f.dataType)
        key = F.when(c.isNotNull(), one)
        aggs += _counts_exprs(i, c, f.dataType) + [
            F.hll_sketch_agg(key, HLL_BITS).alias(f"hll{i}"),
            F.call_function("approx_top_k_accumulate", key, F.lit(TOP_ITEMS)).alias(f"top{i}")]
        if is_numeric_type(f.dataType):
            d = c.cast("double")
            aggs += [F.var_pop(d).alias(f"var{i}"), F.skewness(d).alias(f"sk{i}"), F.kurtosis(d).alias(f"ku{i}"),
                     F.kll_sketch_agg_double(d, F.lit(KLL_SIZE)).alias(f"kll{i}")]
    none = F.lit(None).cast("double")
    entries = []
    for i, f in enumerate(fields):
        num = is_numeric_type(f.dataType)
        n, var = F.col(f"nn{i}").cast("double"), F.col(f"var{i}") if num else none
        flat = F.coalesce(var, F.lit(0.0)) == 0
        m3 = F.when(flat, 0.0).otherwise(F.col(f"sk{i}") * n * F.pow(var, 1.5)) if num else none
        m4 = F.when(flat, 0.0).otherwise((F.col(f"ku{i}") + 3) * n * var * var) if num else none
        entries.append(F.struct(
            F.lit(f.name).alias("column"), F.lit(i).alias("position"), F.lit(f.dataType.simpleString()).alias("dtype"),
            F.lit(num).alias("is_numeric"), F.lit(isinstance(f.dataType, _INTEGER)).alias("is_integer"),
            F.lit(is_temporal_type(f.dataType)).alias("is_temporal"),
            F.lit(isinstance(f.dataType, T.StringType)).alias("is_text"), F.col("n").alias("n_rows"),
            F.col(f"nn{i}").alias("non_null"),
            (F.col(f"dp{i}") if isinstance(f.dataType, T.StringType) else F.lit(0).cast("long")).alias("date_parsed"),
            F.col(f"bv{i}").alias("bool_values"), (F.col(f"s{i}") if num else none).alias("total"),
            (F.col(f"min{i}") if num else none).alias("min"), (F.col(f"max{i}") if num else none).alias("max"),
            (var * n).alias("m2"), m3.alias("m3"), m4.alias("m4"), F.col(f"hll{i}").alias("distinct_sketch"),
            F.col(f"top{i}").alias("top_sketch"),
            (F.col(f"kll{i}") if num else F.lit(None).cast("binary")).alias("order_sketch")))
    state = df.agg(*aggs).select(F.inline(F.array(*entries))) if fields else None
    return state if state is not None else spark.createDataFrame([], "column string")


def merge_states(states: DataFrame) -> DataFrame:
    """The state of all tables (of one schema) whose states are given: counts and
    extremes add up, moments are shifted to the common mean, sketches merge."""
    keys = ["column", "position", "dtype", "is_numeric", "is_integer", "is_temporal", "is_text"]
    means = states.groupBy(*keys).agg((F.sum("total") / F.sum("non_null")).alias("_mean"))
    s = states.join(means, keys)
    n = F.col("non_null").cast("double")
    d = F.when(n > 0, F.col("total") / n - F.col("_mean"))
    m2, m3, m4 = F.col("m2"), F.col("m3"), F.col("m4")
    return s.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in ("n_rows", "non_null", "date_parsed", "bool_values", "total")],
        F.min("min").alias("min"), F.max("max").alias("max"), F.sum(m2 + n * d * d).alias("m2"),
        F.sum(m3 + 3 * d * m2 + n * d * d * d).alias("m3"),
        F.sum(m4 + 4 * d * m3 + 6 * d * d * m2 + n * d * d * d * d).alias("m4"),
        F.hll_union_agg("distinct_sketch").alias("distinct_sketch"),
        F.call_function("approx_top_k_combine", F.col("top_sketch")).alias("top_sketch"),
        F.kll_merge_agg_double("order_sketch").alias("order_sketch"))


def _raw_of_state(state: DataFrame) -> DataFrame:
    n, m2 = F.col("non_null"), F.col("m2")
    num = F.col("is_numeric") & (n > 0)
    points = F.when(num, F.kll_sketch_get_quantile_double("order_sketch", F.array(*[F.lit(k / 512) for k in range(513)])))
    state = state.withColumn("_points", points)
    at = lambda p: F.get("_points", F.lit(int(512 * p)))
    rank = lambda v: F.size(F.filter("_points", lambda x: x <= v)) / F.lit(513.0)
    top = F.call_function("approx_top_k_estimate", F.col("top_sketch"), F.lit(1))
    out = state.withColumns({"q1": at(.25), "median": at(.5), "q3": at(.75), "_top": top})
    iqr = F.col("q3") - F.col("q1")
    # a fence outside the values leaves nothing beyond it
    lo, hi = F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr
    beyond = F.when(lo > F.col("min"), rank(lo)).otherwise(0.0) + F.when(hi < F.col("max"), 1 - rank(hi)).otherwise(0.0)
    var = F.when(num & (n > 1), m2 / (n - 1))
    mom = lambda m, p: F.when(num & (m2 > 0), (F.col(m) / n) / F.pow(m2 / n, p))
    cols = {"nunique": F.least(F.hll_sketch_estimate("distinct_sketch"), n),
            "top_count": F.coalesce(F.get("_top", F.lit(0))["count"], F.lit(0)),
            "mean": F.when(num, F.col("total") / n), "stddev": F.sqrt(var), "variance": var,
            "skewness": mom("m3", 1.5), "kurtosis": mom("m4", 2.0) - 3,
            "outlier_count": F.when(num, F.round(beyond * n)).cast("long")}
    out = out.withColumns(cols)
    return out.select(*[F.col(f.name).cast(f.dataType) for f in PROFILE_SCHEMA])


def profile_of_state(state: DataFrame) -> DataFrame:
    """The profile of a (merged) state: exact but for distinct counts, quartiles,
    outliers and the top share, which the sketches estimate."""
    return with_rules(_raw_of_state(state))


def identifier_expr(name: Column, unique_ratio: Column, non_numeric: Column,
                    n_rows: Column) -> Column:
    """P9 as an ordered CASE over the column name and its uniqueness."""
    compact = compact_col(name)
    return (F.when(starts_any(compact, K.ID_AFFIXES) | ends_any(compact, K.ID_AFFIXES), True)
            .when(contains_any(compact, K.ENTITY_NAME_TOKENS), False)
            .when(non_numeric & (unique_ratio > 0.95) & (n_rows > 50), True)
            .when(contains_any(compact, K.LABEL_NAME_TOKENS) & (unique_ratio > 0.8), True)
            .otherwise(False))


def with_rules(raw: DataFrame) -> DataFrame:
    """Derived profile columns (P2-P7, P9, P10) as CASE expressions."""
    c = F.col
    unique_ratio = F.when(c("n_rows") > 0, c("nunique") / c("n_rows")).otherwise(F.lit(0.0))
    pandas_numeric = c("is_numeric") | (c("dtype") == "boolean")
    bool_like = (c("nunique") <= 2) & (c("bool_values") == c("non_null"))
    text_dates = c("is_text") & (c("non_null") > 0) & (c("date_parsed") / c("non_null") > 0.5)
    typ = (F.when(c("is_temporal") | text_dates, "datetime")
           .when(bool_like, "boolean")
           .when(c("is_numeric") & c("is_integer") & (c("nunique") <= 15), "discrete_numeric")
           .when(c("is_numeric"), "continuous_numeric")
           .otherwise("categorical"))
    iqr = c("q3") - c("q1")
    ident = identifier_expr(c("column"), unique_ratio, ~pandas_numeric, c("n_rows"))
    metric_safe = F.when(contains_any(compact_col(c("column")), K.METRIC_SAFE_TOKENS), False) \
        .otherwise(ident)
    return (raw
            .withColumn("missing_ratio", F.round(
                F.when(c("n_rows") > 0, 1 - c("non_null") / c("n_rows")).otherwise(0.0), 4))
            .withColumn("unique_ratio", unique_ratio)
            .withColumn("type", typ)
            .withColumn("iqr", iqr)
            .withColumn("outlier_ratio", F.when(c("n_rows") > 0, c("outlier_count") / c("n_rows")))
            .withColumn("top_share", F.when(c("non_null") > 0, c("top_count") / c("non_null")))
            .withColumn("dominant_flag", (c("type") == "categorical") & (c("top_share") > 0.8))
            .withColumn("is_identifier", ident)
            .withColumn("is_identifier_metric_safe", metric_safe))


def profile(df: DataFrame, approx: bool = False) -> DataFrame:
    """One row per column with type, counts, moments, quartiles and flags.

    ``approx=True`` reads everything off one pass of sketches
    (``profile_state``): no shuffle of values at all, and distinct counts,
    quartiles, outliers and the top share are estimates.
    """
    return with_rules(profile_raw(df, approx=approx))


# --------------------------------------------------------------------------
# P8 column cards
# --------------------------------------------------------------------------

def column_cards(df: DataFrame, max_cols: int | None = None, prof: DataFrame | None = None) -> DataFrame:
    """Compact per-column summary of all columns, or the first ``max_cols``.

    Numeric columns carry min/max/mean/median; others the top-3 values with
    counts (text cut to 80).  ``sample_values`` are the 3 smallest values (a
    deterministic stand-in for "first three rows").
    """
    cols = df.columns[:max_cols]
    sub = df.select(*[F.col(f"`{c}`") for c in cols])
    prof = prof if prof is not None else profile(sub)
    entries = []
    for f in without_nan(sub).schema.fields:
        c = F.col(f"`{f.name}`")
        one, two = _key(c, f.dataType)
        num = c.cast("double") if is_numeric_type(f.dataType) else F.lit(None).cast("double")
        entries.append(F.struct(F.lit(f.name).alias("column"), F.when(c.isNotNull(), one).alias("k1"), two.alias("k2"),
                                F.substring(_as_text(c, f.dataType), 1, 80).alias("v"), num.alias("d")))
    # values are told apart by hash; what is shown of one (80 characters) goes along once
    vc = without_nan(sub).select(F.inline(F.array(*entries))).where(F.col("k1").isNotNull()).groupBy(
        "column", "k1", "k2").agg(F.count(F.lit(1)).alias("cnt"), F.min("v").alias("v"), F.min("d").alias("d"))
    top = (top_k_per_group(vc, ["column"], [F.col("cnt").desc(), F.col("v"), F.col("k1"), F.col("k2")], 3, ["k1", "k2"])
           .groupBy("column").agg(F.sort_array(F.collect_list(F.struct(
               (-F.col("cnt")).alias("o"), F.col("v").alias("k"),
               F.col("v").alias("value"), F.col("cnt").alias("count")))).alias("t"))
           .select("column", F.transform("t", lambda x: F.struct(x["value"].alias("value"),
                                                                  x["count"].alias("count")))
                   .alias("top_values")))
    samples = (top_k_per_group(vc, ["column"], [F.col("d").asc_nulls_last(), F.col("v"), F.col("k1"), F.col("k2")], 3,
                               ["k1", "k2"])
               .groupBy("column").agg(F.sort_array(F.collect_list(F.struct(
                   F.col("d"), F.col("v")))).alias("s"))
               .select("column", F.transform("s", lambda x: x["v"])
                       .alias("sample_values")))
    hints = F.array_compact(F.array(*[
        F.when(contains_any(F.regexp_replace(F.lower("column"), "[_\\-]+", " "), kws),
               F.lit(dom)) for dom, kws in K.HINT_KEYWORDS.items()]))
    return (prof.select("column", "position", "dtype", "missing_ratio",
                        F.col("nunique").alias("unique_count"), "is_numeric",
                        F.when(c_num(), F.col("min")).alias("num_min"),
                        F.when(c_num(), F.col("max")).alias("num_max"),
                        F.when(c_num(), F.col("mean")).alias("num_mean"),
                        F.when(c_num(), F.col("median")).alias("num_median"))
            .join(top, "column", "left").join(samples, "column", "left")
            .withColumn("top_values", F.when(~F.col("is_numeric"), F.col("top_values")))
            .withColumn("possible_semantic_hints", hints)
            .orderBy("position"))


def c_num() -> Column:
    return F.col("is_numeric")


# --------------------------------------------------------------------------
# P11 label column, P12 central columns
# --------------------------------------------------------------------------

def label_candidates(prof: DataFrame) -> DataFrame:
    """P11 scores: usable non-numeric, non-ID-suffix columns with a keyword
    score (100 - keyword index) and distinct count.  ``non_blank`` must be
    supplied by the caller's profile (non-null count is used as proxy)."""
    name = F.regexp_replace(F.lower("column"), "[_\\- ]", "")
    score = F.greatest(F.lit(0), *[F.when(name.contains(kw), F.lit(100 - i))
                                   for i, kw in enumerate(K.LABEL_KEYWORDS)])
    usable = ((F.col("dtype") != "boolean") & ~F.col("is_numeric")
              & ~(name.isin(*K.ID_AFFIXES) | ends_any(name, K.ID_AFFIXES))
              & (F.col("non_blank") > 0))
    return prof.where(usable).select("column", "position", score.alias("score"),
                                     F.col("nunique").alias("unique_count"))


def label_column(df: DataFrame, preferred: str | None = None,
                 exclude: list[str] | None = None) -> DataFrame:
    """The text column that best labels points (one row, or none)."""
    exclude = set(exclude or [])
    text_cols = [f.name for f in df.schema.fields
                 if not is_numeric_type(f.dataType) and not isinstance(f.dataType, T.BooleanType)
                 and f.name not in exclude]
    spark = df.sparkSession
    if not text_cols:
        return spark.createDataFrame([], "column string, score int, unique_count bigint")
    sub = df.select(*[F.col(f"`{c}`") for c in text_cols])
    nb = sub.agg(*[F.count(F.when(F.trim(F.col(f"`{c}`").cast("string")) != "", 1)).alias(f"b{i}")
                   for i, c in enumerate(text_cols)]).collect()[0]
    prof = profile_raw(sub).withColumn(
        "non_blank", F.element_at(F.array(*[F.lit(nb[f"b{i}"]) for i in range(len(text_cols))]),
                                  F.col("position") + 1))
    cands = label_candidates(prof)
    if preferred and preferred in text_cols:
        pref = cands.where(F.col("column") == preferred)
        if pref.take(1):
            return pref.select("column", "score", "unique_count")
    return (cands.orderBy(F.col("score").desc(), F.col("unique_count").desc(), F.col("position"))
            .limit(1).select("column", "score", "unique_count"))


def central_columns(df: DataFrame, cols: list[str], top_n: int = 4) -> DataFrame:
    """Columns with the highest mean |Spearman r| to the others.

    The lowest-variance quarter is dropped first (unless that leaves fewer
    than ``top_n``); correlations use all complete rows, not a sample.
    """
    from tablight.operators.stats import spearman_matrix
    spark = df.sparkSession
    if len(cols) <= top_n:
        return spark.createDataFrame([(c, i) for i, c in enumerate(cols)],
                                     "column string, rank int")
    var = df.agg(*[F.var_samp(F.col(f"`{c}`").cast("double")).alias(f"v{i}")
                   for i, c in enumerate(cols)]).collect()[0]
    vs = [(c, var[f"v{i}"]) for i, c in enumerate(cols)]
    finite = sorted(v for _, v in vs if v is not None)
    if finite:
        import numpy as np
        cut = float(np.quantile(np.array(finite), 0.25))
        active = [c for c, v in vs if v is not None and v > cut]
    else:
        active = []
    if len(active) < top_n:
        active = list(cols)
    complete = df.select(*[F.col(f"`{c}`") for c in active]).dropna()
    if not complete.take(5) or len(complete.take(5)) < 5:
        return spark.createDataFrame([(c, i + 1) for i, c in enumerate(active[:top_n])],
                                     "column string, rank int")
    m = spearman_matrix(complete, active, complete_rows=True)
    both = (m.select(F.col("col_a").alias("column"), "r")
            .unionByName(m.select(F.col("col_b").alias("column"), "r")))
    k = len(active)
    cent = both.groupBy("column").agg((F.sum(F.abs(F.coalesce("r", F.lit(0.0)))) / F.lit(k))
                                      .alias("centrality"))
    order = {c: i for i, c in enumerate(active)}
    pos = spark.createDataFrame(list(order.items()), "column string, position int")
    return (cent.join(F.broadcast(pos), "column")
            .orderBy(F.col("centrality").desc(), "position").limit(top_n)
            .select("column", "centrality"))
