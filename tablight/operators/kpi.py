"""KPI selection and values (K1-K8).

Rules run as ``CASE``/``rlike`` expressions over the profile (one row per
column); values are one aggregate over the data, unpivoted to long format.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablight.functions import keywords as K
from tablight.functions.missing import number
from tablight.functions.selection import row_at
from tablight.functions.text import contains_any, starts_any
from tablight.operators.profile import is_numeric_type, profile


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def meaningless_total(name: Column) -> Column:
    """Duration/lag-like names whose total means nothing."""
    return contains_any(F.regexp_replace(F.lower(name), "_", " "), K.MEANINGLESS_TOTAL)


def domain_priority(name: Column) -> Column:
    """K2: -1 for error/fault-like prefixes, 1 when a name token starts with a
    business keyword, else 0.  Tokens start at the beginning and after any
    character that is not a letter a-z."""
    low = F.lower(name)
    compact = F.regexp_replace(low, "[_ ]", "")
    kw = "|".join(re.escape(k) for k in K.DOMAIN_PRIORITY)
    token_start = low.rlike(f"(^|[^a-z])({kw})")
    return (F.when(starts_any(compact, K.NEGATIVE_PREFIXES), -1)
            .when(token_start, 1).otherwise(0))


def is_mean_aggregated(name: Column) -> Column:
    return contains_any(F.lower(name), K.MEAN_AGGREGATED)


def kpi_candidates(prof: DataFrame) -> DataFrame:
    """K1: eligible metric columns (profile rows) with their priority.
    Falls back to every non-identifier numeric column when none pass."""
    numeric = prof.where(F.col("is_numeric")).withColumn("priority", domain_priority(F.col("column")))
    strict = numeric.where(~meaningless_total(F.col("column")) & ~F.col("is_identifier")
                           & (F.col("priority") >= 0) & (F.col("nunique") > 2))
    if strict.take(1):
        return strict
    return numeric.where(~F.col("is_identifier"))


def shortlist(df: DataFrame, n: int = 4, prof: DataFrame | None = None) -> DataFrame:
    """K3: up to 4 priority metrics, the rest filled by centrality."""
    from tablight.operators.profile import central_columns
    prof = prof if prof is not None else profile(df)
    cands = kpi_candidates(prof).select("column", "position", "priority").collect()  # <= #columns
    ordered = sorted(cands, key=lambda r: (-r["priority"], r["position"]))
    top = [r["column"] for r in ordered if r["priority"] >= 1][:n]
    rest = [r["column"] for r in ordered if r["column"] not in top]
    if len(top) < n and rest:
        extra = [r["column"] for r in central_columns(df, rest, n - len(top)).collect()]
        top += extra
    spark = df.sparkSession
    return spark.createDataFrame([(c, i + 1) for i, c in enumerate(top)], "column string, slot int")


def kpi_values(df: DataFrame, cols: list[str]) -> DataFrame:
    """K4: mean for rate/score-like names, else sum; one aggregate, long out:
    (column, aggregation, value, title).  All-null columns are skipped."""
    spark = df.sparkSession
    if not cols:
        return spark.createDataFrame([], "column string, aggregation string, value double, title string")
    aggs = []
    for i, c in enumerate(cols):
        mean = any(k in c.lower() for k in K.MEAN_AGGREGATED)
        v = number(_q(c))
        aggs += [(F.avg(v) if mean else F.sum(v)).alias(f"v{i}"), F.count(v).alias(f"n{i}")]
    wide = df.agg(*aggs)
    long = wide.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("slot"), F.lit(c).alias("column"),
                 F.lit("mean" if any(k in c.lower() for k in K.MEAN_AGGREGATED) else "sum").alias("aggregation"),
                 F.coalesce(F.col(f"v{i}"), F.lit(0.0)).alias("value"), F.col(f"n{i}").alias("n"))
        for i, c in enumerate(cols)])))
    title = F.concat(F.when(F.col("aggregation") == "mean", "Avg ").otherwise("Total "),
                     F.initcap(F.regexp_replace("column", "_", " ")))
    return (long.where(F.col("n") > 0).withColumn("title", title)
            .select("column", "aggregation", "value", "title"))


def kpi_trend(df: DataFrame, date: str, cols: list[str], key: str) -> DataFrame:
    """K5: half-period trend per metric.  Non-missing values ordered by date
    (null dates last, ties by ``key``, which is unique within a date); mean of
    the first n//2 vs the rest; pct = (b - a) / |a| * 100; up > 1, down < -1;
    needs >= 4 values.

    Only the row in the middle is looked for (``functions.selection``): its date
    and key split each metric's rows, and one aggregate does the rest."""
    stamp = F.unix_micros(_q(date).cast("timestamp"))
    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.coalesce(stamp, F.lit(2**63 - 1)).alias("_d"),
                 _q(key).alias("_k"), number(_q(c)).alias("_v")) for c in cols])))
    long = long.where(F.col("_v").isNotNull())
    # null keys come first; numbers keep their order, anything else is compared as text
    numeric = is_numeric_type(df.schema[key].dataType)
    long = long.withColumn("_none", F.when(F.col("_k").isNull(), 0).otherwise(1)).withColumn(
        "_k", F.coalesce("_k", F.lit(0)) if numeric else F.coalesce(F.col("_k").cast("string"), F.lit("")))
    middle = row_at(long, ["column"], ["_d", "_none", "_k"], F.floor(F.col("n") / 2))
    middle = df.sparkSession.createDataFrame(middle.collect(), middle.schema)  # one row per metric
    own, mid = F.struct("_d", "_none", "_k"), F.struct(*[F.col(f"mid{c}").alias(c) for c in ("_d", "_none", "_k")])
    joined = long.join(F.broadcast(middle.withColumnsRenamed({c: f"mid{c}" for c in ("_d", "_none", "_k")})), "column")
    t = joined.groupBy("column").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.when(own < mid, F.col("_v"))).alias("first_half_mean"),
        F.avg(F.when(own >= mid, F.col("_v"))).alias("second_half_mean"))
    a, b = F.col("first_half_mean"), F.col("second_half_mean")
    pct = F.when((F.col("n") >= 4) & (a != 0), (b - a) / F.abs(a) * 100)
    return (t.withColumn("pct_change", pct)
            .withColumn("direction", F.when(F.col("pct_change") > 1, "up")
                        .when(F.col("pct_change") < -1, "down").otherwise("neutral")))


def plan_kpis(df: DataFrame, defs: DataFrame, k: int = 4) -> DataFrame:
    """K6: KPIs from a metric-definition table (column, aggregation, role,
    validation_status, ord).  Rejected definitions and identifier / dimension
    roles are skipped; primary metrics first, then secondary; duplicates
    dropped; at most 4.  The aggregation is taken from accepted/repaired
    definitions when it is one of mean/sum/count/min/max, else by name."""
    from tablight.operators.aggregates import agg_expr, infer_agg
    numeric = [f.name for f in df.schema.fields if is_numeric_type(f.dataType)]
    role_rank = (F.when(F.col("role").isin("primary_metric", "outcome_metric"), 0)
                 .when(F.col("role").isin("secondary_metric", "driver_metric", "supporting_metric"), 1)
                 .otherwise(2))
    rows = (defs.where((F.col("validation_status") != "rejected")
                       & ~F.col("role").isin("identifier", "dimension", "time")
                       & F.col("column").isin(*numeric))
            .withColumn("_rr", role_rank).orderBy("_rr", "ord").collect())  # definition table: small
    chosen, seen = [], set()
    for r in rows:
        if r["column"] in seen:
            continue
        seen.add(r["column"])
        agg = r["aggregation"]
        if not (agg in ("mean", "sum", "count", "min", "max")
                and r["validation_status"] in ("accepted", "repaired")):
            agg = infer_agg(r["column"])
        chosen.append((r["column"], agg))
        if len(chosen) == k:
            break
    spark = df.sparkSession
    if not chosen:
        return spark.createDataFrame([], "slot int, column string, aggregation string, value double")
    wide = df.agg(*[agg_expr(number(_q(c)), a).cast("double").alias(f"v{i}") for i, (c, a) in enumerate(chosen)],
                  *[F.count(number(_q(c))).alias(f"n{i}") for i, (c, _) in enumerate(chosen)])
    return (wide.select(F.inline(F.array(*[
        F.struct(F.lit(i + 1).alias("slot"), F.lit(c).alias("column"), F.lit(a).alias("aggregation"),
                 F.col(f"v{i}").alias("value"), F.col(f"n{i}").alias("n"))
        for i, (c, a) in enumerate(chosen)]))).where(F.col("n") > 0).drop("n"))


def record_count(df: DataFrame) -> DataFrame:
    """K7: the record-count KPI used when no numeric metric exists."""
    return df.agg(F.count(F.lit(1)).alias("value")).select(
        F.lit("kpi-count").alias("id"), F.lit("Total Records").alias("title"), "value")


def kpi_columns(prof: DataFrame) -> DataFrame:
    """K8: selectable KPI columns: numeric, not identifier, not meaningless;
    label, priority, distinct count, binary flag; priority desc, then label."""
    return (prof.where(F.col("is_numeric") & ~F.col("is_identifier") & ~meaningless_total(F.col("column")))
            .select(F.col("column").alias("label"), domain_priority(F.col("column")).alias("priority"),
                    "nunique", (F.col("nunique") <= 2).alias("is_binary"))
            .orderBy(F.col("priority").desc(), "label"))
