"""Distributed ordering: running offsets, mid-ranks and exact quantiles.

A window with ``orderBy`` but no ``partitionBy`` moves every row into one task
(``Exchange SinglePartition``).  Instead we

1. draw a bounded, seeded sample of the sort key and take ``n_buckets - 1`` cut
   points from it (collected as literals, so every later use agrees on them);
2. give each row the number of cut points below it (its bucket);
3. total the weight per (partition keys, bucket) -- a table of at most
   ``#keys * n_buckets`` rows -- and turn it into running offsets;
4. run the ordered window per (partition keys, bucket) and add the offset.

Cut points only decide which task does the work; results do not depend on
where they fall.  A single hot key spans many buckets, and a value repeated
billions of times is a single row of a value-count table, so no task has to
hold a hot group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SAMPLE_PER_BUCKET = 32


_LEVEL = 256  # cut points per level of the bucket table


def default_buckets(df: DataFrame) -> int:
    """Bucket count follows the cluster's shuffle width, not the data on hand:
    4 buckets per shuffle partition, up to 256 x 256 (two-level cut table)."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "8"))
    return max(4, min(_LEVEL * _LEVEL, 4 * parts))


def _cut_points(df: DataFrame, order_cols: list[str], n_buckets: int, seed: int) -> list[tuple]:
    if n_buckets <= 1:
        return []
    dtype = df.schema[order_cols[0]].dataType
    if len(order_cols) == 1 and isinstance(dtype, (T.NumericType, T.DateType, T.TimestampType,
                                                   T.TimestampNTZType)):
        # one aggregate returns n_buckets - 1 cut points (bounded) -- one job
        probs = [i / n_buckets for i in range(1, n_buckets)]
        row = df.agg(F.percentile_approx(F.col(order_cols[0]), probs, 10_000).alias("q")).collect()[0]
        cuts = sorted(set(v for v in (row["q"] or []) if v is not None))
        return [(v,) for v in cuts]
    total = df.count()
    if total == 0:
        return []
    target = n_buckets * _SAMPLE_PER_BUCKET
    fraction = min(1.0, target / total)
    keyed = df.select(*order_cols).dropna()
    if fraction < 1.0:
        keyed = keyed.where(
            (F.abs(F.xxhash64(*[F.col(c) for c in order_cols], F.lit(seed))) % F.lit(1_000_000))
            < F.lit(int(fraction * 1_000_000) + 1)
        )
    # Bounded: about n_buckets * 32 rows reach the driver.
    sample = [tuple(r) for r in keyed.orderBy(*order_cols).collect()]
    if not sample:
        return []
    step = max(1, len(sample) // n_buckets)
    cuts = []
    for i in range(step, len(sample), step):
        if not cuts or sample[i] != cuts[-1]:
            cuts.append(sample[i])
    return cuts[: n_buckets - 1]


def _bucket_expr(df: DataFrame, order_cols: list[str], cuts: list[tuple]) -> Column:
    """Number of cut points <= the row's key, as plain comparisons so the
    whole expression stays inside whole-stage codegen."""
    if not cuts:
        return F.lit(0)
    types = {f.name: f.dataType for f in df.schema.fields}
    if len(order_cols) == 1:
        c = order_cols[0]
        row = F.col(c)
        lits = [F.lit(cut[0]).cast(types[c]) for cut in cuts]
    else:
        row = F.struct(*[F.col(c).alias(c) for c in order_cols])
        lits = [F.struct(*[F.lit(v).cast(types[c]).alias(c) for c, v in zip(order_cols, cut)])
                for cut in cuts]
    total = F.lit(0)
    for lit in lits:
        # null keys sort first: they never pass a cut
        total = total + F.when(row >= lit, 1).otherwise(0)
    return total


def _orderable_number(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType))


def _two_level_bucket(df: DataFrame, c: str, n_buckets: int) -> Column:
    """Bucket id for very large tables: 255 first-level cuts as plain
    comparisons, then up to 255 sub-cuts of the row's first-level bucket
    looked up from a literal map (one grouped ``percentile_approx``).  Both
    cut tables are bounded (<= 256 x 256 values)."""
    cuts1 = _cut_points(df, [c], _LEVEL, 42)
    b1 = _bucket_expr(df, [c], cuts1)
    per = -(-n_buckets // _LEVEL)  # buckets per first-level bucket
    if per <= 1:
        return b1
    probs = [i / per for i in range(1, per)]
    rows = (df.withColumn("_b1", b1).groupBy("_b1")
            .agg(F.percentile_approx(F.col(c), probs, 10_000).alias("q")).collect())
    dtype = df.schema[c].dataType
    entries = []
    for r in rows:
        cuts = sorted(set(v for v in (r["q"] or []) if v is not None))
        entries += [F.lit(int(r["_b1"])), F.array(*[F.lit(v).cast(dtype) for v in cuts]).cast(T.ArrayType(dtype))]
    if not entries:
        return b1 * per
    sub = F.create_map(*entries)[b1]
    b2 = F.coalesce(F.size(F.filter(sub, lambda x: x <= F.col(c))), F.lit(0))
    return b1 * per + F.when(F.col(c).isNull(), 0).otherwise(b2)


def running_offsets(df: DataFrame, part_cols: list[str], order_cols: list[str],
                    weight_col: str | None = None, n_buckets: int | None = None,
                    seed: int = 42, out: str = "_before", total: str = "_n") -> DataFrame:
    """Add ``out`` = total weight of earlier rows in the same partition (by
    ``order_cols``) and ``total`` = total weight of the partition.

    Rows whose order columns tie are ordered arbitrarily, so callers pass a
    unique order (value-count tables, or a tie key).  Null order values sort
    first.
    """
    n_buckets = n_buckets or default_buckets(df)
    w = F.col(weight_col) if weight_col else F.lit(1).cast("long")
    if n_buckets > _LEVEL and len(order_cols) == 1 and _orderable_number(df, order_cols[0]):
        keyed = df.withColumn("_bkt", _two_level_bucket(df, order_cols[0], n_buckets)).withColumn("_w", w)
    else:
        cuts = _cut_points(df, order_cols, min(n_buckets, _LEVEL), seed)
        keyed = df.withColumn("_bkt", _bucket_expr(df, order_cols, cuts)).withColumn("_w", w)
    grp = part_cols + ["_bkt"]
    totals = keyed.groupBy(*grp).agg(F.sum("_w").alias("_bt"))
    # totals holds at most (#partition keys) x n_buckets rows.
    wp = Window.partitionBy(*part_cols).orderBy("_bkt") if part_cols else Window.orderBy("_bkt")
    offsets = (
        totals.withColumn("_off", F.coalesce(
            F.sum("_bt").over(wp.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn(total, F.sum("_bt").over(
            (Window.partitionBy(*part_cols) if part_cols else Window.partitionBy())))
        .drop("_bt")
    )
    inner = Window.partitionBy(*grp).orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, -1)
    res = (
        keyed.join(offsets, on=grp, how="inner")
        .withColumn(out, F.col("_off") + F.coalesce(F.sum("_w").over(inner), F.lit(0)))
        .drop("_bkt", "_off", "_w")
    )
    return res


def value_counts(long_df: DataFrame, part_cols: list[str], value_col: str) -> DataFrame:
    """(keys, value, cnt) for non-null values; map-side partial counts first."""
    return (long_df.where(F.col(value_col).isNotNull())
            .groupBy(*part_cols, value_col).agg(F.count(F.lit(1)).alias("cnt")))


def midranks(long_df: DataFrame, part_cols: list[str], value_col: str,
             n_buckets: int | None = None) -> DataFrame:
    """Per-(keys, value) mid-rank (average rank of ties), count and group size.

    Returns keys, value, cnt, rank (1-based mid-rank), n.
    """
    vc = value_counts(long_df, part_cols, value_col)
    ranked = running_offsets(vc, part_cols, [value_col], "cnt", n_buckets)
    return ranked.withColumn(
        "rank", F.col("_before").cast("double") + (F.col("cnt") + F.lit(1)) / F.lit(2.0)
    ).withColumnRenamed("_n", "n").drop("_before")


def exact_quantiles(long_df: DataFrame, part_cols: list[str], value_col: str,
                    probs: dict[str, float], n_buckets: int | None = None) -> DataFrame:
    """Exact linear-interpolation quantiles (numpy/pandas default, DuckDB
    ``quantile_cont``) per key, from a value-count table -- no group is ever
    collected into one buffer.  Returns keys + one double column per name.
    """
    vc = value_counts(long_df, part_cols, value_col)
    return quantiles_from_counts(vc, part_cols, value_col, probs, n_buckets)


def quantiles_from_counts(vc: DataFrame, part_cols: list[str], value_col: str,
                          probs: dict[str, float], n_buckets: int | None = None,
                          count_col: str = "cnt") -> DataFrame:
    """Quantiles from an existing (keys, value, cnt) table."""
    if count_col != "cnt":
        vc = vc.withColumnRenamed(count_col, "cnt")
    ranked = running_offsets(vc, part_cols, [value_col], "cnt", n_buckets)
    v = F.col(value_col).cast("double")
    before, cnt, n = F.col("_before"), F.col("cnt"), F.col("_n")
    aggs = []
    for name, p in probs.items():
        pos = F.lit(p) * (n - 1)
        lo, hi = F.floor(pos), F.ceil(pos)
        aggs += [
            F.max(F.when((before <= lo) & (lo < before + cnt), v)).alias(f"_{name}_lo"),
            F.max(F.when((before <= hi) & (hi < before + cnt), v)).alias(f"_{name}_hi"),
            F.max(pos - lo).alias(f"_{name}_fr"),
        ]
    agg = ranked.groupBy(*part_cols).agg(*aggs)
    cols = [F.col(c) for c in part_cols]
    for name in probs:
        lo_v, hi_v, fr = F.col(f"_{name}_lo"), F.col(f"_{name}_hi"), F.col(f"_{name}_fr")
        cols.append((lo_v + fr * (hi_v - lo_v)).alias(name))
    return agg.select(*cols)


def top_k_per_group(df: DataFrame, part_cols: list[str], order_cols: list[Column],
                    k: int, salt_cols: list[str] | None = None, n_salt: int | None = None,
                    out: str = "_k") -> DataFrame:
    """Exact top-k rows per group without giving one task a whole group.

    Rows are first ranked inside (group, salt) sub-groups, where the salt is a
    hash of ``salt_cols`` (default: all columns); only k candidates per
    sub-group survive, and the final ranking runs over at most
    ``k * n_salt`` rows per group.  ``order_cols`` must give a total order.
    """
    n_salt = n_salt or default_buckets(df)
    salt_src = [F.col(c) for c in (salt_cols or df.columns)]
    salted = df.withColumn("_salt", F.abs(F.xxhash64(*salt_src)) % F.lit(n_salt))
    w1 = Window.partitionBy(*part_cols, "_salt").orderBy(*order_cols)
    cand = salted.withColumn("_k1", F.row_number().over(w1)).where(F.col("_k1") <= k)
    w2 = (Window.partitionBy(*part_cols) if part_cols else Window.partitionBy()).orderBy(*order_cols)
    return (cand.withColumn(out, F.row_number().over(w2)).where(F.col(out) <= k)
            .drop("_salt", "_k1"))


def row_index(df: DataFrame, part_cols: list[str], order_cols: list[str],
              n_buckets: int | None = None, out: str = "_rn") -> DataFrame:
    """0-based position of each row within its partition in ``order_cols`` order
    (callers include a unique tie key), plus ``_n`` = partition size.

    Without a number of buckets rows are dealt out by ranges of their keys, any
    number and kind of them (Spark samples the keys and looks ranges up by
    binary search), and written once.  A range holds each partition in one run,
    so a position is the row's place in that run plus the partition's rows in
    earlier ranges: a sum over one row per range and partition."""
    if n_buckets is not None:
        return running_offsets(df, part_cols, order_cols, None, n_buckets, out=out)
    from tablight.session import cut_lineage
    keys = [*part_cols, *order_cols]
    dealt = df.repartitionByRange(default_buckets(df), *keys).sortWithinPartitions(*keys)
    placed = cut_lineage(dealt.withColumn("_seq", F.monotonically_increasing_id())).withColumn(
        "_range", F.shiftright("_seq", 33))
    runs = placed.groupBy(*part_cols, "_range").agg(F.count(F.lit(1)).alias("_rows"), F.min("_seq").alias("_first"))
    group = Window.partitionBy(*part_cols) if part_cols else Window.partitionBy()
    earlier = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_base", F.coalesce(F.sum("_rows").over(earlier), F.lit(0))).withColumn(
        "_n", F.sum("_rows").over(group)).drop("_rows")
    theirs = {c: f"{c} of run" for c in [*part_cols, "_range"]}
    runs = runs.select(*[F.col(c).alias(t) for c, t in theirs.items()], "_base", "_first", "_n")
    cond = [F.col(f"`{c}`").eqNullSafe(F.col(f"`{t}`")) for c, t in theirs.items()]
    return placed.join(runs, cond).select(*[F.col(f"`{c}`") for c in df.columns],
                                          (F.col("_base") + F.col("_seq") - F.col("_first")).alias(out), "_n")
