"""Values at given positions of an order, without ordering the rows.

Each group's values are cut into cells at the points of a quantile sketch: one
cell for every point itself, one for what lies between two of them.  An exact
count of the cells tells in which one a position falls, whatever the sketch's
error.  A cell of a single value is the answer; the rows of the other cells
sought are all that is looked at again, each cell as a group of its own, until
a cell is small enough (``DIRECT`` rows) to be ordered; a task orders as many
cells as ``TASK_ROWS`` rows make, however many there are in all.  A value that holds a large share of a group is a sketch point, so it is counted
and never ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablight.session import cut_lineage

#: Sketch points of a group, and the sketch's accuracy.
GRID = [i / 32 for i in range(33)]
ACCURACY = 10_000
#: Rows of a cell that are put in order by one window.
DIRECT = 1 << 18
#: Rows that one task puts in order, on the average.
TASK_ROWS = 1 << 20
#: Rows of a table of groups that may go to the driver and be broadcast.
SMALL = 1 << 13


def small_or_cut(df: DataFrame, limit: int = SMALL) -> tuple[DataFrame, bool]:
    """The table as a literal if it has at most ``limit`` rows (then it may be
    broadcast), else written to the checkpoint folder."""
    rows = df.limit(limit + 1).collect()
    if len(rows) <= limit:
        return df.sparkSession.createDataFrame(rows, df.schema), True
    return cut_lineage(df), False


def _hint(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def _sized(rows: DataFrame, groups: list[str]) -> tuple[DataFrame, bool]:
    return small_or_cut(rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("n")))


def kth(rows: DataFrame, groups: list[str], value: str, wanted: dict[str, Column] | None = None,
        targets: DataFrame | None = None, direct: int | None = None, depth: int = 0,
        known: tuple[DataFrame, bool] | None = None) -> DataFrame:
    """(groups, t, v, below, equal): for each wanted 0-based position of each
    group the value there, and how many rows of the group are smaller and equal.

    ``wanted`` maps names to positions as columns over ``n``, the group's
    size; ``targets`` is a table (groups, t, k) instead.  ``known`` are the
    sizes of the groups (groups, n), if at hand, and whether they are few.
    Groups and values are not null."""
    direct = DIRECT if direct is None else direct
    sizes, small = known or _sized(rows, groups)
    if targets is None:
        targets = sizes.select(*groups, F.inline(F.array(*[
            F.struct(F.lit(t).alias("t"), k.cast("long").alias("k")) for t, k in wanted.items()])))
    fits = F.col("n") <= direct
    largest, ordered = sizes.agg(F.max("n"), F.sum(F.when(fits, F.col("n")))).first()
    if (largest or 0) <= direct:
        return _ordered(rows, groups, value, targets, ordered or 0)
    big = sizes.where(F.col("n") > direct).select(*groups)
    rows_big = rows.join(_hint(big, small), groups, "left_semi")
    out = None
    if ordered:
        low = sizes.where(fits).select(*groups)
        out = _ordered(rows.join(_hint(low, small), groups, "left_semi"), groups, value,
                       targets.join(_hint(low, small), groups, "left_semi"), ordered)
    found = _refined(rows_big, groups, value, targets.join(_hint(big, small), groups, "left_semi"), direct, depth)
    return found if out is None else out.unionByName(found)


def _refined(rows: DataFrame, groups: list[str], value: str, targets: DataFrame, direct: int, depth: int) -> DataFrame:
    points = F.array_distinct(F.percentile_approx(value, GRID, ACCURACY)).alias("_points")
    points, small = small_or_cut(rows.groupBy(*groups).agg(points))
    name = f"_cell{depth}"
    v = F.col(value)
    celled = rows.join(_hint(points, small), groups).withColumn("_upto", F.lit(0))
    # how many points are not above the value, by halving: a few comparisons a value
    step = 1 << (len(GRID).bit_length() - 1)
    while step:
        more = F.get("_points", F.col("_upto") + F.lit(step - 1)) <= v
        celled = celled.withColumn("_upto", F.col("_upto") + F.when(more, step).otherwise(0))
        step //= 2
    met = F.coalesce(F.get("_points", F.col("_upto") - 1) == v, F.lit(False))
    celled = celled.withColumn(name, F.col("_upto") * 2 + (~met).cast("int")).drop("_points", "_upto")
    cells = celled.groupBy(*groups, name).agg(F.count(F.lit(1)).alias("_n"), F.min(value).alias("_lo"),
                                              F.max(value).alias("_hi"))
    earlier = Window.partitionBy(*groups).orderBy(name).rowsBetween(Window.unboundedPreceding, -1)
    cells, small = small_or_cut(cells.withColumn("_below", F.coalesce(F.sum("_n").over(earlier), F.lit(0))))
    hits = targets.join(cells, groups).where(
        (F.col("_below") <= F.col("k")) & (F.col("k") < F.col("_below") + F.col("_n")))
    hits, small = small_or_cut(hits)
    single = F.col("_lo") == F.col("_hi")
    done = hits.where(single).select(*groups, "t", F.col("_lo").alias("v"), F.col("_below").alias("below"),
                                     F.col("_n").alias("equal"))
    rest = hits.where(~single)
    if rest.isEmpty():
        return done
    deeper = [*groups, name]
    # a cell's extremes bound it, so its rows are found without the points
    ends = rest.select(*deeper, "_lo", "_hi", F.col("_n").alias("n")).distinct()
    inner = rows.join(_hint(ends.drop("n"), small), groups).where(v.between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")
    inside = rest.select(*deeper, "t", (F.col("k") - F.col("_below")).alias("k"))
    found = kth(inner, deeper, value, targets=inside, direct=direct, depth=depth + 1, known=(ends.drop("_lo", "_hi"), small))
    found = found.join(_hint(rest.select(*deeper, "t", "_below"), small), [*deeper, "t"])
    return done.unionByName(found.select(*groups, "t", "v", (F.col("below") + F.col("_below")).alias("below"), "equal"))


def _ordered(rows: DataFrame, groups: list[str], value: str, targets: DataFrame, total: int) -> DataFrame:
    """Whole groups, ordered by as many tasks as ``total`` rows ask for."""
    rows = rows.select(*groups, value)
    if total > TASK_ROWS:
        # a fixed number, as tasks are otherwise merged by their compressed bytes
        tasks = max(-(-total // TASK_ROWS), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        rows, targets = rows.repartition(tasks, *groups), targets.repartition(tasks, *groups)
    v, order = F.col(value), Window.partitionBy(*groups).orderBy(value)
    if isinstance(rows.schema[value].dataType, (T.DoubleType, T.FloatType)):
        v = v + F.lit(0).cast(rows.schema[value].dataType)  # one zero
    # the rows themselves: a table of value counts beside their order would take several times their memory
    placed = rows.select(*groups, v.alias("v"), (F.row_number().over(order) - 1).cast("long").alias("_at"),
                         (F.rank().over(order) - 1).cast("long").alias("below"),
                         F.count(F.lit(1)).over(order.rangeBetween(0, 0)).alias("equal"))
    asked = targets.groupBy(*groups).agg(F.collect_list(F.struct("t", "k")).alias("_asked"))
    met = asked.join(placed, groups).where(F.array_contains(F.col("_asked.k"), F.col("_at")))
    return met.select(*groups, "v", "below", "equal", "_at", F.inline("_asked")).where(F.col("k") == F.col("_at")).select(
        *groups, "t", "v", "below", "equal")


def quantiles(rows: DataFrame, groups: list[str], value: str, probs: dict[str, float],
              direct: int | None = None, known: tuple[DataFrame, bool] | None = None) -> DataFrame:
    """Exact quantiles of each group with linear interpolation: groups and one
    double column per name.  Nulls and NaN are left out.  ``known`` as in ``kth``."""
    one = [] if groups else ["_all"]
    rows = rows.select(*[F.col(g) for g in groups], *[F.lit(0).alias(c) for c in one], F.col(value).cast("double").alias("_v"))
    rows = rows.where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    for g in groups:
        rows = rows.where(F.col(g).isNotNull())
    n = F.col("n")
    wanted, parts = {}, {}
    for name, p in probs.items():
        at = F.lit(p) * (n - 1)
        wanted |= {f"{name} lo": F.floor(at), f"{name} hi": F.ceil(at)}
        parts |= {f"{name} lo": F.ceil(at) - at, f"{name} hi": at - F.floor(at)}
    known = known or _sized(rows, [*groups, *one])
    found = kth(rows, [*groups, *one], "_v", wanted, direct=direct, known=known)
    size = _hint(*known)
    pick = lambda t: F.max(F.when(F.col("t") == t, F.col("v")))
    cols = [pick(t).alias(t) for t in wanted]
    wide = found.groupBy(*groups, *one).agg(*cols).join(size, [*groups, *one])
    out = []
    for name, p in probs.items():
        lo, hi, at = F.col(f"`{name} lo`"), F.col(f"`{name} hi`"), F.lit(p) * (n - 1)
        out.append((lo + (at - F.floor(at)) * (hi - lo)).alias(name))
    return wide.select(*groups, *out)


def row_at(rows: DataFrame, groups: list[str], keys: list[str], wanted: Column, direct: int | None = None) -> DataFrame:
    """(groups, keys): the keys of the row at position ``wanted`` (a column over
    ``n``) of each group in the order of ``keys`` (not null): first the value of
    the first key there, then, among the rows that share it, the next one.
    Text keys are compared by their bytes, seven at a time."""
    known = rows
    target, spent = None, []
    for key in keys:
        for part, stop in _parts(rows, key):
            frame = known.withColumn("_p", part)
            found = kth(frame, groups, "_p", {"at": wanted} if target is None else None, target, direct)
            found, small = small_or_cut(found)
            left = F.col("k") - F.col("below")
            if target is None:
                k = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("n")).select(*groups, wanted.cast("long").alias("k"))
            else:
                k = target.drop("t")
            known = frame.join(_hint(found.select(*groups, F.col("v").alias("_at")), small), groups).where(
                F.col("_p") == F.col("_at")).drop("_p", "_at")
            target, _ = small_or_cut(found.join(k, groups).select(*groups, F.lit("at").alias("t"), left.cast("long").alias("k")))
            if stop is not None and known.groupBy(*groups).agg(F.min(key).alias("a"), F.max(key).alias("b")).where(
                    F.col("a") != F.col("b")).isEmpty():
                break
        spent.append(key)
    return known.groupBy(*groups).agg(*[F.first(k).alias(k) for k in spent])


def _parts(rows: DataFrame, key: str):
    """The key as numbers to be compared one after the other, and whether the
    rows may agree in the key before all of them are."""
    if not isinstance(rows.schema[key].dataType, T.StringType):
        yield F.col(key), None
        return
    longest = rows.agg(F.max(F.octet_length(key))).first()[0] or 0
    for i in range(-(-longest // 7) + 1):
        if 7 * i >= longest:
            yield F.octet_length(key).cast("long"), None
        else:
            seven = F.hex(F.substring(F.col(key).cast("binary"), 7 * i + 1, 7))
            yield F.conv(F.rpad(seven, 14, "0"), 16, 10).cast("long"), True
