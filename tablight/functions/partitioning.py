"""Input spreading for operators that fan rows out (long formats, k-means).

A scan yields one task per file split.  On a cluster reading many files this
is already wide, and the input is used as is.  When a table arrives in fewer
partitions than the cluster can run at once (a single small file, a single
row group), rows are spread round-robin first, so the explode and the
map-side aggregation after it run on every core.  Round-robin repartitioning
sorts before it distributes, so a retried task gets the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    sc = df.sparkSession.sparkContext
    want = sc.defaultParallelism
    if df.rdd.getNumPartitions() < want:
        return df.repartition(want)
    return df
