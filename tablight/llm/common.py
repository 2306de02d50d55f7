"""Helpers shared by the text operators: shared scratch tables, tokens, table
reading."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablight.session import checkpoint_dir

#: Bits of the bitmap of hashed ids, whatever the number of ids: 16 MB.
ID_BITS = 1 << 27


def tbl(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(col: str | Column) -> Column:
    """The text as UTF-8 bytes, null as empty: Python gets bytes, no decoding."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")).cast("binary")


def words_of(data: bytes) -> list[bytes]:
    """Words are maximal runs of anything but space, tab, LF, VT, FF and CR:
    ``bytes.split()`` cuts at exactly these six, and ``bytes.lower()`` lowers
    exactly A-Z."""
    return data.lower().split()


def crc32_mod(col: str, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod`` (null id: null)."""
    return F.pmod(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(mod))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit mixing hash, elementwise."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def unit_id(sequence: int) -> int:
    """A number for one unit of work of this task: partition and running
    number.  Only used for rows that are written once and then read back, so
    a retried task can't change what later steps see."""
    ctx = TaskContext.get()
    return ((ctx.partitionId() if ctx else 0) << 32) | sequence


class Scratch:
    """Intermediate tables in the shared checkpoint folder.

    ``save`` writes a frame as Parquet and returns it as read back: lineage
    ends there and any executor can read it again after a loss.  ``close``
    removes everything but the tables saved with ``keep=True``.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{checkpoint_dir(spark).rstrip('/')}/tablight-{uuid.uuid4().hex}"
        self._tables: list[str] = []

    def save(self, df: DataFrame, name: str, keep: bool = False, bucket: tuple[int, str] | None = None) -> DataFrame:
        path = f"{self.root}/{'kept' if keep else 'tmp'}/{name}"
        writer = df.write.option("compression", "zstd")
        if bucket is None:
            writer.parquet(path)
            return self.spark.read.schema(df.schema).parquet(path)
        table = f"tablight_{uuid.uuid4().hex}"
        writer.option("path", path).bucketBy(bucket[0], bucket[1]).saveAsTable(table, format="parquet")
        self._tables.append(table)
        return self.spark.table(table)

    def drop(self, name: str) -> None:
        self._delete(f"{self.root}/tmp/{name}")

    def close(self) -> None:
        for t in self._tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {t}")
        self._delete(f"{self.root}/tmp")

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def prefix_sums(df: DataFrame, key: list[str], bucket: str, order: list[Column], value: str, out: str,
                scratch: Scratch, name: str) -> DataFrame:
    """Exclusive running sum of ``value`` per ``key``, in order of ``bucket``
    and, within it, ``order``.

    Two levels: sums per (key, bucket) are small and get their own running
    sum; rows are only ordered inside their (key, bucket).  A key that holds a
    third of all rows is spread over all its buckets.  Null keys are kept as
    one key.
    """
    from pyspark.sql import Window

    sums = df.groupBy(*key, bucket).agg(F.sum(value).alias("_s"))
    w = Window.partitionBy(*key).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    base = scratch.save(sums.select(*key, bucket, F.coalesce(F.sum("_s").over(w), F.lit(0)).alias("_base")), name)
    inner = Window.partitionBy(*key, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = df.withColumn("_in", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    cond = [local[k].eqNullSafe(base[k]) for k in [*key, bucket]]
    joined = local.join(base, cond, "inner")
    return joined.select(*[local[c] for c in df.columns], (F.col("_in") + F.col("_base")).alias(out))


def positions(df: DataFrame, group: str, order: list[str], scratch: Scratch, name: str, out: str = "pos",
              total: str = "n") -> DataFrame:
    """0-based position of every row in its ``group`` (null is a group), rows
    in the order of ``order`` with nulls first, and the group's size.

    Rows are dealt out by ranges of (group, order) and written once; a range
    holds each group in one run, so a row's position is its place in that run
    plus the rows of the group in earlier ranges, a sum over a table of one row
    per range and group.  Equal rows are told apart by a running number, so a
    group or a key of any size is spread over many ranges.
    """
    from pyspark.sql import Window

    spark = df.sparkSession
    keyed = scratch.save(df.withColumn("_tie", F.monotonically_increasing_id()), f"{name}-rows")
    dealt = keyed.repartitionByRange(shuffle_width(spark), group, *order, "_tie").sortWithinPartitions(
        group, *order, "_tie")
    placed = scratch.save(dealt.select(*df.columns, F.monotonically_increasing_id().alias("_seq")), f"{name}-placed")
    placed = placed.withColumn("_range", F.shiftright("_seq", 33))
    runs = placed.groupBy(group, "_range").agg(F.count("*").alias("_n"), F.min("_seq").alias("_first"))
    earlier = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    runs = scratch.save(runs.select(F.col(group).alias("_g"), F.col("_range").alias("_r"), "_first",
                                    F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"),
                                    F.sum("_n").over(Window.partitionBy(group)).alias("_total")), f"{name}-runs")
    found = placed.join(runs, (placed["_range"] == runs["_r"]) & placed[group].eqNullSafe(runs["_g"]))
    return found.select(*[placed[c] for c in df.columns], (F.col("_base") + F.col("_seq") - F.col("_first")).alias(out),
                        F.col("_total").alias(total))


def _bitmap(ids: DataFrame) -> np.ndarray:
    """ID_BITS bits; those that hashed ids (column ``doc_id``) fall on are set.
    At most 2^14 rows of 1 KB reach the driver."""
    width = 8192

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(width, np.uint8)
        bits[pdf["bit"].to_numpy()] = 1
        return pd.DataFrame({"part": [int(pdf["part"].iloc[0])], "bits": [np.packbits(bits).tobytes()]})

    h = F.pmod(F.xxhash64("doc_id"), F.lit(ID_BITS))
    found = ids.select(F.floor(h / width).alias("part"), (h % width).alias("bit")).distinct()
    out = np.zeros(ID_BITS // 8, np.uint8)
    for r in found.groupBy("part").applyInPandas(pack, "part long, bits binary").toLocalIterator():
        out[r["part"] * (width // 8):(r["part"] + 1) * (width // 8)] = np.frombuffer(r["bits"], np.uint8)
    return out


def split_by_ids(rows: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose doc_id is surely not among ``ids``, rows that may be).

    A bitmap of fixed size goes to every task, so the first part never moves;
    only the second needs a join with the ids.  With very many ids the bitmap
    fills up and more rows take the join: slower, not wrong.  Null ids are in
    the first part."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(_bitmap(ids))

    @F.pandas_udf("boolean")
    def met(hashed: pd.Series) -> pd.Series:
        h = hashed.to_numpy(np.int64)
        return pd.Series((sent.value[h >> 3] >> (7 - (h & 7)).astype(np.uint8)) & 1 == 1)

    maybe = met(F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(ID_BITS)), F.lit(0)))
    flagged = F.col("doc_id").isNotNull() & maybe
    return rows.where(~flagged), rows.where(flagged)

