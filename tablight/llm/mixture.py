"""Operator 3: mixing sources to target weights.

The words of each source form one stream (documents in the order of a hash)
that is packed into blocks of ``BLOCK`` words.  The output consists of shards
of ``SHARD`` slots.  Every shard draws how many of its slots each source gets;
a source's slots are numbered through over all shards, and slot k reads block
``perm(k mod blocks)`` of round ``k div blocks``, where ``perm`` is a
pseudorandom permutation of the source's block indices, another one for every
round.  Slots and blocks meet in a join on (source, block).

The draw is a residual multinomial: a source first gets the whole part of its
expected number, and the slots that are left in the shard are drawn from a
multinomial over the fractional parts.  The expectation is that of a plain
multinomial and the spread is much smaller, which keeps small sources near
their target.  A source reads at most two rounds of its blocks; slots the draw
puts beyond that stay empty, so no document is read more than twice.

Targets: weights go round over the sources in code point order (null last);
each source gets its share of ``total`` words, at most ``rounds`` times its
size, and what is above goes to the others by weight until none is above.
That fixpoint is the water level: with sources ordered by cap/weight, the
first whose remaining share per weight is below its own cap/weight sets it.

Defined cases: null source is a source of its own (last); null text has size
0; texts without words are returned with taken 0; null doc_ids and repeated
rows are documents of their own; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablight.llm.common import Scratch, mix64, prefix_sums

BLOCK = 32
SHARD = 4096
WEIGHTS = (3, 1, 2)
BUCKETS = 256
ROUNDS = 2


#: Slots that one task makes.
SLOTS_A_TASK = 1 << 18


def n_words(text: Column) -> Column:
    """Number of runs of anything but ASCII white space."""
    squeezed = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return F.when(squeezed == "", F.lit(0)).otherwise(
        F.length(squeezed) - F.length(F.replace(squeezed, F.lit(" "), F.lit(""))) + 1).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5,
            rounds: int = ROUNDS) -> DataFrame:
    """source, source_size (one row per source) -> ord, weight, target added."""
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    s = sizes.withColumn("ord", F.row_number().over(by_name) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]),
                                            (F.col("ord") % len(weights) + 1).cast("int")).cast("double"))
    cap = F.col("source_size") * rounds
    s = s.withColumn("_cap", cap.cast("double")).withColumn("_level", F.col("_cap") / F.col("weight"))
    every = Window.partitionBy(F.lit(0))
    asc = Window.partitionBy(F.lit(0)).orderBy("_level", "ord")
    total = F.sum("source_size").over(every) * share
    before = F.coalesce(F.sum("_cap").over(asc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    weight_from = F.sum("weight").over(asc.rowsBetween(0, Window.unboundedFollowing))
    s = s.withColumn("_lambda", (total - before) / weight_from)
    first = F.min(F.when(F.col("_lambda") <= F.col("_level"), F.struct("_level", "ord", "_lambda"))).over(every)
    s = s.withColumn("_water", first["_lambda"])
    return s.select("source", "source_size", "ord", "weight",
                    F.least("_cap", F.coalesce(F.col("weight") * F.col("_water"), F.col("_cap"))).alias("target"))


def permuted(k: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 for every key, elementwise: a
    four-round Feistel network on the next even number of bits, walked until
    the value lies below n."""
    bits = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))) + 1).astype(np.int64) // 2).astype(np.uint64)
    mask = (np.uint64(1) << bits) - np.uint64(1)
    x = k.astype(np.uint64)
    live = np.ones(len(x), dtype=bool)
    while live.any():
        left, right = x[live] >> bits[live], x[live] & mask[live]
        for r in range(4):
            f = mix64(right + key[live] + np.uint64(0x9E3779B97F4A7C15 * (r + 1) % 2**64)) & mask[live]
            left, right = right, left ^ f
        x[live] = (left << bits[live]) | right
        live = x >= n.astype(np.uint64)
    return x.astype(np.int64)


def mix(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, block: int = BLOCK,
        shard: int = SHARD, seed: int = 20240, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(documents, slots).

    Documents: doc_id, size, source, source_size, target, first_word (place in
    the source's stream), taken and the columns in ``keep``.  Slots: shard,
    slot, ord (source), block; slot i of a source's block b reads the words
    ``b * block`` to ``(b + 1) * block`` of its stream.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark)
    order = F.xxhash64(F.col("doc_id"), F.col("text"))
    docs = documents.select("doc_id", "source", n_words(F.col("text")).alias("size"), order.alias("_h"), *keep)
    docs = scratch.save(docs.withColumn("_bucket", F.pmod("_h", F.lit(BUCKETS))), "sizes")
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    info = scratch.save(targets(sizes, weights, share).withColumn("blocks", F.ceil(F.col("source_size") / block)),
                        "targets")
    # one row per source name
    src = info.where("source_size > 0").orderBy("ord").toPandas()
    docs = prefix_sums(docs, ["source"], "_bucket", [F.col("_h"), F.col("doc_id"), F.col("size")], "size",
                       "first_word", scratch, "streams")
    docs = docs.join(info, docs["source"].eqNullSafe(info["source"])).select(
        "doc_id", "size", docs["source"], "source_size", "target", "ord", "first_word", *keep)
    docs = scratch.save(docs, "placed", keep=True)
    slots = scratch.save(_slots(spark, src, shard, seed, scratch), "slots", keep=True)
    if len(src) == 0:
        scratch.close()
        return docs.withColumn("taken", F.lit(0).cast("long")), slots
    reads = slots.groupBy("ord", "block").agg(F.count("*").alias("times"))
    lo, hi = F.floor(F.col("first_word") / block), F.floor((F.col("first_word") + F.col("size") - 1) / block)
    pieces = docs.where("size > 0").select("ord", "first_word", "size", F.explode(F.sequence(lo, hi)).alias("block"))
    words = F.least(F.col("first_word") + F.col("size"), (F.col("block") + 1) * block) \
        - F.greatest(F.col("first_word"), F.col("block") * block)
    # the planner takes the pieces for as many rows as there are documents, and would send them all to the driver
    got = pieces.select("ord", "first_word", "block", words.alias("words")).hint("merge").join(reads, ["ord", "block"]) \
        .groupBy("ord", "first_word").agg(F.sum(F.col("words") * F.col("times")).alias("_taken"))
    # a text without words shares its place with the next one and takes nothing
    out = docs.join(got, ["ord", "first_word"], "left") \
        .withColumn("taken", F.when(F.col("size") > 0, F.coalesce("_taken", F.lit(0))).otherwise(0).cast("long")) \
        .drop("_taken")
    out = scratch.save(out, "mixed", keep=True)
    scratch.close()
    return out, slots


def _slots(spark, src: pd.DataFrame, shard: int, seed: int, scratch: Scratch) -> DataFrame:
    """shard, slot, ord, block of every filled slot."""
    schema = "shard long, slot long, ord int, block long"
    if len(src) == 0:
        return spark.createDataFrame([], schema)
    ords, blocks = src["ord"].to_numpy(np.int64), src["blocks"].to_numpy(np.int64)
    want = blocks * src["target"].to_numpy(float) / src["source_size"].to_numpy(float)
    total = int(round(want.sum()))
    shards = max(1, -(-total // shard))
    p = want / want.sum()

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for s in pdf["id"]:
                n = min(shard, total - s * shard)
                base = np.floor(n * p + 1e-9).astype(np.int64)
                left, frac = n - int(base.sum()), np.maximum(n * p - base, 0)
                if left > 0:
                    chance = frac / frac.sum() if frac.sum() > 0 else p
                    base += np.random.default_rng([seed, int(s)]).multinomial(left, chance)
                out += [(int(s), int(o), int(c)) for o, c in zip(ords, base, strict=True) if c]
            yield pd.DataFrame(out, columns=["shard", "ord", "slots"])

    drawn = spark.range(shards).mapInPandas(draw, "shard long, ord int, slots long")
    drawn = scratch.save(drawn.withColumn("_group", F.floor(F.col("shard") / 1024)), "drawn")
    numbered = prefix_sums(drawn, ["ord"], "_group", [F.col("shard")], "slots", "first", scratch, "numbers")
    inside = Window.partitionBy("shard").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    numbered = numbered.withColumn("at", F.coalesce(F.sum("slots").over(inside), F.lit(0)))
    # a few rows a shard become its slots: dealt out by their number, whatever their bytes
    numbered = numbered.repartition(max(1, -(-total // SLOTS_A_TASK)), "shard")
    each = numbered.select("shard", "ord", "at", "first",
                           F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1)).alias("k"))
    each = each.select("shard", (F.col("at") + F.col("k")).alias("slot"), "ord",
                       (F.col("first") + F.col("k")).alias("number"))
    n_of = np.zeros(int(ords.max()) + 1, dtype=np.int64)
    n_of[ords] = blocks

    @F.pandas_udf("long")
    def block_of(o: pd.Series, number: pd.Series) -> pd.Series:
        o, k = o.to_numpy(np.int64), number.to_numpy(np.int64)
        n = n_of[o]
        key = mix64((np.uint64(seed) << np.uint64(32)) + (o.astype(np.uint64) << np.uint64(8))
                    + (k // n).astype(np.uint64))
        got = permuted(k % n, n, key)
        return pd.Series(np.where(k // n < ROUNDS, got, -1))

    return each.withColumn("block", block_of("ord", "number")).where("block >= 0").select("shard", "slot", "ord", "block")
