"""Operator 12: importance resampling of documents towards a target text set.

Words hash into a fixed array of buckets.  Bucket counts of the raw and the
target texts give an array of integer gains; a document's weight is the sum of
the gains of its features.  Adding Gumbel noise (from a digest of the id) to the
weights and taking the k highest draws k documents without replacement in
proportion to the exponential of their weights.

The k-th highest score is found without ordering all rows: a quantile sketch
gives a bracket around it, exact counts above and inside the bracket prove that
it holds the place sought (or it is widened), and a bracket that is still large
is bracketed again.  Only the last bracket, of at most ``SORTED`` rows, is
sorted.  Scores that tie in more rows than that are bracketed by id.

Defined cases: null and empty texts have no words and weight 0; an empty target
or an empty table counts as no features; a null doc_id hashes as an empty one
and comes last among ties; repeated rows are drawn row by row (equal rows in any
order); extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablight.llm.common import Scratch, positions, utf8

BUCKETS = 10_000
MIN_WORDS, PERCENT, SEED = 20, 10, 2024
SORTED = 1 << 16
SKETCH = 10_000
SLICE_BYTES = 4 << 20
CACHE_WORDS = 1_000_000
#: Words are runs of digits, letters a-z (after lowering A-Z) and anything outside ASCII.
_SPACED = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))
WORD_BYTES = bytes(ord(chr(b).lower()) if b < 128 else b for b in _SPACED)


class _Hashed(dict):
    """feature -> bucket, kept for the features seen last."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        found = self[feature] = zlib.crc32(feature) % self.buckets
        return found


def _features(data: bytes, ngram: int, hashed: _Hashed) -> Iterator[tuple[int, np.ndarray]]:
    """(words, buckets of the features that end in them) for each slice."""
    at, tail = 0, []
    while at < len(data):
        end = at + SLICE_BYTES
        part = data[at:end].translate(WORD_BYTES)
        while end < len(data) and part[-1] != 32:  # go on to the end of the word
            more = data[end:end + 4096].translate(WORD_BYTES)
            stop = more.find(b" ")
            part += more if stop < 0 else more[:stop + 1]
            end += len(more) if stop < 0 else stop + 1
        words = part.split()
        run = tail + words
        features = list(words)
        for k in range(2, ngram + 1):
            features += [b" ".join(run[i - k + 1:i + 1]) for i in range(max(len(tail), k - 1), len(run))]
        yield len(words), np.fromiter(map(hashed.__getitem__, features), np.int64, len(features))
        tail, at = run[len(run) - (ngram - 1):] if ngram > 1 else [], end


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, ngram: int = 1) -> np.ndarray:
    """Features of all texts by bucket: each task sends one row per bucket it
    met, summed by Spark; ``buckets`` numbers reach the driver."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, total = _Hashed(buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for data in batch.column(0):
                for _, found in _features(data.as_py(), ngram, hashed):
                    total += np.bincount(found, minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(met, pa.int64()), "n": pa.array(total[met], pa.int64())})

    partial = texts.select(utf8("text").alias("data")).mapInArrow(work, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for r in partial.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the smoothed target share over the raw share) by bucket."""
    n, s, t = len(raw), float(raw.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((b + 1.0) * (s + n) / ((a + 1.0) * (t + n))))
                     for a, b in zip(raw.tolist(), target.tolist(), strict=True)], np.int64)


def weighted(documents: DataFrame, gain: np.ndarray, ngram: int = 1) -> DataFrame:
    """doc_id, n_words, n_features, weight of every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = _Hashed(len(gain))
        for batch in batches:
            words, features, weight = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for i, data in enumerate(batch.column(1)):
                for n, found in _features(data.as_py(), ngram, hashed):
                    words[i] += n
                    features[i] += len(found)
                    weight[i] += gain[found].sum()
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (words, features, weight))],
                                             ["doc_id", "n_words", "n_features", "weight"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("data"))
    return rows.mapInArrow(work, "doc_id long, n_words long, n_features long, weight long")


def gumbel(seed: int) -> Column:
    """floor(-1000 ln(-ln u)) with u from the digest of ``seed:doc_id``."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def _bracket(rows: DataFrame, key: str, k: int, n: int) -> tuple[DataFrame, int, int, bool]:
    """Rows whose ``key`` lies in a bracket that holds the k-th smallest of n:
    (those rows, how many are below, how many inside, one value only)."""
    off = 2.0 / SKETCH
    while True:
        p = [max(0.0, k / n - off), min(1.0, k / n + off)]
        lo, hi = rows.agg(F.percentile_approx(key, p, SKETCH)).first()[0]
        below, inside = rows.agg(F.count(F.when(F.col(key) < lo, 1)),
                                 F.count(F.when(F.col(key).between(lo, hi), 1))).first()
        if below < k <= below + inside:
            return rows.where(F.col(key).between(lo, hi)), below, inside, lo == hi
        off = min(1.0, 4 * off)


def cutoff(rows: DataFrame, keys: list[str], k: int, n: int, limit: int = SORTED):
    """The k-th smallest row of n by ``keys`` (integers without nulls)."""
    at = 0
    while n > limit and at < len(keys):
        rows, below, inside, single = _bracket(rows, keys[at], k, n)
        if single:
            at += 1  # all rows left agree in this key
        elif inside == n:
            break  # the sketch can't split so few values; what is left is sorted by Spark
        k, n = k - below, inside
    return rows.orderBy(*keys).offset(k - 1).limit(1).first()


def resample(documents: DataFrame, target: DataFrame, buckets: int = BUCKETS, ngram: int = 1,
             min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank (1, 2, ... by falling score,
    then doc_id; null if not drawn) of every row: ``percent`` of the documents
    with ``min_words`` or more are drawn."""
    scratch = Scratch(documents.sparkSession)
    gain = gains(bucket_counts(documents, buckets, ngram), bucket_counts(target, buckets, ngram))
    scored = weighted(documents, gain, ngram).withColumn("score", F.col("weight") + gumbel(seed))
    scored = scratch.save(scored, "scored", keep=True)
    fit = scored.where(F.col("n_words") >= min_words).select(
        "*", (-F.col("score")).alias("down"), F.col("doc_id").isNull().cast("long").alias("no_id"),
        F.coalesce("doc_id", F.lit(0)).alias("id"))
    n = fit.count()
    k = percent * n // 100
    columns = ["doc_id", "n_features", "weight", "score"]
    if not k:
        scratch.close()
        return scored.select(*columns, F.lit(None).cast("long").alias("rank"))
    keys = ["down", "no_id", "id"]
    last = cutoff(fit.select(*keys), keys, k, n)
    chosen = F.coalesce(F.struct(*keys) <= F.struct(*[F.lit(last[c]).cast("long").alias(c) for c in keys]), F.lit(False))
    split = scored.select(
        *columns, (-F.col("score")).alias("down"), F.col("doc_id").isNull().cast("long").alias("no_id"),
        F.coalesce("doc_id", F.lit(0)).alias("id"), "n_words").withColumn(
        "chosen", chosen & (F.col("n_words") >= min_words))
    drawn = positions(split.where("chosen").select(*columns, *keys, F.lit(0).alias("all")), "all", keys, scratch, "drawn")
    rank = F.when(F.col("pos") < k, F.col("pos") + 1)  # equal rows at the cutoff may be more than k
    ranked = scratch.save(drawn.select(*columns, rank.alias("rank")), "ranked", keep=True)
    scratch.close()
    return split.where("not chosen").select(*columns, F.lit(None).cast("long").alias("rank")).unionByName(ranked)
