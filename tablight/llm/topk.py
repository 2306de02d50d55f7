"""Operator 6: exact top-k search by multi-resolution segment statistics.

Score: inner product of integer vectors, so the largest scores are the nearest
neighbours once lengths are known.  A vector is cut into segments; for each,
``m * mean_q * mean_v + m * std_q * std_v`` bounds the inner product from above
(Cauchy-Schwarz on the deviations), which is the lower bound on the distance.
The bounds are inner products of the statistics themselves, so a whole block is
bounded with one small matrix product.  Per pair of blocks the search goes
coarse to fine: bounds on few long segments pick promising candidates, whose
exact scores set the threshold; candidates under it go; the next finer segments
thin the rest out again; survivors get exact scores.

Vectors are packed into blocks (one row each) as they are read, without a
shuffle.  Query blocks meet all candidate blocks, each pair in one task;
thresholds are kept from one pair to the next within a task, and at most k rows
per query and pair leave it.

Defined cases: vectors that are null, empty, or hold null or non-finite
components take no part, nor do null ids; components are whole numbers below
2^53, and a score that may pass 64 bits raises; only vectors of equal length are
compared; ties go to the smaller id; repeated candidate rows count separately,
while a query id that is repeated is asked once (its smallest vector);
candidates that share the query's id are its own; fewer than k candidates: all;
empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVELS = (1, 4, 16)
QUERY_BLOCK = 512
SCHEMA = "block long, dim int, n int, ids binary, vectors binary"


def usable(vec: str) -> Column:
    ok = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(F.col(vec).isNotNull() & (F.size(vec) > 0) & ok, F.lit(False))


def quantised(vec: str, scale: int = 64) -> Column:
    return F.transform(vec, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def _blocks(vectors: DataFrame, size: int) -> DataFrame:
    """Packs (id, v) rows into blocks of one dimension, as they come."""
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dim, part in pdf.groupby(pdf["v"].str.len()):
                for at in range(0, len(part), size):
                    p = part.iloc[at:at + size]
                    m = np.stack(p["v"].to_numpy()).astype(np.float64)
                    ids = p["id"].to_numpy(np.int64)
                    yield pd.DataFrame({"block": [int(ids[0])], "dim": [int(dim)], "n": [len(p)],
                                        "ids": [ids.tobytes()], "vectors": [m.tobytes()]})

    return vectors.mapInPandas(pack, SCHEMA)


def segment_stats(m: np.ndarray, segments: int) -> np.ndarray:
    """Per vector, sqrt(length) times mean and deviation of each segment: the
    inner product of two such rows is an upper bound on that of the vectors."""
    parts = np.array_split(np.arange(m.shape[1]), min(segments, m.shape[1]))
    out = [f for idx in parts for f in (m[:, idx].mean(1) * np.sqrt(len(idx)), m[:, idx].std(1) * np.sqrt(len(idx)))]
    return np.stack(out, axis=1)


def scores(c: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers held as doubles: in doubles where
    no sum can pass 2^53, else in 64-bit integers."""
    if len(c) == 0:
        return np.zeros(0, np.int64)
    most = float(np.abs(c).max()) * float(np.abs(q).max()) * c.shape[1]
    if most < 2.0 ** 53:
        return (c @ q).astype(np.int64)
    if most >= 2.0 ** 63:
        raise OverflowError("a score may pass 64 bits")
    return (c.astype(np.int64) * q.astype(np.int64)).sum(axis=1)


def _best(ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best, ties to the smaller id."""
    if len(ids) > 4 * k:
        cut = np.partition(score, -k)[-k]
        keep = np.flatnonzero(score >= cut)
    else:
        keep = np.arange(len(ids))
    return keep[np.lexsort((ids[keep], -score[keep]))[:k]]


def search_blocks(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int,
                  floor: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For every query, candidates of this block that can be among its k best.
    ``floor`` holds each query's k-th best score so far and is raised."""
    slack = 1e-9
    q_stats = [segment_stats(q, s) for s in LEVELS]
    c_stats = [segment_stats(c, s) for s in LEVELS]
    coarse = q_stats[1] @ c_stats[1].T
    single = q_stats[0] @ c_stats[0].T
    probe = min(4 * k, len(cid))
    for i in range(len(qid)):
        own = cid == qid[i]
        bound = np.minimum(single[i], coarse[i])
        bound = np.where(own, -np.inf, bound + slack * np.abs(bound) + slack)
        first = np.argpartition(-bound, probe - 1)[:probe]
        first = first[~own[first]]
        exact = scores(c[first], q[i])
        if len(first) >= k:
            floor[i] = max(floor[i], np.partition(exact, -k)[-k])
        alive = np.flatnonzero(bound >= floor[i])
        for stats_q, stats_c in zip(q_stats[2:], c_stats[2:], strict=True):
            finer = stats_c[alive] @ stats_q[i]
            alive = alive[finer + slack * np.abs(finer) + slack >= floor[i]]
        alive = alive[~own[alive]]
        score = scores(c[alive], q[i])
        top = _best(cid[alive], score, k)
        if len(top):
            if len(top) == k:
                floor[i] = max(floor[i], score[top[-1]])
            yield i, alive[top], score[top]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "v",
          groups: int | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score.  Both frames hold ids and arrays
    of whole numbers."""
    spark = vectors.sparkSession
    if groups is None:
        groups = max(1, spark.sparkContext.defaultParallelism)
    cand = _blocks(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")), 4096)
    asked = queries.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(vec_col).alias("v"))
    ask = _blocks(asked, QUERY_BLOCK)
    # every query block is sent to each group of candidate blocks; (group, dim) is an equi-join
    cand = cand.withColumn("g", F.pmod(F.xxhash64("block", "ids"), F.lit(groups)))
    ask = ask.select(F.col("block").alias("qb"), "dim", F.col("n").alias("qn"), F.col("ids").alias("qids"),
                     F.col("vectors").alias("qv"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"))
    ask = ask.withColumn("g", F.col("g").cast("long"))
    pairs = ask.join(cand, ["g", "dim"])

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        floors: dict[tuple[int, int], np.ndarray] = {}
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                qid = np.frombuffer(r.qids, np.int64)
                q = np.frombuffer(r.qv, np.float64).reshape(r.qn, r.dim)
                cid = np.frombuffer(r.ids, np.int64)
                c = np.frombuffer(r.vectors, np.float64).reshape(r.n, r.dim)
                floor = floors.setdefault((r.qb, r.dim), np.full(r.qn, -np.inf))
                out = [(qid[i], cid[at], s) for i, at, s in search_blocks(qid, q, cid, c, k, floor)]
                if out:
                    yield pd.DataFrame({"query_id": np.repeat([x[0] for x in out], [len(x[1]) for x in out]),
                                        "vec_id": np.concatenate([x[1] for x in out]),
                                        "score": np.concatenate([x[2] for x in out])})

    found = pairs.mapInPandas(search, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return (found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
