"""Operator 4: near-duplicates by MinHash with banding, signature verification,
exact confirmation and connected components.

1. Every text becomes the set of its distinct five-word shingles (64-bit
   hashes) and a signature of ``HASHES`` minima under universal hash functions.
2. Texts with the same set are one node, named by their smallest doc_id; groups
   of copies never take part in any pairing.
3. Banding: nodes that agree on all ``ROWS`` minima of a band share a bucket.
4. Signature verification: within buckets, pairs whose signatures agree on too
   few places are dropped.  Of what is left only enough pairs to keep the group
   connected leave the task.  Large buckets are dealt out as pairs of blocks.
5. These candidate pairs are joined to clusters; within a cluster, pairs that
   pass the signature test are confirmed on the full sets, closest first, and
   pairs that are connected already are skipped.  Large clusters are dealt out
   as pairs of blocks as well, so no task holds a whole one.
6. Confirmed links go through large-star and small-star.

The component of a text is exact up to the misses of banding and signature
test: a pair at a similarity of exactly 0.75 is missed with a chance of about
1e-5, and it has to be the only bridge between two groups to matter.

Defined cases: null and empty texts have the empty set, are linked with nothing
and kept; texts of one to four words have one shingle, the whole sequence;
rows that share a doc_id are one document for linking; null doc_ids are linked
with nothing, have a null component and are kept; empty tables give no rows;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablight.llm.common import Scratch, mix64, shuffle_width, utf8, words_of
from tablight.llm.components import components

SHINGLE = 5
HASHES = 128
ROWS = 4
BANDS = HASHES // ROWS
#: Share of equal signature places (of 8 bits each) that a pair needs: 0.75
#: less 4.5 standard deviations.
LEAST_AGREEMENT = 0.58
BUCKET_BLOCK = 1024
CLUSTER_BLOCK = 512

_rng = np.random.default_rng(2024)
#: Multiply-add-shift hashing of 32-bit keys: odd 64-bit factors and offsets.
_A = _rng.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, HASHES, dtype=np.uint64)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(data: bytes, cache: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text."""
    words = words_of(data)
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    width = min(SHINGLE, len(h))
    n = len(h) - width + 1
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[k:k + n])
    return np.unique(out)


def signature(shingles: np.ndarray) -> np.ndarray:
    """HASHES minima (32 bits each) of a non-empty set."""
    keys = (shingles & np.uint64(0xFFFFFFFF))
    best = np.full(HASHES, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(keys), 2048):
        part = keys[at:at + 2048]
        h = ((part[None, :] * _A[:, None] + _B[:, None]) >> np.uint64(32)).astype(np.uint32)
        np.minimum(best, h.min(axis=1), out=best)
    return best


def _sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    cache = _WordHashes()
    for pdf in batches:
        n, fp, bands, sig = [], [], [], []
        for data in pdf["data"]:
            s = shingle_set(data, cache)
            n.append(len(s))
            if not len(s):
                fp.append(None), bands.append(None), sig.append(None)
                continue
            fp.append(xxhash.xxh3_128_digest(s.tobytes()))
            m = signature(s)
            bands.append([xxhash.xxh3_64_intdigest(m[i * ROWS:(i + 1) * ROWS].tobytes(), seed=i) - 2**63
                          for i in range(BANDS)])
            sig.append((m & np.uint32(255)).astype(np.uint8).tobytes())
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_shingles": n, "fp": fp, "bands": bands, "sig": sig})


class _Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        a, b = self.find(i), self.find(j)
        self.up[a] = b
        return a != b


def agreeing_pairs(sig: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of pairs (closest first) whose signatures agree enough.  With
    two sides only pairs across them count."""
    n = len(sig)
    left = np.flatnonzero(side == side.min())
    right = np.flatnonzero(side == side.max())
    pi, pj, ps = [], [], []
    step = max(1, 4_000_000 // max(1, len(right)))
    need = int(np.ceil(LEAST_AGREEMENT * HASHES))
    cols = [np.ascontiguousarray(sig[right, k]) for k in range(HASHES)]
    for at in range(0, len(left), step):
        rows = left[at:at + step]
        same = np.zeros((len(rows), len(right)), np.uint8)
        for k in range(HASHES):
            same += sig[rows, k][:, None] == cols[k][None, :]
        a, b = np.nonzero(same >= need)
        i, j = rows[a], right[b]
        keep = i < j if len(left) == n else np.ones(len(i), bool)
        pi.append(i[keep]), pj.append(j[keep]), ps.append(same[a, b][keep])
    i, j, s = np.concatenate(pi), np.concatenate(pj), np.concatenate(ps)
    order = np.argsort(-s.astype(np.int16), kind="stable")
    return i[order], j[order]


def _grouped(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Whole groups from a stream of rows sorted by ``keys``, many small groups
    at a time: every frame holds complete groups only."""
    rest = None
    for pdf in batches:
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        k = pdf[keys].to_numpy()
        last = (k == k[-1]).all(axis=1)
        cut = int(last.argmax())
        if cut:
            yield pdf.iloc[:cut].reset_index(drop=True)
        rest = pdf.iloc[cut:].reset_index(drop=True)
    if rest is not None and len(rest):
        yield rest


def _bounds(pdf: pd.DataFrame, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    k = pdf[keys].to_numpy()
    starts = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]).any(axis=1)])
    return starts, np.r_[starts[1:], len(k)]


def _bucket_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Candidate pairs of each bucket (or pair of blocks of one)."""
    keys, need = ["bucket", "i", "j"], int(np.ceil(LEAST_AGREEMENT * HASHES))
    for pdf in _grouped(batches, keys):
        starts, ends = _bounds(pdf, keys)
        sizes = ends - starts
        node = pdf["node"].to_numpy(np.int64)
        sig = np.frombuffer(b"".join(pdf["sig"]), np.uint8).reshape(-1, HASHES)
        out_a, out_b = [], []
        # small groups: all pairs, by distance within the group
        size_of = np.repeat(sizes, sizes)
        end_of = np.repeat(ends, sizes)
        small = size_of <= 8
        for gap in range(1, 8):
            a = np.flatnonzero(small & (np.arange(len(pdf)) + gap < end_of))
            if not len(a):
                break
            ok = (sig[a] == sig[a + gap]).sum(axis=1) >= need
            out_a.append(node[a[ok]]), out_b.append(node[a[ok] + gap])
        for s, e in zip(starts[sizes > 8], ends[sizes > 8], strict=True):
            side = np.where(pdf["block"].to_numpy()[s:e] == pdf["i"].iloc[s], 0, 1)
            i, j = agreeing_pairs(sig[s:e], side)
            u = _Union(e - s)
            keep = []
            for k, (x, y) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
                if u.join(x, y):
                    keep.append(k)
                    if len(keep) == e - s - 1:
                        break
            out_a.append(node[s + i[keep]]), out_b.append(node[s + j[keep]])
        if out_a:
            yield pd.DataFrame({"a": np.concatenate(out_a), "b": np.concatenate(out_b)})


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """100 * intersection >= 75 * union, on sorted distinct arrays."""
    if 100 * min(len(x), len(y)) < 75 * max(len(x), len(y)):
        return False
    if len(x) > len(y):
        x, y = y, x
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    both = int((y[at] == x).sum())
    return 100 * both >= 75 * (len(x) + len(y) - both)


def _confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Confirmed links of each cluster (or pair of blocks of one)."""
    keys = ["cluster", "i", "j"]
    for pdf in _grouped(batches, keys):
        out = []
        for s, e in zip(*_bounds(pdf, keys), strict=True):
            if e - s < 2:
                continue
            part = pdf.iloc[s:e]
            side = np.where(part["block"].to_numpy() == part["i"].iloc[0], 0, 1)
            sets = [np.frombuffer(b, np.uint64) for b in part["shingles"]]
            sig = np.frombuffer(b"".join(part["sig"]), np.uint8).reshape(-1, HASHES)
            node, u = part["node"].to_numpy(np.int64), _Union(e - s)
            for i, j in zip(*(x.tolist() for x in agreeing_pairs(sig, side)), strict=True):
                if u.find(i) != u.find(j) and similar(sets[i], sets[j]):
                    u.join(i, j)
                    out.append((node[i], node[j]))
        if out:
            yield pd.DataFrame(out, columns=["a", "b"])


def _block_pairs(df: DataFrame, size: str, block: int) -> DataFrame:
    """Adds i, j, block: a group of more than ``block`` rows is dealt out as
    pairs of blocks, and every row goes to each pair that has its block."""
    n = F.ceil(F.col(size) / block).cast("int")
    df = df.withColumn("block", F.pmod(F.xxhash64("node"), n).cast("int"))
    df = df.withColumn("_o", F.explode(F.sequence(F.lit(0), n - 1)))
    return df.select("*", F.least("block", "_o").alias("i"), F.greatest("block", "_o").alias("j")).drop("_o")


def link(documents: DataFrame, scratch: Scratch, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(sketches, membership): doc_id, n_shingles, node of every row; and
    (id, component) of every node that is linked with another."""
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), utf8(text_col).alias("data"))
    sk = scratch.save(docs.mapInPandas(_sketch, "doc_id long, n_shingles long, fp binary, bands array<long>, sig binary"),
                      "sketches")
    nodes = scratch.save(sk.where("fp is not null and doc_id is not null").groupBy("fp")
                         .agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands"),
                              F.first("sig").alias("sig")), "nodes")
    # copies: rows whose node is another row's doc_id
    named = sk.where("fp is not null and doc_id is not null").select("doc_id", "fp").join(
        nodes.select("fp", "node"), "fp").select(F.col("doc_id").alias("a"), F.col("node").alias("b")).where("a <> b")
    in_bucket = scratch.save(nodes.select("node", F.explode("bands").alias("bucket")), "buckets")
    shared = scratch.save(in_bucket.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1"), "shared")
    members = in_bucket.join(shared, "bucket").join(nodes.select("node", "sig"), "node")
    dealt = _block_pairs(members, "members", BUCKET_BLOCK).repartition(shuffle_width(spark), "bucket", "i", "j") \
        .sortWithinPartitions("bucket", "i", "j").select("bucket", "i", "j", "block", "node", "sig")
    cand = dealt.mapInPandas(_bucket_pairs, "a long, b long")
    clusters = components(cand, scratch, "candidates")
    sizes = scratch.save(clusters.groupBy(F.col("component").alias("cluster")).agg(F.count("*").alias("members")),
                         "cluster-sizes")
    # full sets are made again from the texts of clustered nodes only
    inside = clusters.select(F.col("id").alias("node"), F.col("component").alias("cluster")).join(sizes, "cluster")
    inside = scratch.save(inside.join(nodes.select("node", "sig", "fp"), "node"), "clustered")

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = _WordHashes()
        for pdf in batches:
            yield pd.DataFrame({"node": pdf["node"],
                                "shingles": [shingle_set(d, cache).tobytes() for d in pdf["data"]]})

    ids = inside.select(F.col("node").alias("doc_id")).distinct()
    texts = docs.join(ids, "doc_id").select(F.col("doc_id").alias("node"), "data").mapInPandas(
        sets, "node long, shingles binary")
    dealt = _block_pairs(inside.join(texts, "node"), "members", CLUSTER_BLOCK) \
        .repartition(shuffle_width(spark), "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j") \
        .select("cluster", "i", "j", "block", "node", "sig", "shingles")
    confirmed = dealt.mapInPandas(_confirm, "a long, b long")
    # a doc_id with several sets ties their nodes together; other copies hang on
    # their node directly and need no star steps
    several = sk.where("fp is not null and doc_id is not null").groupBy(F.col("doc_id").alias("a")) \
        .agg((F.min("fp") < F.max("fp")).alias("many")).where("many").select("a")
    links = scratch.save(confirmed.unionAll(named.join(several, "a").select("a", "b")), "links")
    found = components(links, scratch, "linked")
    return sk.select("doc_id", "n_shingles", "fp"), _with_copies(sk, nodes, named, found)


def _with_copies(sk: DataFrame, nodes: DataFrame, named: DataFrame, found: DataFrame) -> DataFrame:
    """(id, component) of every doc_id that has a component other than itself
    or stands for one."""
    copies = named.join(found.withColumnRenamed("id", "b"), "b", "left").select(
        F.col("a").alias("id"), F.coalesce("component", "b").alias("component"))
    return found.unionAll(copies).groupBy("id").agg(F.min("component").alias("component"))


def near_duplicates(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of ``documents``."""
    scratch = Scratch(documents.sparkSession)
    sk, member = link(documents, scratch, text_col)
    out = sk.join(member, sk["doc_id"] == member["id"], "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    out = out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    out = scratch.save(out, "result", keep=True)
    scratch.close()
    return out
