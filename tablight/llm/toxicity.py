"""Operator 9: toxicity by a factorization machine over hashed terms.

Terms (lower-cased runs of ASCII letters, digits and non-ASCII bytes) are
hashed into ``DIM`` buckets.  The score of a text is
``sigmoid(b + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j)``: the linear part
weighs single terms, the factors learn pairs of terms that matter only
together.

The model is fitted on a bounded sample of the labelled rows: at most
``max_rows_per_label`` rows of each label, those with the smallest hash of
doc_id, one row per doc_id and all terms of its text.  Scoring covers every row
and whole texts; the model has a fixed size and is sent to every task.

Defined cases: null or empty texts are scored from the bias alone; labels that
are null or belong to a null doc_id are not used; a doc_id that is labelled
more than once is toxic if one label says so; of several rows with one doc_id
the sample takes the one whose text has the smallest hash; without labelled rows of either
kind the score is the share of toxic labels (0 without any); null doc_ids are
scored and not held out; rows are independent, so repeated rows and extra
columns do no harm; empty tables give no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablight.llm.common import crc32_mod, utf8

DIM = 1 << 18
FACTORS = 8
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
FOLDS = 5


def terms(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and log-scaled counts of the distinct terms of a text."""
    c = Counter(TERM.findall(data.lower()))
    idx = np.fromiter((zlib.crc32(w) & (DIM - 1) for w in c), dtype=np.int64, count=len(c))
    tf = np.fromiter(c.values(), dtype=np.float32, count=len(c))
    return idx, 1.0 + np.log(tf)


@dataclass
class Model:
    bias: float
    weight: np.ndarray   # DIM
    factor: np.ndarray   # DIM x FACTORS
    gain: np.ndarray     # DIM; 0 where the bucket is not in the model

    def score(self, data: bytes) -> float:
        if not self.gain.any():
            return self.bias
        idx, x = terms(data)
        idx, x = weighed(idx, x, self.gain)
        z = self.bias + float(self.weight[idx] @ x)
        v = self.factor[idx]
        s = v.T @ x
        z += 0.5 * float(s @ s - ((v * v).T @ (x * x)).sum())
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))))


def weighed(idx: np.ndarray, x: np.ndarray, gain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The terms that the model knows, with their values times their gain."""
    keep = gain[idx] > 0
    idx = idx[keep]
    return idx, (x[keep] * gain[idx]).astype(np.float32)


def gains(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, common: float = 0.02,
          floor: float = 0.05) -> np.ndarray:
    """How much room each term gets: 1 for terms whose document shares differ
    clearly between the labels (4 standard errors or more), falling to 0 at
    1.5 standard errors; terms in at least ``common`` of the texts keep a small
    gain, since a pair of plain terms can still matter."""
    n1 = float(labels.sum())
    n0 = len(labels) - n1
    d1, d0 = np.zeros(DIM), np.zeros(DIM)
    for (idx, _), y in zip(rows, labels, strict=True):
        (d1 if y else d0)[np.unique(idx)] += 1
    p = (d1 + d0 + 0.5) / (n1 + n0 + 1)
    z = np.abs(d1 / n1 - d0 / n0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))
    gain = np.clip((z - 1.5) / 2.5, 0, 1) * (d1 + d0 >= 2)
    return np.where(d1 + d0 >= common * len(labels), np.maximum(gain, floor), gain).astype(np.float32)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 8, rate: float = 0.2,
        l2: float = 1e-4, seed: int = 7) -> Model:
    """Logistic loss, Adagrad, mini-batches of 64 rows in a seeded order.
    Positives weigh a third of all at least."""
    gain = np.zeros(DIM, np.float32)
    w, v = np.zeros(DIM, np.float32), np.zeros((DIM, FACTORS), np.float32)
    if len(labels) == 0 or labels.min() == labels.max():
        return Model(float(labels.mean()) if len(labels) else 0.0, w, v, gain)
    gain = gains(rows, labels)
    data = [weighed(idx, x, gain) for idx, x in rows]
    known = gain > 0
    rng = np.random.default_rng(seed)
    v[known] = rng.normal(0, 0.01, (int(known.sum()), FACTORS)).astype(np.float32)
    share = labels.mean()
    heavy = max(1.0, (1 / 3) / share * (1 - share) / (2 / 3)) if share < 1 / 3 else 1.0
    bias = float(np.log(share / (1 - share)))
    gw, gv, gb = np.full(DIM, 1e-2, np.float32), np.full((DIM, FACTORS), 1e-2, np.float32), 1e-2
    for _ in range(epochs):
        order = rng.permutation(len(data))
        for at in range(0, len(order), 64):
            pick = order[at:at + 64]
            sizes = np.array([len(data[i][0]) for i in pick])
            idx = np.concatenate([data[i][0] for i in pick])
            x = np.concatenate([data[i][1] for i in pick])
            doc = np.repeat(np.arange(len(pick)), sizes)
            vx = v[idx] * x[:, None]
            lin = np.bincount(doc, w[idx] * x, len(pick))
            s = np.zeros((len(pick), FACTORS), np.float32)
            np.add.at(s, doc, vx)
            sq = np.bincount(doc, (vx * vx).sum(1), len(pick))
            z = np.clip(bias + lin + 0.5 * ((s * s).sum(1) - sq), -30, 30)
            y = labels[pick]
            g = (1 / (1 + np.exp(-z)) - y) * np.where(y > 0, heavy, 1.0)
            uniq, inv = np.unique(idx, return_inverse=True)
            dw = np.bincount(inv, g[doc] * x, len(uniq)) / len(pick) + l2 * w[uniq]
            dv = np.zeros((len(uniq), FACTORS), np.float32)
            np.add.at(dv, inv, ((g[doc] * x)[:, None] * (s[doc] - vx)).astype(np.float32))
            dv = dv / len(pick) + l2 * v[uniq]
            gw[uniq] += dw * dw
            gv[uniq] += dv * dv
            w[uniq] -= rate * dw / np.sqrt(gw[uniq])
            v[uniq] -= 0.3 * rate * dv / np.sqrt(gv[uniq])
            db = float(g.mean())
            gb += db * db
            bias -= rate * db / np.sqrt(gb)
    return Model(bias, w, v, gain)


def train(documents: DataFrame, labels: DataFrame, label_col: str = "toxic", max_rows_per_label: int = 8000) -> Model:
    """Fit on a bounded sample of the rows outside the held-out fold."""
    lab = (labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull() & (crc32_mod("doc_id", FOLDS) != 0))
           .groupBy("doc_id").agg(F.max(F.col(label_col).cast("int")).alias("y")))
    picked = None
    for y in (0, 1):
        part = lab.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows_per_label)
        picked = part if picked is None else picked.unionAll(part)
    # two ids of 8 bytes and a label for at most 2 * max_rows_per_label rows
    sample = documents.select("doc_id", utf8("text").alias("data")).join(F.broadcast(picked), "doc_id")
    sample = sample.groupBy("doc_id").agg(F.first("y").alias("y"),
                                          F.min_by("data", F.struct(F.xxhash64("data"), "data")).alias("data"))

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [terms(d) for d in pdf["data"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "y": pdf["y"],
                                "idx": [i.astype(np.int32).tobytes() for i, _ in got],
                                "x": [x.astype(np.float32).tobytes() for _, x in got]})

    got = sample.mapInPandas(features, "doc_id long, y int, idx binary, x binary").toPandas()
    got = got.sort_values(["doc_id", "y", "idx"], kind="stable")
    rows = [(np.frombuffer(a, np.int32).astype(np.int64), np.frombuffer(b, np.float32))
            for a, b in zip(got["idx"], got["x"], strict=True)]
    return fit(rows, got["y"].to_numpy(np.float32))


def score(documents: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All columns plus ``toxicity`` (0 to 1)."""
    sent = documents.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.DoubleType())
    def one(data: pd.Series) -> pd.Series:
        m = sent.value
        return pd.Series([m.score(d) for d in data], dtype="float64")

    return documents.withColumn("toxicity", one(utf8(text_col)))
