"""Chunks of documents and a packed exchange of keys between them.

A chunk is one row: documents of a few megabytes together, their ids, lengths
and UTF-8 bytes packed into binaries, written to a table that is bucketed by
chunk.  Work on all documents that needs to know about equal keys elsewhere
(words, hashes of byte strings) runs in rounds: every chunk sends its distinct
keys, packed by key range, each range is settled in one task, and every chunk
gets its answer back.  A key that occurs in a third of all documents is sent
once per chunk, and chunks read their documents from their bucket, so texts
are not shuffled at all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablight.llm.common import Scratch, shuffle_width, unit_id, utf8

CHUNK_BYTES = 8 << 20
CHUNKS_A_BUCKET = 8
CHUNK_SCHEMA = "chunk long, ids binary, null_ids binary, flags binary, lens binary, data binary"


def chunked(documents: DataFrame, scratch: Scratch, name: str, flag=None, size: int = CHUNK_BYTES,
            transform: Callable[[int, list], pd.DataFrame] | None = None, schema: str = CHUNK_SCHEMA) -> DataFrame:
    """One row per chunk.  ``flag`` is a boolean column kept per document.
    ``transform(chunk, [(id, is null, flag, bytes), ...])`` may make other
    rows of a chunk than the packed documents."""
    make = transform or _packed
    rows = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"),
                            F.col("doc_id").isNull().alias("no_id"),
                            F.coalesce(flag if flag is not None else F.lit(False), F.lit(False)).alias("flag"),
                            utf8("text").alias("data"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, used, n = [], 0, 0
        for pdf in batches:
            for row in zip(pdf["id"], pdf["no_id"], pdf["flag"], pdf["data"], strict=True):
                held.append(row)
                used += len(row[3]) + 32
                if used >= size:
                    yield make(unit_id(n), held)
                    held, used, n = [], 0, n + 1
        if held:
            yield make(unit_id(n), held)

    # a bucket holds CHUNKS_A_BUCKET chunks at most on average, so tasks don't grow with the input
    total = documents.agg(F.sum(F.octet_length("text") + 32)).first()[0] or 0
    buckets = max(shuffle_width(documents.sparkSession), -(-total // (size * CHUNKS_A_BUCKET)))
    return scratch.save(rows.mapInPandas(pack, schema), name, bucket=(buckets, "chunk"))


def _packed(chunk: int, rows: list) -> pd.DataFrame:
    return pd.DataFrame({"chunk": [chunk], "ids": [np.array([r[0] for r in rows], np.int64).tobytes()],
                         "null_ids": [np.array([r[1] for r in rows], bool).tobytes()],
                         "flags": [np.array([r[2] for r in rows], bool).tobytes()],
                         "lens": [np.array([len(r[3]) for r in rows], np.int64).tobytes()],
                         "data": [b"".join(r[3] for r in rows)]})


def parts_for(keys: int, per_part: int = 1_000_000, least: int = 64) -> int:
    """Number of key ranges, so that one holds about ``per_part`` keys."""
    return max(least, -(-keys // per_part))


def by_part(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """A stable order of the (hashed) keys by range, and where each range ends."""
    part = (keys % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    return order, np.cumsum(np.bincount(part, minlength=parts))


def settle(requests: DataFrame, reducer: Callable[[list[pd.Series]], pd.DataFrame], schema: str) -> DataFrame:
    """``reducer`` gets all rows of one range (a frame) and returns its answers."""
    return requests.groupBy("part").applyInPandas(reducer, schema)


def with_answers(chunks: DataFrame, answers: DataFrame, work: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame],
                 schema: str) -> DataFrame:
    """``work(chunk row, its answers)`` for every chunk; the chunks are bucketed
    and stay where they are."""
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(work, schema)
