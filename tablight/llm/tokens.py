"""Operator 2: exact token counts of huge documents by overlap resynchronisation.

A text up to ``chunk`` characters is encoded at once.  A longer one is cut into
pieces of ``chunk`` characters plus an overlap with the next piece; pieces are
rows of their own, so one huge document is encoded by many tasks.  Every piece
is encoded with offsets, and neighbours are spliced at a position in their
overlap that both encodings have as a token boundary and that is proven
stable: no piece of the vocabulary contains the two characters on its sides
next to each other, so no merge can ever cross it, whatever surrounds it.  If
an overlap holds no such position, the document is cut again with pieces and
overlaps four times as wide, until its neighbours align or one piece holds it.

Models whose normaliser changes more than spaces are not cut (there a
position's neighbours do not settle the encoding): their texts are encoded
whole.

Defined cases: null and empty texts have no tokens; repeated rows are counted
one by one; null doc_ids are kept; empty tables give no rows; extra columns
are ignored.
"""

from __future__ import annotations

import functools
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablight.llm.common import Scratch

SPACE = "▁"


@functools.lru_cache(maxsize=4)
def _encoder(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@functools.lru_cache(maxsize=4)
def _joinable(path: str) -> tuple[frozenset[str], frozenset[str]] | None:
    """Pairs of characters that some vocabulary piece holds side by side, and
    the characters the vocabulary knows; None if texts can't be cut."""
    sp = _encoder(path)
    probe = "A  b\n\té ﬁ① Ａ"
    if not sp.normalize(probe).endswith(probe.replace(" ", SPACE)):
        return None
    pairs, known = set(), set()
    for i in range(sp.get_piece_size()):
        if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i):
            continue
        piece = sp.id_to_piece(i)
        known.update(piece)
        pairs.update(a + b for a, b in zip(piece, piece[1:], strict=False))
    return frozenset(pairs), frozenset(known)


def _stable(text: str, lo: int, hi: int, pairs: frozenset[str], known: frozenset[str]) -> list[int]:
    """Positions p in (lo, hi) where nothing can join text[p-1] and text[p].
    Two unknown characters may share a token, so they don't count."""
    t = text[lo:hi].replace(" ", SPACE)
    return [lo + k for k in range(1, len(t))
            if t[k - 1:k + 1] not in pairs and (t[k - 1] in known or t[k] in known)]


def _piece_rows(path: str):
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sp, (pairs, known) = _encoder(path), _joinable(path)
        for pdf in batches:
            out = []
            for row, seq, start, overlap, text in zip(pdf["row"], pdf["seq"], pdf["start"], pdf["overlap"],
                                                      pdf["piece"], strict=True):
                begins = [p.begin for p in sp.encode(text, return_type="proto").pieces]
                sides = []
                for lo, hi in ((0, min(overlap, len(text))), (max(0, len(text) - overlap), len(text))):
                    at, n = [], []
                    byte, prev = len(text[:lo].encode("utf-8")), lo
                    for p in _stable(text, lo, hi, pairs, known):
                        byte += len(text[prev:p].encode("utf-8"))
                        prev = p
                        k = bisect_left(begins, byte)
                        if k < len(begins) and begins[k] == byte:
                            at.append(start + p)
                            n.append(k)
                    sides.append((at, n))
                out.append((row, seq, len(begins), sides[0][0], sides[0][1], sides[1][0], sides[1][1]))
            yield pd.DataFrame(out, columns=["row", "seq", "n", "left_at", "left_n", "right_at", "right_n"])
    return work


#: Characters of pieces that leave a task at a time.
CUT_CHARS = 4 << 20


def _cut(chunk: int, overlap: int):
    """Texts as overlapping pieces, in one walk over each."""
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row, text in zip(pdf["row"], pdf["text"], strict=True):
                step = max(1, CUT_CHARS // chunk) * chunk
                for lo in range(0, len(text), step):
                    starts = range(lo, min(lo + step, len(text)), chunk)
                    yield pd.DataFrame({"row": row, "seq": [s // chunk for s in starts], "start": list(starts),
                                        "overlap": overlap, "piece": [text[s:s + chunk + overlap] for s in starts]})
    return work


def _spliced(pieces: DataFrame) -> DataFrame:
    """row, n_tokens (null where some pair of neighbours has no common
    stable boundary)."""
    w = Window.partitionBy("row").orderBy("seq")
    nxt = pieces.select("*", F.lead("left_at").over(w).alias("next_at"), F.lead("left_n").over(w).alias("next_n"))
    cut = F.array_min(F.array_intersect("right_at", "next_at"))
    nxt = nxt.withColumn("cut", cut)
    # tokens before the cut, counted in this piece; tokens before it in the next one
    here = F.element_at("right_n", F.array_position("right_at", F.col("cut")).cast("int"))
    there = F.element_at("next_n", F.array_position("next_at", F.col("cut")).cast("int"))
    part = F.when(F.col("next_at").isNull(), F.col("n")).otherwise(here - there)
    nxt = nxt.withColumn("part", part)
    return nxt.groupBy("row").agg(F.when(F.count("part") == F.count("*"), F.sum("part")).alias("n_tokens"))


def count_tokens(documents: DataFrame, model: str, chunk: int = 32_768, overlap: int = 256,
                 limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: one row per row of ``documents``."""
    spark = documents.sparkSession
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cuttable = _joinable(model) is not None

    @F.pandas_udf("long")
    def whole(texts: pd.Series) -> pd.Series:
        # runs of a few texts at a time keep the lists of ids small
        sp, out = _encoder(model), []
        for at in range(0, len(texts), 64):
            out += [len(x) for x in sp.encode(list(texts.iloc[at:at + 64]), num_threads=1)]
        return pd.Series(out, dtype="int64")

    n_bytes = F.octet_length("text").cast("long")
    is_long = (F.length("text") > chunk) & F.lit(cuttable)
    done = docs.where(~is_long).select("doc_id", n_bytes.alias("n_bytes"), whole("text").alias("n_tokens"))
    if cuttable:
        scratch = Scratch(spark)
        todo = scratch.save(docs.where(is_long).select(F.monotonically_increasing_id().alias("row"), "doc_id",
                                                       n_bytes.alias("n_bytes"), "text"), "long")
        longest = todo.agg(F.max(F.length("text"))).first()[0] or 0
        counted, rest, step = [], todo.select("row", "text"), 0
        while longest:
            last = chunk >= longest  # one piece holds any text: nothing is left to splice
            pieces = rest.mapInPandas(_cut(chunk, overlap), "row long, seq int, start int, overlap int, piece string")
            # one huge document becomes work for many tasks
            dealt = pieces.repartition("row", "seq").mapInPandas(
                _piece_rows(model), "row long, seq int, n long, left_at array<long>, left_n array<long>, "
                                    "right_at array<long>, right_n array<long>")
            got = scratch.save(_spliced(dealt), f"counted{step}", keep=True)
            counted.append(got.where("n_tokens is not null"))
            if last or got.where("n_tokens is null").isEmpty():
                break
            rest = rest.join(got.where("n_tokens is null").select("row"), "row", "left_semi")
            chunk, overlap, step = chunk * 4, overlap * 4, step + 1
        if counted:
            ids = scratch.save(todo.select("row", "doc_id", "n_bytes"), "ids", keep=True)
            total = functools.reduce(DataFrame.unionAll, counted)
            done = done.unionByName(ids.join(total, "row").select("doc_id", "n_bytes", "n_tokens"))
        scratch.close()
    return done.withColumn("over_limit", F.col("n_tokens") > limit)
