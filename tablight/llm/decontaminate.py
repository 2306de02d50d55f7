"""Operator 5: benchmark decontamination by spaced-seed hashing, DataFrame
functions only.

Words are lower-cased runs of letters and digits.  A seed is a window of
``SPAN`` words of which a fixed mask ignores some; windows of benchmark items
and documents that agree on the other words share a hash.  Every hit is
verified on the spot: of the aligned words around it (a window that holds the
seed and lies in both texts, of ``WINDOW`` words or all words of the shorter
text), at least ``SHARE`` must be equal, so substituted words do not hide a
passage.

The masks are complete: whichever words of a window are substituted, as long as
the share holds, some mask meets some place of it with equal words only.
``MASKS`` does this for windows of WINDOW words, ``SHORT_MASKS`` for those of
SPAN words and more, which occur where an item or a document is that short.
Items below SPAN words match documents that hold them word for word.

Documents are cut into overlapping pieces of word hashes before the seeds are
formed, so neither a seed row nor a verification ever carries a whole text.
The benchmark's seeds are broadcast only below ``BROADCAST_SEEDS`` rows.  Beyond
that, seeds and places alone go through the join, and pieces are fetched for
the places that hit.

Defined cases: null and empty texts match nothing, and documents below SPAN
words only items that they hold whole; identical items are one item (smallest
item_id); rows that share a doc_id are one document; empty tables give no rows;
extra columns are ignored; null doc_ids and item_ids are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablight.llm.common import Scratch

SPAN = 8
#: 1: the word counts.  Each mask ignores three of eight words.
MASKS = ("11010011", "11100101", "10001111", "11101010")
SHORT_MASKS = ("11010011", "10011101", "11100101", "00101111", "11111000", "10110110", "11001110", "10101011",
               "01111100", "01110011", "00011111")
WINDOW = 13
SHARE = 0.75
PIECE = 64
#: Seeds up to which the benchmark side is broadcast.  A row holds its seed and up
#: to 18 word hashes, about 200 bytes, so 200 MB at the bound.
BROADCAST_SEEDS = 1_000_000


BETWEEN = r"[^\p{L}\p{N}]+"


def few_words(text: str, below: int) -> Column:
    """Whether a text has fewer words than ``below`` (before lower-casing, which
    can only split words further); reads no more of it than that many words."""
    parts = F.split(F.coalesce(F.col(text), F.lit("")), BETWEEN, below + 2)
    return F.size(F.filter(parts, lambda w: w != "")) < below


def word_hashes(text: str) -> Column:
    parts = F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), BETWEEN)
    return F.transform(F.filter(parts, lambda w: w != ""), lambda w: F.xxhash64(w))


def _seeds(arr: Column, at: Column, short: bool) -> Column:
    """The seeds of a place; those of the two sets of masks are told apart."""
    masks = [(100 + k, m) for k, m in enumerate(SHORT_MASKS)] if short else list(enumerate(MASKS))
    return F.array(*[F.xxhash64(F.lit(k), *[F.get(arr, at + j) for j, bit in enumerate(m) if bit == "1"])
                     for k, m in masks])


def _items(benchmark: DataFrame) -> DataFrame:
    """item_id, item (word hashes); identical items once."""
    return (benchmark.where("item_id is not null").select("item_id", word_hashes("text").alias("item"))
            .groupBy("item").agg(F.min("item_id").alias("item_id")).where(F.size("item") > 0))


def benchmark_seeds(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """seed, item_id, near (word hashes around), near_at, item_words: one row per
    mask and position.  Any item may meet a short document; only items of
    ``window`` words may meet the long ones by the masks made for them."""
    per = items.where(F.size("item") >= SPAN).select(
        "item_id", "item", F.explode(F.sequence(F.lit(0), F.size("item") - SPAN)).alias("at"))
    seeds = F.concat(F.when(F.size("item") >= window, _seeds(F.col("item"), F.col("at"), False))
                     .otherwise(F.array().cast("array<bigint>")), _seeds(F.col("item"), F.col("at"), True))
    # only the words that a verification can reach
    reach = window - SPAN
    lo = F.greatest(F.col("at") - reach, F.lit(0))
    return per.select("item_id", F.slice("item", lo + 1, SPAN + 2 * reach).alias("near"),
                      (F.col("at") - lo).alias("near_at"), F.size("item").alias("item_words"),
                      F.explode(seeds).alias("seed"))


def document_pieces(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, piece (word hashes with context on both sides), first (index of
    the first own word in the piece), start, own (own positions), words (of the
    document)."""
    reach = window - SPAN
    docs = documents.where("doc_id is not null").select("doc_id", word_hashes("text").alias("w"))
    # a null array makes no rows; a filter on the size would work out the words twice
    starts = F.when(F.size("w") >= SPAN, F.sequence(F.lit(0), F.size("w") - SPAN, F.lit(PIECE)))
    per = docs.select("doc_id", "w", F.explode(starts).alias("start"))
    lo = F.greatest(F.col("start") - reach, F.lit(0))
    hi = F.least(F.col("start") + PIECE + SPAN - 1 + reach, F.size("w"))
    return per.select("doc_id", F.slice("w", lo + 1, hi - lo).alias("piece"),
                      (F.col("start") - lo).alias("first"), "start",
                      F.least(F.lit(PIECE), F.size("w") - SPAN + 1 - F.col("start")).alias("own"),
                      F.size("w").alias("words"))


def _verified(hits: DataFrame, window: int, share: float) -> DataFrame:
    """doc_id, item_id, word, share of the hits whose best window passes:
    windows that hold the seed, start ``back`` words before it and lie in both
    texts."""
    width = F.least(F.lit(window), F.col("item_words"), F.col("words"))
    equal = lambda back: F.size(F.filter(
        F.sequence(F.lit(0), width - 1),
        lambda j: F.get("piece", F.col("p") - back + j) == F.get("near", F.col("near_at") - back + j)))
    inside = lambda back: ((F.col("p") >= back) & (F.col("near_at") >= back)
                           & (F.col("p") - back + width <= F.size("piece"))
                           & (F.col("near_at") - back + width <= F.size("near")))
    best = F.array_max(F.transform(F.sequence(F.lit(0), width - SPAN),
                                   lambda back: F.when(inside(back), equal(back) / width).otherwise(F.lit(0.0))))
    return hits.select("doc_id", "item_id", (F.col("start") + F.col("i")).alias("word"), best.alias("share")).where(
        F.col("share") >= share)


def _whole_items(documents: DataFrame, items: DataFrame, lengths: list[int]) -> DataFrame:
    """doc_id, item_id, word, share: documents that hold an item below SPAN
    words word for word."""
    docs = documents.where("doc_id is not null").select("doc_id", word_hashes("text").alias("w"))

    def of_length(n: int) -> Column:
        run = lambda at: F.slice("w", at + 1, F.lit(n))
        starts = F.when(F.size("w") >= n, F.sequence(F.lit(0), F.size("w") - n)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda at: F.struct(at.alias("word"), F.xxhash64(F.lit(n), run(at)).alias("seed"),
                                                       run(at).alias("run")))

    runs = F.concat(*[of_length(n) for n in lengths])
    short = items.where(F.size("item") < SPAN).select(
        "item_id", "item", F.xxhash64(F.size("item"), "item").alias("seed"))
    found = docs.select("doc_id", F.inline(runs)).join(short, "seed").where(F.col("run") == F.col("item"))
    return found.select("doc_id", "item_id", "word", F.lit(1.0).alias("share"))


def leaks(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE,
          broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """doc_id, item_id, best_share, hits, first_word: one row per document and
    benchmark item with a verified overlap."""
    items = _items(benchmark)
    sizes = {r["n"]: r["rows"] for r in items.groupBy(F.least(F.size("item"), F.lit(window)).alias("n")).agg(
        F.count("*").alias("rows"), F.sum(F.size("item")).alias("words")).withColumn(
        "rows", F.struct("rows", "words")).collect()}  # at most one row per length up to the window
    seeds = benchmark_seeds(items, window)
    # a long document meets short items by the masks for them
    short_items = any(SPAN <= n < window for n in sizes)

    def spots(docs: DataFrame, *short: bool) -> DataFrame:
        at = F.col("first") + F.col("i")
        sets = [_seeds(F.col("piece"), at, kind) for kind in short]
        per = document_pieces(docs, window).select("doc_id", "piece", "first", "start", "words",
                                                   F.explode(F.sequence(F.lit(0), F.col("own") - 1)).alias("i"))
        return per.select("doc_id", "piece", "words", "start", "i", at.alias("p"),
                          F.explode(sets[0] if len(sets) == 1 else F.concat(*sets)).alias("seed"))

    # short documents apart: their masks are many, and make code too long to be compiled well
    few = few_words("text", window)
    places = spots(documents.where(~few), False, *([True] if short_items else [])).unionAll(
        spots(documents.where(few), True))
    n_seeds = sum(r["words"] for r in sizes.values()) * (len(MASKS) + len(SHORT_MASKS))
    if n_seeds <= broadcast_seeds:
        hits = places.join(F.broadcast(seeds), "seed")
    else:
        met = places.select("seed", "doc_id", "start", "i", "p").join(seeds.select("seed").distinct(), "seed", "left_semi")
        pieces = document_pieces(documents, window).select("doc_id", "start", "piece", "words")
        hits = met.join(pieces, ["doc_id", "start"]).join(seeds, "seed")
    found = _verified(hits, window, share)
    lengths = sorted(n for n in sizes if n < SPAN)
    if lengths:
        found = found.unionByName(_whole_items(documents, items, lengths))
    return found.groupBy("doc_id", "item_id").agg(F.max("share").alias("best_share"), F.count("*").alias("hits"),
                                                  F.min("word").alias("first_word"))


def decontaminate(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a verified overlap with any benchmark item.

    The ids of the others are written first, so that the planner knows their
    size: it sends them to the documents while they are small, and only then
    has to move documents."""
    scratch = Scratch(documents.sparkSession)
    bad = scratch.save(leaks(documents, benchmark).select(F.col("doc_id").alias("_bad id")).distinct(), "leaks", keep=True)
    return documents.join(bad, documents["doc_id"] == bad["_bad id"], "left_anti")
