"""Operator 11: byte-pair encoding and decoding through an index of pair
occurrences.

Texts are cut at ASCII white space, which no token crosses; the distinct pieces
of a task are normalised, cut into words by the file's own pattern and encoded
together.  All words lie in one symbol array with links to the neighbours.  An
index maps every mergeable pair to all its positions, ranks that have positions
are active, and the lowest active rank is applied to all its positions at once;
the pairs that this makes are looked up and put on their lists.  A position
whose symbols have changed since it was listed is passed over.  Words are apart
from each other, so ascending ranks over all of them are ascending ranks in
each.

Pieces are remembered while a task lasts, up to ``CACHE_PIECES``; beyond it the
memory is begun anew, which changes no result.  Texts are read in slices of
``SLICE_BYTES`` that end at white space.

Defined cases: null and empty texts have no ids and decode to an empty text;
repeated rows are encoded one by one; null doc_ids are kept; empty tables give
no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablight.llm.common import utf8

SLICE_BYTES = 4 << 20
CACHE_PIECES = 400_000
ROWS_OUT = 2_000
#: The file's split pattern on lower-case ASCII (fixed value).
ASCII_WORDS = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\x20\x09-\x0da-z0-9]+")


def byte_chars() -> list[str]:
    """The printable character that byte-level vocabularies write for each
    byte: itself where printable, else the next free one from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """A BPE file of the tokenizers library, with its merges as arrays."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if (model["type"] != "BPE" or model.get("dropout") or model.get("byte_fallback") or model.get("ignore_merges")
                or model.get("continuing_subword_prefix") or spec.get("decoder") or spec.get("post_processor")):
            raise ValueError(f"{path}: only plain byte-level BPE without decoder is supported")
        library = Tokenizer.from_file(path)
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        self.size = max(vocab.values()) + 1
        chars = byte_chars()
        self.byte_of = {c: b for b, c in enumerate(chars)}
        self.inner = np.array([vocab[c] for c in chars], np.int64)
        self.final = np.array([vocab[c + end] for c in chars], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.left = np.array([vocab[a] for a, _ in pairs], np.int64)
        self.right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        key = self.left * self.size + self.right
        self.rank_at = np.argsort(key, kind="stable")
        self.keys = key[self.rank_at]
        added = {t["content"]: t for t in spec.get("added_tokens") or ()}
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] or not t["content"].isascii()
               or t["content"].split() != [t["content"]] for t in added.values()):
            raise ValueError(f"{path}: added tokens must be plain ASCII words")
        self.added = {c.encode(): t["id"] for c, t in added.items()}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.added_re = re.compile(b"(" + b"|".join(map(re.escape, longest_first)) + b")") if added else None
        names = {i: t for t, i in vocab.items()} | {t["id"]: c for c, t in added.items()}
        self.names = [names.get(i, "").encode() for i in range(max(names) + 1)]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it has none."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.rank_at[at], -1)

    def words(self, piece: bytes) -> list[bytes | int]:
        """The words of a piece without ASCII white space; added tokens as ids."""
        if self.added_re is not None and self.added_re.search(piece):
            out: list[bytes | int] = []
            for part in self.added_re.split(piece):
                out += [self.added[part]] if part in self.added else self._plain(part)
            return out
        return self._plain(piece)

    def _plain(self, part: bytes) -> list[bytes]:
        if part.isascii():
            return ASCII_WORDS.findall(part.lower())
        text = self.normalizer.normalize_str(part.decode("utf-8", "replace"))
        return [bytes(map(self.byte_of.__getitem__, w)) for w, _ in self.splitter.pre_tokenize_str(text)]

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words in a row, and how many each word has."""
        lens = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(lens)
        data = np.frombuffer(b"".join(words), np.uint8)
        n = len(data)
        if not n:
            return np.zeros(0, np.int32), lens
        sym = np.append(self.inner[data], -1)  # position n stands for "no neighbour"
        last, start = ends[lens > 0] - 1, (ends - lens)[lens > 0]
        sym[last] = self.final[data[last]]
        nxt, prv = np.arange(1, n + 2), np.arange(-1, n)
        nxt[last], prv[start] = n, n
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def listed(at: np.ndarray) -> None:
            rank = self.ranks(sym[at], sym[nxt[at]])
            at, rank = at[rank >= 0], rank[rank >= 0]
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cut = np.flatnonzero(np.diff(rank)) + 1
            for r, places in zip(rank[np.concatenate(([0], cut))].tolist() if len(rank) else (),
                                 np.split(at, cut), strict=False):
                if r not in index:
                    index[r] = []
                    heapq.heappush(active, r)
                index[r].append(places)

        listed(np.arange(n))
        while active:
            r = heapq.heappop(active)
            places = index.pop(r)
            at = places[0] if len(places) == 1 else np.unique(np.concatenate(places))
            at = at[(sym[at] == self.left[r]) & (sym[nxt[at]] == self.right[r])]
            if self.left[r] == self.right[r] and len(at) > 1:
                at = self._leftmost(at, nxt)
            if not len(at):
                continue
            gone = nxt[at]
            after = nxt[gone]
            sym[at], sym[gone] = self.made[r], -2
            nxt[at], prv[after] = after, at
            before = prv[at]
            listed(np.unique(np.concatenate((before[before < n], at))))
        kept = sym[:n] >= 0
        total = np.concatenate(([0], np.cumsum(kept)))
        return sym[:n][kept].astype(np.int32), total[ends] - total[ends - lens]

    @staticmethod
    def _leftmost(at: np.ndarray, nxt: np.ndarray) -> np.ndarray:
        """Of overlapping places of a pair of equal symbols, every other one
        from the left."""
        out, taken = [], -1
        for p in at.tolist():
            if p != taken:
                out.append(p)
                taken = int(nxt[p])
        return np.array(out, np.int64)


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Pieces:
    """Pieces seen by a task and their ids."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.clear()

    def clear(self) -> None:
        self.at: dict[bytes, int] = {}
        self.ids, self.start, self.len = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self, pieces: list[bytes]) -> None:
        """Encode the pieces not seen yet, all together."""
        if len(self.at) > CACHE_PIECES:
            self.clear()
        new = [p for p in dict.fromkeys(pieces) if p not in self.at]
        if not new:
            return
        known: dict[bytes | int, int] = {}
        flat: list[int] = []
        ends = np.zeros(len(new), np.int64)
        for i, p in enumerate(new):
            flat += [known.setdefault(w, len(known)) for w in self.vocab.words(p)]
            ends[i] = len(flat)
        words = [b"" if isinstance(w, int) else w for w in known]
        ids, lens = self.vocab.encode_words(words)
        starts = np.cumsum(lens) - lens
        special = [(i, w) for i, w in enumerate(known) if isinstance(w, int)]
        for k, (i, w) in enumerate(special):
            starts[i], lens[i] = len(ids) + k, 1
        ids = np.concatenate([ids, np.array([w for _, w in special], np.int32)])
        which = np.array(flat, np.int64)
        upto = np.concatenate(([0], np.cumsum(lens[which])))
        last = upto[ends]
        base, first = len(self.ids), len(self.at)
        self.at.update(zip(new, range(first, first + len(new)), strict=True))
        self.ids = np.concatenate([self.ids, _gather(ids, starts[which], lens[which])])
        self.start = np.concatenate([self.start, base + np.concatenate(([0], last[:-1]))])
        self.len = np.concatenate([self.len, np.diff(last, prepend=0)])

    def encoded(self, pieces: list[bytes]) -> np.ndarray:
        which = np.fromiter(map(self.at.__getitem__, pieces), np.int64, len(pieces))
        return _gather(self.ids, self.start[which], self.len[which])


def _gather(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs values[start:start + size], one after the other."""
    ends = np.cumsum(size)
    return values[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - size), size)]


def _slices(data: bytes) -> Iterator[bytes]:
    """Slices of a long text that end before ASCII white space."""
    at = 0
    while at < len(data):
        end = at + SLICE_BYTES
        if end < len(data):
            found = re.compile(rb"[\x20\x09-\x0d]").search(data, end)
            end = found.start() if found else len(data)
        yield data[at:end]
        at = end


def _encode(path: str, decode: bool):
    def rows(ids: list, encoded: list[np.ndarray], names: list[bytes]) -> pa.RecordBatch:
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in encoded]))).astype(np.int32)
        flat = np.concatenate(encoded) if encoded else np.zeros(0, np.int32)
        out = {"doc_id": pa.array(ids, pa.int64()),
               "ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))}
        if decode:
            out["decoded"] = pa.array([b" ".join(map(names.__getitem__, x.tolist())) for x in encoded],
                                      pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_pydict(out)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        pieces = Pieces(vocab)
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS_OUT):
                part = batch.slice(lo, ROWS_OUT)
                ids, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
                done: list[np.ndarray] = []
                held, size, first = [], 0, 0
                for i, data in enumerate(texts):
                    if len(data) > SLICE_BYTES:
                        slices = []
                        for s in _slices(data):
                            cut = s.split()
                            pieces.learn(cut)
                            slices.append(pieces.encoded(cut))
                        held.append(np.concatenate(slices))
                    else:
                        held.append(data.split())
                    size += len(data)
                    if size >= SLICE_BYTES or i == len(texts) - 1:
                        pieces.learn([p for cut in held if isinstance(cut, list) for p in cut])
                        done += [pieces.encoded(cut) if isinstance(cut, list) else cut for cut in held]
                        yield rows(ids[first:i + 1], done, vocab.names)
                        held, done, size, first = [], [], 0, i + 1
    return work


def encode(documents: DataFrame, path: str, decode: bool = False) -> DataFrame:
    """doc_id, ids (array<int>) and, if asked for, decoded: one row per row of
    ``documents``."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("data"))
    schema = "doc_id long, ids array<int>" + (", decoded string" if decode else "")
    return rows.mapInArrow(_encode(path, decode), schema)


def decode(ids: str | Column, path: str) -> Column:
    """The text of a column of ids (null: null)."""
    @F.pandas_udf("string")
    def text(col: pd.Series) -> pd.Series:
        names = vocabulary(path).names
        return pd.Series([None if x is None else b" ".join(names[i] for i in x).decode("utf-8") for x in col],
                         dtype=object)

    return text(ids)
