"""Operator 7: exact removal of repeated byte strings by bucket-pointer refinement.

A position is repeated if the ``LENGTH`` bytes from it also start in a document
with a smaller doc_id.  Suffixes that agree on their first bytes share a
bucket; buckets are refined by the bucket identifiers of later offsets of the
same suffix, reusing the identifiers that are already there, until they decide
about LENGTH bytes:

1. Initial buckets are q-grams (q = 24), taken at anchors only: in every window
   of LENGTH bytes the q-gram with the smallest identifier.  Equal windows have
   equal anchors at equal places, so a window can only be repeated if its
   anchor's bucket holds another document.
2. Shared anchor buckets are refined by the identifiers at later offsets to the
   whole reach of the anchor (all windows that have it).  Where a reach has
   occurred in a smaller document, all its windows are repeated.  Buckets that
   hold one reach only are settled with that.
3. In buckets that hold several reaches, the windows themselves are refined:
   the identifier of a window of 50 bytes is that of its q-gram together with
   those 24 and 26 bytes later.

Each step sorts identifiers by range in the packed exchange; identifiers are
64-bit hashes (32 bits within a range in step 1, where a false match only costs
work).  Documents with the same whole text as a smaller one are removed by
their digest and take no further part.  Documents above a slice's size are
worked on in overlapping parts, so that memory does not grow with their length
beyond the text and a mark per byte.

Defined cases: null and empty texts have no bytes and keep the digest of the
empty string; texts below LENGTH bytes are never touched; rows that share a
doc_id are one document (none is smaller than the other, so nothing is removed
between them); rows with a null doc_id count as larger than all others and are
returned too; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablight.llm.common import Scratch, mix64
from tablight.llm.exchange import by_part, chunked, parts_for, settle, with_answers

LENGTH = 50
Q = 24
W = LENGTH - Q + 1
SLICE = 1 << 17
NULL_ID = 2**63 - 1
U = np.uint64
_M1, _M2, _M3 = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9)


def _reduce(a: np.ndarray, w: int, f) -> np.ndarray:
    """f over every window of w elements, by doubling."""
    step = 1
    while step * 2 <= w:
        a, step = f(a[:-step], a[step:]), step * 2
    return f(a[:len(a) - (w - step)], a[w - step:]) if step < w else a


class Slice:
    """Some documents of a chunk side by side: q-gram identifiers of all
    positions, windows (those inside one document) and anchors."""

    def __init__(self, data: bytes, lens: np.ndarray, ids: np.ndarray):
        self.data, self.lens, self.ids = data, lens, ids
        n = len(data)
        self.end = np.repeat(np.cumsum(lens), lens)          # end of the document at each byte
        self.start = self.end - np.repeat(lens, lens)
        self.doc = np.repeat(np.arange(len(lens)), lens)
        raw = np.frombuffer(data + b"\0" * (Q + 8), np.uint8)
        eight = np.lib.stride_tricks.as_strided(raw, (n + Q, 8), (1, 1)).copy().view(U).ravel()
        h = eight[:n] * _M1
        for k in range(8, Q, 8):
            h = (h ^ (h >> U(29))) * _M2 + eight[k:k + n] * _M3
        self.h = mix64(h)
        pos = np.arange(n)
        self.windows = pos + LENGTH <= self.end
        self.least = np.zeros(n, U)                          # identifier of each window's anchor
        if n >= W:
            self.least[:n - W + 1] = _reduce(self.h, W, np.minimum)
        self.least[~self.windows] = 0
        padded = np.concatenate([np.zeros(W - 1, U), self.least])
        most = _reduce(padded, W, np.maximum)
        self.anchors = np.flatnonzero((most == self.h) & (pos + Q <= self.end) & (most > 0))

    def reaches(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and identifier of each anchor's reach: the bytes of all
        windows that could have it, within its document."""
        a = self.anchors
        lo = np.maximum(a - (W - 1), self.start[a])
        hi = np.minimum(a + LENGTH, self.end[a])
        # the q-grams at both ends and from the anchor inwards cover the reach
        later = np.minimum(a + Q, hi - Q)
        earlier = np.maximum(a - Q, lo)
        got = mix64(self.h[a] ^ (((a - lo) * 64 + (hi - a)).astype(U) * _M1))
        for at in (lo, earlier, later, hi - Q):
            got = mix64(got * _M2 + self.h[at])
        return lo, hi, got

    def window_ids(self, at: np.ndarray) -> np.ndarray:
        """Identifiers of the LENGTH bytes from each position, from those of
        the q-grams there, Q and LENGTH - Q later."""
        return mix64(mix64(self.h[at] * _M2 + self.h[at + Q]) * _M2 + self.h[at + LENGTH - Q])


def _documents(row) -> tuple[np.ndarray, np.ndarray, bytes]:
    ids = np.frombuffer(row["ids"], np.int64).copy()
    ids[np.frombuffer(row["null_ids"], bool)] = NULL_ID
    return ids, np.frombuffer(row["lens"], np.int64), row["data"]


def _slices(ids: np.ndarray, lens: np.ndarray, data: bytes,
            skip: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, Slice]]:
    """Slices of about SLICE bytes of the documents that are not skipped, with
    the documents' positions in the chunk and the places where their parts begin.

    A document above SLICE bytes comes in parts that overlap by LENGTH - 1 bytes,
    so every window lies whole in one.  Parts have the document's id, so none is
    smaller than another; a reach that a part's edge cuts short only makes its
    bucket a mixed one, whose windows are asked about one by one."""
    starts = np.cumsum(lens) - lens
    pick, offs, size, used = [], [], [], 0

    def made() -> tuple[np.ndarray, np.ndarray, Slice]:
        whole = b"".join(data[starts[k] + o:starts[k] + o + n] for k, o, n in zip(pick, offs, size, strict=True))
        return np.array(pick), np.array(offs), Slice(whole, np.array(size, np.int64), ids[pick])

    for i, n in enumerate(lens.tolist()):
        if skip[i] or n < LENGTH:
            continue
        at = 0
        while at == 0 or at + LENGTH <= n:
            part = min(SLICE, n - at) if n > SLICE else n
            pick.append(i), offs.append(at), size.append(part)
            used += part
            if used >= SLICE:
                yield made()
                pick, offs, size, used = [], [], [], 0
            if at + part >= n:
                break
            at += part - (LENGTH - 1)
    if pick:
        yield made()


def _digests(lens: np.ndarray, data: bytes) -> np.ndarray:
    ends = np.cumsum(lens)
    return np.array([[xxhash.xxh3_64_intdigest(data[e - n:e]), xxhash.xxh3_64_intdigest(data[e - n:e], seed=1)]
                     for e, n in zip(ends.tolist(), lens.tolist(), strict=True)], U).reshape(-1, 2)


def _least_by(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys (sorted), the smallest id of each, and whether there are
    several ids."""
    order = np.lexsort((ids, keys))
    k, i = keys[order], ids[order]
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.empty(0, np.int64)
    last = np.r_[first[1:], len(k)] - 1 if len(k) else first
    return k[first], i[first], i[last] > i[first]


def _skipped(ids: np.ndarray, digests: np.ndarray, answers: dict) -> np.ndarray:
    """Whether a document's whole text occurs under a smaller id."""
    mine = np.full(len(ids), NULL_ID)
    low = {}
    for i, a, b in zip(ids.tolist(), digests[:, 0].tolist(), digests[:, 1].tolist(), strict=True):
        low[a, b] = min(i, low.get((a, b), NULL_ID))
    for k, (a, b) in enumerate(zip(digests[:, 0].tolist(), digests[:, 1].tolist(), strict=True)):
        mine[k] = min(low[a, b], answers.get((a, b), NULL_ID))
    return mine < ids


def _rows(chunk: int, parts: int, keys: np.ndarray, more: list[np.ndarray], offset: int = 0) -> list[tuple]:
    order, ends = by_part(keys, parts)
    out, lo = [], 0
    for p, hi in enumerate(ends.tolist()):
        if hi > lo:
            at = order[lo:hi]
            out.append((chunk, p + offset, *[x[at].tobytes() for x in more]))
        lo = hi
    return out


def _cat(col: pd.Series, kind) -> np.ndarray:
    return np.frombuffer(b"".join(col), kind)


def remove_repeats(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (bytes), one row per row."""
    scratch = Scratch(documents.sparkSession)
    chunks = chunked(documents, scratch, "chunks")
    total = chunks.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    parts = parts_for(int(total / 15))  # an anchor every 15 bytes

    # step 1: anchors and whole texts
    def ask_anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, row in pdf.iterrows():
                ids, lens, data = _documents(row)
                digests = _digests(lens, data)
                skip = _skipped(ids, digests, {})
                keys, who = [], []
                for pick, _, s in _slices(ids, lens, data, skip):
                    keys.append(s.h[s.anchors]), who.append(ids[pick][s.doc[s.anchors]])
                keys = np.concatenate(keys) if keys else np.empty(0, U)
                who = np.concatenate(who) if who else np.empty(0, np.int64)
                k, _, several = _least_by(keys, who)
                out = _rows(row["chunk"], parts, k, [(k // U(parts) & U(0xFFFFFFFF)).astype(np.uint32), several])
                out = [(*x, None) for x in out]
                first = np.flatnonzero(~skip)
                out += _rows(row["chunk"], parts, digests[first, 0],
                             [digests[first, 0], digests[first, 1], ids[first]], offset=parts)
                yield pd.DataFrame(out, columns=["chunk", "part", "a", "b", "c"])

    asked = scratch.save(chunks.mapInPandas(ask_anchors, "chunk long, part int, a binary, b binary, c binary"), "ask1")

    def settle_anchors(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["part"].iloc[0] >= parts:
            a, b, who = _cat(pdf["a"], U), _cat(pdf["b"], U), _cat(pdf["c"], np.int64)
            order = np.lexsort((who, b, a))
            a2, b2 = a[order], b[order]
            head = np.r_[True, (a2[1:] != a2[:-1]) | (b2[1:] != b2[:-1])]
            low = np.empty(len(a), np.int64)
            low[order] = who[order][np.flatnonzero(head)][np.cumsum(head) - 1]
            out, at = [], 0
            for chunk, x in zip(pdf["chunk"], pdf["c"], strict=True):
                n = len(x) // 8
                sel = np.arange(at, at + n)[low[at:at + n] < who[at:at + n]]
                if len(sel):
                    out.append((chunk, 1, a[sel].tobytes(), b[sel].tobytes(), low[sel].tobytes()))
                at += n
            return pd.DataFrame(out, columns=["chunk", "kind", "a", "b", "c"])
        keys = _cat(pdf["a"], np.uint32)
        _, inv, count = np.unique(keys, return_inverse=True, return_counts=True)
        several = _cat(pdf["b"], bool)
        many = count > 1
        many[inv[several]] = True
        out, at, part = [], 0, int(pdf["part"].iloc[0])
        for chunk, x in zip(pdf["chunk"], pdf["a"], strict=True):
            n = len(x) // 4
            hit = many[inv[at:at + n]]
            if hit.any():
                out.append((chunk, 0, part.to_bytes(8, "little"), keys[at:at + n][hit].tobytes(), None))
            at += n
        return pd.DataFrame(out, columns=["chunk", "kind", "a", "b", "c"])

    answer = "chunk long, kind int, a binary, b binary, c binary"
    answer1 = scratch.save(settle(asked, settle_anchors, answer), "answer1")

    # step 2: reaches of shared anchors
    def digest_answers(ans: pd.DataFrame) -> dict:
        mine = ans[ans["kind"] == 1]
        return {(x, y): z for a, b, c in zip(mine["a"], mine["b"], mine["c"], strict=True)
                for x, y, z in zip(np.frombuffer(a, U).tolist(), np.frombuffer(b, U).tolist(),
                                   np.frombuffer(c, np.int64).tolist(), strict=True)}

    def ask_reaches(key, row: pd.DataFrame, ans: pd.DataFrame) -> pd.DataFrame:
        cols = ["chunk", "part", "a", "b", "c", "d"]
        if not len(row):
            return pd.DataFrame([], columns=cols)
        row = row.iloc[0]
        ids, lens, data = _documents(row)
        skip = _skipped(ids, _digests(lens, data), digest_answers(ans))
        mine = ans[ans["kind"] == 0]
        # the 32 bits above the range number, together with it
        shared = np.sort(np.concatenate([np.empty(0, U)] + [
            np.frombuffer(b, np.uint32).astype(U) * U(parts) + U(int.from_bytes(a, "little"))
            for a, b in zip(mine["a"], mine["b"], strict=True)]))
        keys, reach, who = [], [], []
        if len(shared):
            for pick, _, s in _slices(ids, lens, data, skip):
                h = s.h[s.anchors]
                short = (h // U(parts) & U(0xFFFFFFFF)) * U(parts) + h % U(parts)
                at = np.minimum(np.searchsorted(shared, short), len(shared) - 1)
                hit = shared[at] == short
                _, _, c = s.reaches()
                keys.append(h[hit]), reach.append(c[hit]), who.append(ids[pick][s.doc[s.anchors[hit]]])
        if not keys:
            return pd.DataFrame([], columns=cols)
        keys, reach, who = np.concatenate(keys), np.concatenate(reach), np.concatenate(who)
        r, low, several = _least_by(reach, who)
        key_of = np.empty(len(r), U)
        key_of[np.searchsorted(r, reach)] = keys  # a reach has one anchor
        return pd.DataFrame(_rows(row["chunk"], parts, key_of, [key_of, r, low, several]), columns=cols)

    asked = scratch.save(with_answers(chunks, answer1, ask_reaches,
                                      "chunk long, part int, a binary, b binary, c binary, d binary"), "ask2")
    scratch.drop("ask1")

    def settle_reaches(pdf: pd.DataFrame) -> pd.DataFrame:
        key, reach, who = _cat(pdf["a"], U), _cat(pdf["b"], U), _cat(pdf["c"], np.int64)
        several = _cat(pdf["d"], bool)  # other documents of the chunk need the answer too
        order = np.lexsort((who, reach, key))
        k, r, w = key[order], reach[order], who[order]
        new_key = np.r_[True, k[1:] != k[:-1]]
        new_reach = new_key | np.r_[True, r[1:] != r[:-1]]
        low, mixed = np.empty(len(k), np.int64), np.empty(len(k), bool)
        low[order] = w[np.flatnonzero(new_reach)][np.cumsum(new_reach) - 1]
        reaches = np.add.reduceat(new_reach.astype(np.int64), np.flatnonzero(new_key))
        mixed[order] = (reaches > 1)[np.cumsum(new_key) - 1]
        out, at = [], 0
        for chunk, x in zip(pdf["chunk"], pdf["a"], strict=True):
            n = len(x) // 8
            sel = np.arange(at, at + n)
            down, mix = sel[(low[sel] < who[sel]) | several[sel]], np.unique(key[sel[mixed[sel]]])
            if len(down):
                out.append((chunk, 2, reach[down].tobytes(), low[down].tobytes(), None))
            if len(mix):
                out.append((chunk, 3, mix.tobytes(), None, None))
            at += n
        return pd.DataFrame(out, columns=["chunk", "kind", "a", "b", "c"])

    answer2 = scratch.save(settle(asked, settle_reaches, answer), "answer2")
    scratch.drop("ask2")

    def covered(s: Slice, who: np.ndarray, known: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes in reaches that occur under a smaller id, and how far one such
        reach that starts at or before each position goes."""
        if not len(known):
            return np.zeros(len(s.doc), bool), np.zeros(len(s.doc), np.int64)
        lo, hi, r = s.reaches()
        at = np.minimum(np.searchsorted(known, r), len(known) - 1)
        hit = (known[at] == r) & (low[at] < who[s.doc[s.anchors]])
        edge = np.zeros(len(s.doc) + 1, np.int64)
        np.add.at(edge, lo[hit], 1)
        np.add.at(edge, hi[hit], -1)
        far = np.zeros(len(s.doc), np.int64)
        np.maximum.at(far, lo[hit], hi[hit])
        return np.cumsum(edge)[:-1] > 0, np.maximum.accumulate(far)

    def reach_answers(ans: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        two, three = ans[ans["kind"] == 2], ans[ans["kind"] == 3]
        r, low = _cat(two["a"], U), _cat(two["b"], np.int64)
        order = np.argsort(r)
        return r[order], low[order], np.sort(_cat(three["a"], U))

    def open_windows(s: Slice, mixed: np.ndarray, far: np.ndarray) -> np.ndarray:
        """Windows whose anchor's bucket is not settled and that no one known
        reach holds whole.  Windows that only several reaches cover together
        may occur here first, so they are asked about too."""
        if not len(mixed):
            return np.empty(0, np.int64)
        at = np.flatnonzero(s.windows)
        spot = np.minimum(np.searchsorted(mixed, s.least[at]), len(mixed) - 1)
        at = at[mixed[spot] == s.least[at]]
        return at[far[at] < at + LENGTH]

    # step 3: windows of unsettled buckets
    def ask_windows(key, row: pd.DataFrame, ans: pd.DataFrame) -> pd.DataFrame:
        cols = ["chunk", "part", "a", "b"]
        if not len(row):
            return pd.DataFrame([], columns=cols)
        row = row.iloc[0]
        ids, lens, data = _documents(row)
        skip = _skipped(ids, _digests(lens, data), digest_answers(ans))
        known, low, mixed = reach_answers(ans)
        keys, who = [], []
        for pick, _, s in _slices(ids, lens, data, skip) if len(mixed) else ():
            at = open_windows(s, mixed, covered(s, ids[pick], known, low)[1])
            keys.append(s.window_ids(at)), who.append(ids[pick][s.doc[at]])
        if not keys:
            return pd.DataFrame([], columns=cols)
        k, first, _ = _least_by(np.concatenate(keys), np.concatenate(who))
        return pd.DataFrame(_rows(row["chunk"], parts, k, [k, first]), columns=cols)

    both = answer1.where("kind = 1").unionAll(answer2)
    asked = scratch.save(with_answers(chunks, both, ask_windows, "chunk long, part int, a binary, b binary"), "ask3")

    def settle_windows(pdf: pd.DataFrame) -> pd.DataFrame:
        key, who = _cat(pdf["a"], U), _cat(pdf["b"], np.int64)
        order = np.lexsort((who, key))
        head = np.r_[True, key[order][1:] != key[order][:-1]]
        low = np.empty(len(key), np.int64)
        low[order] = who[order][np.flatnonzero(head)][np.cumsum(head) - 1]
        out, at = [], 0
        for chunk, x in zip(pdf["chunk"], pdf["a"], strict=True):
            n = len(x) // 8
            sel = np.arange(at, at + n)
            sel = sel[low[sel] < who[sel]]
            if len(sel):
                out.append((chunk, 4, key[sel].tobytes(), low[sel].tobytes(), None))
            at += n
        return pd.DataFrame(out, columns=["chunk", "kind", "a", "b", "c"])

    answer3 = scratch.save(settle(asked, settle_windows, answer), "answer3")
    scratch.drop("ask3")

    # removal
    def finish(key, row: pd.DataFrame, ans: pd.DataFrame) -> pd.DataFrame:
        cols = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "cut"]
        if not len(row):
            return pd.DataFrame([], columns=cols)
        row = row.iloc[0]
        ids, lens, data = _documents(row)
        no_id = np.frombuffer(row["null_ids"], bool)
        skip = _skipped(ids, _digests(lens, data), digest_answers(ans)) & (lens >= LENGTH)
        known, low, mixed = reach_answers(ans)
        four = ans[ans["kind"] == 4]
        win, win_low = _cat(four["a"], U), _cat(four["b"], np.int64)
        order = np.argsort(win)
        win, win_low = win[order], win_low[order]
        # windows that repeat within the chunk need its own smallest ids
        pending = []
        for pick, offs, s in _slices(ids, lens, data, skip):
            cover, far = covered(s, ids[pick], known, low)
            at = open_windows(s, mixed, far)
            pending.append((pick, offs, s.lens, cover, at, s.window_ids(at), ids[pick][s.doc[at]]))
        own, own_low, _ = _least_by(np.concatenate([np.empty(0, U)] + [p[5] for p in pending]),
                                    np.concatenate([np.empty(0, np.int64)] + [p[6] for p in pending]))
        gone = {}
        for pick, offs, slens, cover, at, k, who in pending:
            if len(at):
                first = own_low[np.searchsorted(own, k)]
                if len(win):
                    spot = np.minimum(np.searchsorted(win, k), len(win) - 1)
                    first = np.where(win[spot] == k, np.minimum(first, win_low[spot]), first)
                at = at[first < who]
                edge = np.zeros(len(cover) + 1, np.int64)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + LENGTH, -1)
                cover = cover | (np.cumsum(edge)[:-1] > 0)
            lo = 0
            for i, off, n in zip(pick.tolist(), offs.tolist(), slens.tolist(), strict=True):
                if cover[lo:lo + n].any():
                    gone.setdefault(i, np.zeros(lens[i], bool))[off:off + n] |= cover[lo:lo + n]
                lo += n
        out, end = [], 0
        for i, n in enumerate(lens.tolist()):
            text, end = data[end:end + n], end + n
            if skip[i]:
                cut, text = [0, n], b""
            elif i in gone:
                flips = np.flatnonzero(np.diff(np.r_[False, gone[i], False].astype(np.int8)))
                cut, text = flips.tolist(), np.frombuffer(text, np.uint8)[~gone[i]].tobytes()
            else:
                cut = []
            out.append((None if no_id[i] else int(ids[i]), n, sum(cut[1::2]) - sum(cut[::2]), len(cut) // 2,
                        hashlib.sha256(text).hexdigest(), cut))
        pdf = pd.DataFrame(out, columns=cols)
        pdf["doc_id"] = pdf["doc_id"].astype("Int64")
        return pdf

    done = with_answers(chunks, both.unionAll(answer3), finish,
                        "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, cut array<long>")
    done = scratch.save(done, "result", keep=True)
    scratch.close()
    return done
