"""Operator 1: LM scoring with a Brown class-based bigram model.

``P(w | previous) = P(class(w) | class(previous)) * P(w | class(w))``.  Classes
come from exchange clustering: words move, one by one or many at a time, to the
class that raises the likelihood of the class bigrams most.

Here every pass counts, over all training tokens, how often each class stands
before and after each core word; with these counts all core words weigh every
class at once, half of them (in turn) move to their best one, and the next pass
shows what that did to the likelihood.  Passes go on until the likelihood of the
class bigrams changes by less than ``CONVERGED`` of itself over a sweep, in which
every core word had its turn; the best assignment seen is kept.  Should a sweep
find nothing better, the parts that move at a time get smaller, so that words
that chase each other part ways.  Core
words are those with at least 1/2**17 of all training tokens, so there are at
most 2**17 of them and their classes may be sent to every task.  Every other
word is exchanged once the same way: its neighbours' classes in all training
documents meet in one task, which moves it to the class that raises the likelihood
of the class bigrams most.  Counts of words, class emissions and class transitions
cover every training token.

Smoothing: absolute discounting of the transitions (backing off to the class
shares) and of the emissions; what the emissions of a class give up is its
share of unknown words.  The probabilities of all known words and of "an
unknown word" sum to one in every context.

Documents are encoded once into chunks of word numbers; words meet their counts
and classes through the packed exchange of ``exchange``, one entry per chunk
and distinct word.

Defined cases: null and empty texts consist of their end token; without
training tokens, or if these are end tokens only, the score is the base score;
null doc_ids are scored and belong to the training part; rows that repeat count
one by one; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablight.llm.common import Scratch, words_of
from tablight.llm.exchange import by_part, chunked, parts_for, settle, with_answers

CLASSES = 64
CORE_SHARE = 1 << 17
#: Relative change of the likelihood over a sweep below which passes end.
CONVERGED = 3e-3
U = np.uint64
END = 0                      # local number, and class, of the end token
END_KEY = 0x656E642D746F6B65  # its key; words are hashed
REST = CLASSES               # class of words outside the core during the passes
N_CLASS = CLASSES + 1
CHUNK_BYTES = 4 << 20
#: Neighbour classes of other words that weigh their classes at a time.
CELLS = 50_000
CHUNK = "chunk long, ids binary, null_ids binary, flags binary, lens binary, toks binary, keys binary"


def _encode(chunk: int, rows: list) -> pd.DataFrame:
    """Word numbers of a chunk's documents (an end token after each) and the
    hashed words behind the numbers."""
    number: dict[bytes, int] = {b"": END}  # no word is empty
    toks, lens = [], []
    for r in rows:
        words = words_of(r[3])
        t = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words))
        toks += [t, np.zeros(1, np.int32)]
        lens.append(len(words) + 1)
    keys = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in number), U, len(number))
    keys[END] = END_KEY
    return pd.DataFrame({"chunk": [chunk], "ids": [np.array([r[0] for r in rows], np.int64).tobytes()],
                         "null_ids": [np.array([r[1] for r in rows], bool).tobytes()],
                         "flags": [np.array([r[2] for r in rows], bool).tobytes()],
                         "lens": [np.array(lens, np.int64).tobytes()], "toks": [np.concatenate(toks).tobytes()],
                         "keys": [keys.tobytes()]})


class _Chunk:
    def __init__(self, row):
        self.chunk = row["chunk"]
        self.ids, self.no_id = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["null_ids"], bool)
        self.held = np.frombuffer(row["flags"], bool)
        self.lens, self.toks = np.frombuffer(row["lens"], np.int64), np.frombuffer(row["toks"], np.int32)
        self.keys = np.frombuffer(row["keys"], U)

    def training(self) -> np.ndarray:
        """Word numbers of the training documents, end to end; the token before
        a document's first is an end token either way."""
        return self.toks[np.repeat(~self.held, self.lens)]


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[_Chunk]:
    for pdf in batches:
        for _, row in pdf.iterrows():
            yield _Chunk(row)


def _packed_rows(c: _Chunk, parts: int, arrays: list[np.ndarray]) -> list[tuple]:
    order, ends = by_part(c.keys, parts)
    out, lo = [], 0
    for p, hi in enumerate(ends.tolist()):
        if hi > lo:
            out.append((c.chunk, p, *[a[order[lo:hi]].tobytes() for a in arrays]))
        lo = hi
    return out


def _g(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def likelihood(pairs: np.ndarray) -> float:
    """Of the class bigrams, up to the words' own constant part."""
    return float(_g(pairs).sum() - _g(pairs.sum(0)).sum() - _g(pairs.sum(1)).sum())


def best_classes(left: np.ndarray, right: np.ndarray, now: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """For each word (counts of the classes before and after it) the class
    that it fits best when taken out of its own."""
    out = np.empty(len(now), np.int64)
    before, after = pairs.sum(0), pairs.sum(1)
    for at in range(0, len(now), 64):
        l, r, a = left[at:at + 64], right[at:at + 64], now[at:at + 64]
        n, rows = l.sum(1), np.arange(len(a))
        into = np.repeat(pairs.T[None], len(a), 0)    # word, class b, class before
        outof = np.repeat(pairs[None], len(a), 0)     # word, class b, class after
        into[rows, a] -= l
        outof[rows, a] -= r
        into, outof = np.maximum(into, 0), np.maximum(outof, 0)
        tb, ta = np.repeat(before[None], len(a), 0), np.repeat(after[None], len(a), 0)
        tb[rows, a] -= n
        ta[rows, a] -= n
        tb, ta = np.maximum(tb, 0), np.maximum(ta, 0)
        gain = ((_g(into + l[:, None]) - _g(into)).sum(2) + (_g(outof + r[:, None]) - _g(outof)).sum(2)
                - (_g(tb + n[:, None]) - _g(tb)) - (_g(ta + n[:, None]) - _g(ta)))
        gain[:, [END, REST]] = -np.inf
        out[at:at + 64] = gain.argmax(1)
    return out


def joined_classes(word: np.ndarray, left: np.ndarray, right: np.ndarray, n_words: int, pairs: np.ndarray) -> np.ndarray:
    """For each of ``n_words`` words outside the core the class that raises the
    likelihood most when the word moves there; ``left`` and ``right`` are the
    classes before and after each place of ``word``.  The same choice as
    ``best_classes`` makes of the whole counts, from the cells that are not zero."""
    before, after = pairs.sum(0), pairs.sum(1)
    cells = []
    for side, c in enumerate((left, right)):
        code, n = np.unique(word * N_CLASS + c, return_counts=True)
        cells.append((code // N_CLASS, np.full(len(code), side), code % N_CLASS, n))
    w, side, c, n = (np.concatenate(x) for x in zip(*cells, strict=True))
    order = np.argsort(w, kind="stable")
    w, side, c, n = w[order], side[order], c[order], n[order].astype(float)
    first = np.flatnonzero(np.r_[True, w[1:] != w[:-1]]) if len(w) else np.zeros(0, np.int64)
    ends, total = np.r_[first[1:], len(w)], np.bincount(word, minlength=n_words)
    base = np.stack([pairs, pairs.T])              # side, neighbour's class, the word's class
    held = _g(base)
    out, lo = np.ones(n_words, np.int64), 0
    while lo < len(first):                         # whole words, about CELLS cells at a time
        hi = max(lo + 1, int(np.searchsorted(ends, first[lo] + CELLS, side="right")))
        at = slice(first[lo], ends[hi - 1])
        gain = np.add.reduceat(_g(base[side[at], c[at]] + n[at, None]) - held[side[at], c[at]], first[lo:hi] - first[lo],
                               axis=0)
        m = total[w[first[lo:hi]]].astype(float)[:, None]
        gain -= _g(before + m) - _g(before) + _g(after + m) - _g(after)
        gain[:, [END, REST]] = -np.inf             # not open to words
        out[w[first[lo:hi]]] = gain.argmax(1)
        lo = hi
    return out


class Model:
    """Transitions, discounts and totals; words bring their count and class."""

    def __init__(self, pairs: np.ndarray, tokens: np.ndarray, types: np.ndarray, n1: int, n2: int):
        """pairs: class bigrams; tokens and types of each class."""
        self.n, self.v = int(tokens.sum()), int(types.sum())
        self.tokens = np.maximum(tokens, 1).astype(float)
        self.d = float(np.clip(n1 / max(1, n1 + 2 * n2), 0.1, 0.9))
        self.d_of = np.where(np.arange(len(types)) == END, 0.0, self.d)
        lost = self.d_of * types / self.tokens
        share = tokens / max(1, self.n)
        total = pairs.sum(1, keepdims=True)
        seen = (pairs > 0).sum(1, keepdims=True)
        t = np.where(total > 0, (np.maximum(pairs - 0.5, 0) + 0.5 * seen * share) / np.maximum(total, 1), share)
        post = share * lost
        self.usable = post.sum() > 0
        if self.usable:
            t = np.vstack([t, (post / post.sum()) @ t])  # the context of an unknown word
            with np.errstate(divide="ignore"):
                self.log_unknown = np.log10(t @ lost)
                self.log_t = np.log10(t)

    def score(self, cls: np.ndarray, count: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Base score and score of documents end to end, each closed by its
        end token; count 0: unknown."""
        first = np.r_[0, np.cumsum(lens)[:-1]]
        base = np.add.reduceat(np.log10((count + 1.0) / (self.n + self.v + 1.0)), first)
        if not self.usable:
            return base, base
        known = count > 0
        here = np.where(known, cls, len(self.tokens))
        prev = np.r_[END, here[:-1]]
        prev[first] = END
        c = np.where(known, cls, 0)
        emit = np.log10(np.maximum(count - self.d_of[c], 1e-9) / self.tokens[c])
        lp = np.where(known, self.log_t[prev, c] + emit, self.log_unknown[prev])
        return base, np.add.reduceat(lp, first)


def score_documents(documents: DataFrame, held_out) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.
    ``held_out`` is a boolean column; the model learns from the other rows."""
    spark = documents.sparkSession
    sc = spark.sparkContext
    scratch = Scratch(spark)
    chunks = chunked(documents, scratch, "encoded", flag=held_out, size=CHUNK_BYTES, transform=_encode, schema=CHUNK)
    total = chunks.agg(F.sum(F.octet_length("keys"))).first()[0] or 0
    parts = parts_for(total // 8)

    # word counts
    def ask_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for c in _chunks(batches):
            n = np.bincount(c.training(), minlength=len(c.keys))
            yield pd.DataFrame(_packed_rows(c, parts, [c.keys, n]), columns=["chunk", "part", "a", "b"])

    asked = scratch.save(chunks.mapInPandas(ask_counts, "chunk long, part int, a binary, b binary"), "counts")

    def sum_counts(pdf: pd.DataFrame) -> pd.DataFrame:
        k, inv = np.unique(np.frombuffer(b"".join(pdf["a"]), U), return_inverse=True)
        n = np.zeros(len(k), np.int64)
        np.add.at(n, inv, np.frombuffer(b"".join(pdf["b"]), np.int64))
        k, n = k[n > 0], n[n > 0]
        return pd.DataFrame({"part": [int(pdf["part"].iloc[0])], "keys": [k.tobytes()], "counts": [n.tobytes()],
                             "types": [len(k)], "tokens": [int(n.sum())], "n1": [int((n == 1).sum())],
                             "n2": [int((n == 2).sum())]})

    vocab = scratch.save(settle(asked, sum_counts, "part int, keys binary, counts binary, types long, tokens long, "
                                                   "n1 long, n2 long"), "vocabulary")
    n_train, n1, n2 = (x or 0 for x in vocab.agg(F.sum("tokens"), F.sum("n1"), F.sum("n2")).first())

    # core words: at most CORE_SHARE of them can have this share of the tokens
    least = max(2, -(-n_train // CORE_SHARE))

    def frequent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a, b in zip(pdf["keys"], pdf["counts"], strict=True):
                k, n = np.frombuffer(a, U), np.frombuffer(b, np.int64)
                keep = (n >= least) & (k != U(END_KEY))
                yield pd.DataFrame({"key": k[keep].astype(np.int64), "n": n[keep]})

    core = vocab.select("keys", "counts").mapInPandas(frequent, "key long, n long").toPandas()
    core_keys, core_n = core["key"].to_numpy(np.int64).astype(U), core["n"].to_numpy(np.int64)
    order = np.lexsort((core_keys, -core_n))
    own = min(CLASSES // 2, len(order))
    start = np.empty(len(order), np.int64)
    start[order[:own]] = 1 + np.arange(own) % (CLASSES - 1)
    free = CLASSES - 1 - CLASSES // 2
    start[order[own:]] = 1 + CLASSES // 2 + (core_keys[order[own:]] % U(free)).astype(np.int64)
    by_key = np.argsort(core_keys)
    core_keys, cls = core_keys[by_key], start[by_key]

    classes, pairs = _exchange(spark, chunks, core_keys, cls, scratch) if len(core_keys) else (cls, None)
    lut = sc.broadcast((core_keys, classes))

    # the other words, once: the classes beside all their places meet by key range
    def ask_classes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for c in _chunks(batches):
            local = _core_classes(c.keys, *lut.value)
            t = c.training()
            n = np.bincount(t, minlength=len(c.keys))
            seq = local[t]
            prev, nxt = np.r_[END, seq[:-1]], np.r_[seq[1:], END]
            order, ends = by_part(c.keys, parts)
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            at = np.flatnonzero(seq == REST)
            at = at[np.argsort(rank[t[at]], kind="stable")]
            left, right = prev[at].astype(np.uint8), nxt[at].astype(np.uint8)
            places = np.r_[0, np.cumsum(np.where(local == REST, n, 0)[order])]
            out, lo = [], 0
            for p, hi in enumerate(ends.tolist()):
                if hi > lo:
                    some, beside = order[lo:hi], slice(places[lo], places[hi])
                    out.append((c.chunk, p, c.keys[some].tobytes(), n[some].tobytes(),
                                local[some].astype(np.uint8).tobytes(), left[beside].tobytes(), right[beside].tobytes()))
                lo = hi
            yield pd.DataFrame(out, columns=["chunk", "part", "a", "b", "c", "left", "right"])

    scratch.drop("counts")
    asked = scratch.save(chunks.mapInPandas(
        ask_classes, "chunk long, part int, a binary, b binary, c binary, left binary, right binary"), "neighbours")

    def settle_classes(pdf: pd.DataFrame) -> pd.DataFrame:
        k, inv = np.unique(np.frombuffer(b"".join(pdf["a"]), U), return_inverse=True)
        n, now = np.frombuffer(b"".join(pdf["b"]), np.int64), np.frombuffer(b"".join(pdf["c"]), np.uint8)
        count = np.zeros(len(k), np.int64)
        np.add.at(count, inv, n)
        cls = np.empty(len(k), np.uint8)
        cls[inv] = now
        other = cls == REST
        if pairs is None:
            cls[other] = 1
        else:
            number = np.cumsum(other) - 1
            word = np.repeat(number[inv], np.where(now == REST, n, 0))
            cls[other] = joined_classes(word, np.frombuffer(b"".join(pdf["left"]), np.uint8),
                                        np.frombuffer(b"".join(pdf["right"]), np.uint8), int(other.sum()), pairs)
        seen = count > 0
        out, at = [], 0
        for chunk, part, a in zip(pdf["chunk"], pdf["part"], pdf["a"], strict=True):
            i = inv[at:at + len(a) // 8]
            out.append((chunk, part, count[i].tobytes(), cls[i].tobytes()))
            at += len(a) // 8
        sums = np.stack([np.bincount(cls[seen], count[seen], N_CLASS), np.bincount(cls[seen], None, N_CLASS)])
        out.append((-1, int(pdf["part"].iloc[0]), sums.astype(np.int64).tobytes(), None))
        return pd.DataFrame(out, columns=["chunk", "part", "counts", "classes"])

    answers = scratch.save(settle(asked, settle_classes, "chunk long, part int, counts binary, classes binary"),
                           "answers")
    # one small row per key range
    sums = [np.frombuffer(r[0], np.int64).reshape(2, N_CLASS)
            for r in answers.where("chunk = -1").select("counts").toLocalIterator()]
    tokens, types = np.sum(sums, axis=0) if sums else np.zeros((2, N_CLASS), np.int64)
    answers = answers.where("chunk >= 0")

    def words(row, ans: pd.DataFrame) -> tuple[_Chunk, np.ndarray, np.ndarray]:
        c = _Chunk(row.iloc[0])
        order, _ = by_part(c.keys, parts)
        ans = ans.sort_values("part")
        count, cls = np.empty(len(c.keys), np.int64), np.empty(len(c.keys), np.int64)
        count[order] = np.frombuffer(b"".join(ans["counts"]), np.int64)
        cls[order] = np.frombuffer(b"".join(ans["classes"]), np.uint8)
        return c, count, cls

    def transitions(key, row: pd.DataFrame, ans: pd.DataFrame) -> pd.DataFrame:
        if not len(row):
            return pd.DataFrame([], columns=["code", "n"])
        c, _, cls = words(row, ans)
        seq = cls[c.training()]
        n = np.bincount(np.r_[END, seq[:-1]] * N_CLASS + seq, minlength=N_CLASS ** 2) if len(seq) else np.zeros(1, int)
        at = np.flatnonzero(n)
        return pd.DataFrame({"code": at, "n": n[at]})

    final = np.zeros(N_CLASS ** 2)
    for r in with_answers(chunks, answers, transitions, "code long, n long").groupBy("code").agg(F.sum("n")).collect():
        final[r[0]] = r[1]
    model = sc.broadcast(Model(final.reshape(N_CLASS, N_CLASS), tokens, types, n1, n2))

    def scores(key, row: pd.DataFrame, ans: pd.DataFrame) -> pd.DataFrame:
        cols = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        if not len(row):
            return pd.DataFrame([], columns=cols)
        c, count, cls = words(row, ans)
        base, score = model.value.score(cls[c.toks], count[c.toks], c.lens)
        first = np.r_[0, np.cumsum(c.lens)[:-1]]
        known = np.add.reduceat((count[c.toks] > 0).astype(np.int64), first)
        ids = pd.Series(c.ids, dtype="Int64").mask(c.no_id)
        return pd.DataFrame({"doc_id": ids, "held_out": c.held, "n_tokens": c.lens, "n_known": known,
                             "train_tokens": model.value.n, "base_score": base, "score": score}, columns=cols)

    out = with_answers(chunks, answers, scores, "doc_id long, held_out boolean, n_tokens long, n_known long, "
                                                "train_tokens long, base_score double, score double")
    out = scratch.save(out, "scores", keep=True)
    scratch.close()
    return out


def _core_classes(keys: np.ndarray, core: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Class of each word of a chunk: its core class, REST, or END."""
    out = np.full(len(keys), REST, np.int64)
    if len(core):
        at = np.minimum(np.searchsorted(core, keys), len(core) - 1)
        hit = core[at] == keys
        out[hit] = classes[at[hit]]
    out[END] = END
    return out


def _exchange(spark, chunks: DataFrame, core: np.ndarray, classes: np.ndarray,
              scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """Rounds of exchange over the core words until they converge: the best
    classes seen and their class bigrams."""
    sc = spark.sparkContext
    best, best_pairs, best_fit = classes, None, -np.inf
    rows_of = 256
    width = rows_of * N_CLASS
    step, parts, fits, found_at = 0, 2, [], 0
    while True:
        sent = sc.broadcast((core, classes))

        def neighbours(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            keys, cls = sent.value
            n = len(keys)
            left, right = np.zeros(n * N_CLASS, np.int64), np.zeros(n * N_CLASS, np.int64)
            pairs = np.zeros(N_CLASS ** 2, np.int64)
            for c in _chunks(batches):
                t = c.training()
                if not len(t):
                    continue
                at = np.minimum(np.searchsorted(keys, c.keys), n - 1)
                number = np.where(keys[at] == c.keys, at, -1)
                number[END] = -1
                seq = _core_classes(c.keys, keys, cls)[t]
                prev, nxt = np.r_[END, seq[:-1]], np.r_[seq[1:], END]
                w = number[t]
                on = w >= 0
                left += np.bincount(w[on] * N_CLASS + prev[on], minlength=len(left))
                right += np.bincount(w[on] * N_CLASS + nxt[on], minlength=len(right))
                pairs += np.bincount(prev * N_CLASS + seq, minlength=len(pairs))
            # cells that are not zero, a side and a block of words to a row
            out = []
            for b in range(-(-n // rows_of)):
                for side, cells in enumerate((left, right)):
                    part = cells[b * width:(b + 1) * width]
                    at = np.flatnonzero(part)
                    if len(at):
                        out.append((b, side, at.astype(np.int32).tobytes(), part[at].tobytes(), None, None))
            # the class bigrams cell by cell, for Spark to add up
            out += [(None, None, None, None, int(c), int(pairs[c])) for c in np.flatnonzero(pairs)]
            pdf = pd.DataFrame(out, columns=["block", "side", "cells", "counts", "code", "n"])
            yield pdf.astype({"block": "Int32", "side": "Int32", "code": "Int32", "n": "Int64"})

        cells = scratch.save(chunks.mapInPandas(
            neighbours, "block int, side int, cells binary, counts binary, code int, n long"), f"pass{step}")
        pairs = np.zeros(N_CLASS ** 2)
        for code, n in cells.where("code is not null").groupBy("code").agg(F.sum("n")).collect():
            pairs[code] = n
        pairs = pairs.reshape(N_CLASS, N_CLASS)
        fit = likelihood(pairs)
        fits.append(fit)
        if fit > best_fit:
            best, best_pairs, best_fit, found_at = classes, pairs, fit, step
        if step >= parts and abs(fit - fits[step - parts]) <= CONVERGED * abs(fit):
            break
        if step - found_at >= 2 * parts:  # two sweeps without a better assignment
            parts, found_at = 2 * parts, step

        moving = sc.broadcast((classes, pairs))

        def add_and_move(pdf: pd.DataFrame) -> pd.DataFrame:
            block = int(pdf["block"].iloc[0])
            now = moving.value[0][block * rows_of:(block + 1) * rows_of]
            sums = np.zeros((2, len(now) * N_CLASS), np.int64)
            for side, at, c in zip(pdf["side"], pdf["cells"], pdf["counts"], strict=True):
                sums[side, np.frombuffer(at, np.int32)] += np.frombuffer(c, np.int64)
            left, right = sums.reshape(2, len(now), N_CLASS).astype(float)
            return pd.DataFrame({"block": [block], "cls": [best_classes(left, right, now, moving.value[1]).astype(np.uint8).tobytes()]})

        moved = cells.where("block is not null").select("block", "side", "cells", "counts").groupBy("block").applyInPandas(
            add_and_move, "block int, cls binary").toPandas()
        # a block without any neighbour stays as it is
        new = classes.copy()
        for b, got in zip(moved["block"], moved["cls"], strict=True):
            new[b * rows_of:(b + 1) * rows_of] = np.frombuffer(got, np.uint8)
        # a part of the words moves at a time, so that neighbours don't chase each other
        turn = (core >> U(17)) % U(parts) == U(step % parts)
        classes = np.where(turn | (step == 0), new, classes)
        scratch.drop(f"pass{step}")
        step += 1
    return best, best_pairs
