"""Operators 11 to 13 against the library, brute force and their defined
results on odd tables."""
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tablight.llm import bpe, merkle, queries, resample
from tests.conftest import SF

WORD_FILE = public_tokenizers.path(queries.WORD_TOKENIZER)
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, "Two WORDS here", "en", "a", 14), (1, "Two WORDS here", "en", "a", 14), (1, "other", "en", "b", 5),
       (None, "no id", None, None, None), (2, None, "fr", "a", None), (3, "", "fr", "a", 0), (4, " \t\n", None, "b", 3),
       (5, "x" * 50_000 + " y" * 20_000, "en", "a", 90_000), (6, "äöü 日本語 \U0001F600 É", "é", "c", 9)]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, COLUMNS)
    return df.withColumns({c: F.lit(1) for c in ("data", "ids", "pos", "grp", "n", "score", "rank", "h", "down", "block",
                                                 "weight", "leaf", "_seq", "_tie")})


def digest(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


# operator 11

def awkward() -> list[str]:
    rng = random.Random(5)
    points = [*range(0, 0x250), *range(0x300, 0x330), 0x1E9E, 0x2028, 0x1680, 0x200B, 0x3A3, 0x130, 0x1F600, 0xAC00, 0x1161]
    drawn = ["".join(chr(rng.choice(points)) for _ in range(150)) for _ in range(60)]
    return drawn + ["", " ", "aaaa aaaaaaa aaa", "it's I'LL DON'T ''s 'S", "<|endoftext|>a<|startoftext|> b<|endoftext",
                    "<|ENDOFTEXT|>", "\x1c\x1d a\x85b \x0b\x0c", "Ǆ ǅ Ⱥ Ω K ẛ̣ ΑΣ İ ß ﬁ Ⅷ ½ ١٢٣", " ́x　y"]


def test_bpe_equals_the_library(spark):
    texts = awkward()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionAll(
        spark.createDataFrame([(-1 - i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    library = Tokenizer.from_file(WORD_FILE)
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    coded = bpe.encode(docs, WORD_FILE, decode=True)
    got = coded.select("*", bpe.decode("ids", WORD_FILE).alias("again")).collect()
    assert len(got) == len(text)
    for r in got:
        want = library.encode(text[r.doc_id], add_special_tokens=False).ids
        assert r.ids == want
        assert r.decoded == r.again == library.decode(want, skip_special_tokens=False)


def test_bpe_slices_and_forgotten_pieces(monkeypatch):
    monkeypatch.setattr(bpe, "SLICE_BYTES", 64)
    vocab = bpe.vocabulary(WORD_FILE)
    library = Tokenizer.from_file(WORD_FILE)
    text = " ".join(awkward()) + " z" * 100
    slices = list(bpe._slices(text.encode()))
    assert b"".join(slices) == text.encode() and len(slices) > 20
    seen, ids = bpe.Pieces(vocab), []
    for s in slices:
        seen.clear()
        cut = s.split()
        seen.learn(cut)
        ids += seen.encoded(cut).tolist()
    assert ids == library.encode(text, add_special_tokens=False).ids


def test_bpe_merges_any_order_of_ranks():
    """A vocabulary whose ranks are not in the order of making."""
    rng = random.Random(1)
    vocab = bpe.vocabulary(WORD_FILE)
    words = [bytes(rng.choice(b"aben") for _ in range(rng.randint(1, 12))) for _ in range(300)]
    ids, lens = vocab.encode_words(words)
    rank = {(int(a), int(b)): (r, int(m)) for r, (a, b, m) in enumerate(zip(vocab.left, vocab.right, vocab.made))}
    at = 0
    for w, n in zip(words, lens, strict=True):
        sym = [int(vocab.inner[b]) for b in w[:-1]] + [int(vocab.final[w[-1]])]
        while True:
            found = [(rank[p], i) for i, p in enumerate(zip(sym, sym[1:])) if p in rank]
            if not found:
                break
            (_, made), i = min(found)
            sym[i:i + 2] = [made]
        assert ids[at:at + n].tolist() == sym
        at += int(n)


def test_bpe_odd_rows(odd):
    got = bpe.encode(odd, WORD_FILE, decode=True).collect()
    assert len(got) == len(ODD)
    assert [len(r.ids) for r in got if r.doc_id in (2, 3, 4)] == [0, 0, 0]
    assert {r.decoded for r in got if r.doc_id in (2, 3, 4)} == {""}
    assert bpe.encode(odd.where("false"), WORD_FILE).count() == 0


# operator 12

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def drawn_by_hand(docs, target, buckets, ngram, min_words, percent, seed):
    grams = lambda w: [" ".join(w[i:i + k]) for k in range(1, ngram + 1) for i in range(len(w) - k + 1)]
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    raw = collections.Counter(bucket(f) for _, t in docs for f in grams(words(t)))
    aim = collections.Counter(bucket(f) for t in target for f in grams(words(t)))
    s, t = sum(raw.values()), sum(aim.values())
    gain = [math.floor(1000 * math.log((aim[b] + 1.0) * (t * 0.0 + s + buckets) / ((raw[b] + 1.0) * (t + buckets))))
            for b in range(buckets)]
    rows = []
    for i, text in docs:
        f = grams(words(text))
        h = int(digest(f"{seed}:{'' if i is None else i}")[:8], 16)
        w = sum(gain[bucket(x)] for x in f)
        rows.append((i, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(text))))
    fit = sorted((r for r in rows if r[4] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    k = percent * len(fit) // 100
    return sorted([(*r[:4], n + 1) for n, r in enumerate(fit[:k])]), collections.Counter(r[:4] for r in rows)


def key(r):
    return tuple((x is None, x or 0) for x in r)


@pytest.mark.parametrize("ngram, percent, limit", [(1, 10, 1 << 16), (1, 37, 3), (2, 50, 10)])
def test_resampling_equals_brute_force(spark, monkeypatch, ngram, percent, limit):
    monkeypatch.setattr(resample, "SORTED", limit)
    monkeypatch.setattr(resample, "SLICE_BYTES", 500)
    monkeypatch.setattr(resample.cutoff, "__defaults__", (limit,))
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    target = spark.read.parquet(f"{SF}/benchmark.parquet").select("text")
    got = [tuple(r) for r in resample.resample(docs, target, 500, ngram, 20, percent, 7).collect()]
    want, every = drawn_by_hand([tuple(r) for r in docs.collect()], [r.text for r in target.collect()],
                                500, ngram, 20, percent, 7)
    assert sorted(r for r in got if r[4] is not None) == want
    assert collections.Counter(r[:4] for r in got) == every


def test_cutoff_brackets(spark):
    rng = np.random.default_rng(3)
    values = [int(v) for v in rng.integers(0, 50, 3000)] + [7] * 4000
    rows = [(v, i % 11, i) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "a long, b long, c long").repartition(5).cache()
    for k in (1, 2, 700, 3500, 5000, 6999, 7000):
        assert tuple(resample.cutoff(df, ["a", "b", "c"], k, len(rows), 20)) == sorted(rows)[k - 1]


def test_resampling_odd_rows(odd):
    target = odd.select("text")
    got = resample.resample(odd, target, min_words=2, percent=100).collect()
    assert len(got) == len(ODD)
    ranks = sorted(r["rank"] for r in got if r["rank"] is not None)
    assert ranks == list(range(1, len(ranks) + 1)) and len(ranks) == 5
    assert {(r.n_features, r.weight) for r in got if r.doc_id in (2, 3, 4)} == {(0, 0)}
    half = [r for r in resample.resample(odd, target, min_words=2, percent=50).collect() if r["rank"] is not None]
    assert sorted(r["rank"] for r in half) == [1, 2]
    assert all(r["rank"] is None for r in resample.resample(odd, target.where("false"), percent=0).collect())
    assert resample.resample(odd.where("false"), target).count() == 0


# operator 13

def tree(leaves):
    """Levels of a tree, lowest first."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([digest("".join(below[i:i + 8])) for i in range(0, len(below), 8)])
    return levels


def siblings(levels, i):
    out = []
    for level in levels[:-1]:
        run = i // 8 * 8
        out.append(("".join(level[run:i]), "".join(level[i + 1:run + 8])))
        i //= 8
    return out


def leaf_by_hand(r, text):
    fields = [r[0], r[3], r[2], r[4], text]
    return digest("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def manifest_by_hand(rows):
    low = lambda t: t and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    groups = collections.defaultdict(list)
    for r in rows:
        changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
        groups[r[2]].append(((r[0] is not None, r[0] or 0, leaf_by_hand(r, r[1])), leaf_by_hand(r, low(r[1]) if changed else r[1]), r[0]))
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([x[0][2] for x in sorted(groups[g], key=lambda x: x[0])]) for g in langs}
    top = tree([trees[g][-1][0] for g in langs])
    out = []
    for at, g in enumerate(langs):
        for i, (order, changed, doc_id) in enumerate(sorted(groups[g], key=lambda x: x[0])):
            path = siblings(trees[g], i) + siblings(top, at)
            h = changed
            for left, right in path:
                h = digest(left + h + right)
            out.append((doc_id, order[2], trees[g][-1][0], top[-1][0], digest("".join(a + b for a, b in path)), h,
                        h == top[-1][0]))
    return out


def manifested(df):
    third = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 0, F.lit(False))
    tampered = F.when(third, merkle.lowered(F.col("text"))).otherwise(F.col("text"))
    return [tuple(r) for r in merkle.verify(merkle.manifest(df, "lang", tampered)).collect()]


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_manifest_equals_brute_force(spark, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "BLOCK", 8 ** levels)
    rows = [(i, f"Text {i}", f"l{(i % 37) ** 2 % 11}" if i % 3 else "hot", "s", i) for i in range(700)]
    rows += [(i, "one leaf", f"single{i}", None, None) for i in range(9)] + ODD
    df = spark.createDataFrame(rows, COLUMNS)
    assert sorted(manifested(df), key=key) == sorted(manifest_by_hand(rows), key=key)


def test_manifest_odd_rows(spark, odd):
    assert sorted(manifested(odd), key=key) == sorted(manifest_by_hand(ODD), key=key)
    assert manifested(odd.where("false")) == []
    only = odd.where("doc_id = 6")
    (row,) = manifested(only)
    assert row[1] == row[2] == row[3] and row[4] == digest("")
    plain = merkle.verify(merkle.manifest(odd)).collect()
    assert all(r.verified for r in plain) and len(plain) == len(ODD)


@pytest.mark.parametrize("name", ["op12_importance_resampling", "op13_merkle_manifest"])
def test_new_operators_equal_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in want.description]
    got = queries.queries()[name](spark, SF).select(*names).collect()
    assert sorted(map(tuple, got), key=key) == sorted(want.fetchall(), key=key)
