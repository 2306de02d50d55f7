"""The text operators against brute force on the smallest tables, and their
defined results on nulls, empty and repeated rows, empty tables and clashing
columns."""
import base64
import bz2
import collections
import gzip
import hashlib
import lzma
import math
import urllib.parse
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from tablight.llm import brown, chat, decontaminate, minhash, mixture, queries, repeats, secrets, tokens, topk, toxicity
from tablight.llm.common import crc32_mod
from tests.conftest import SF

MODEL = public_tokenizers.path(queries.TOKENIZER)
COPY = "one two three four five six seven eight nine ten eleven twelve thirteen"
ODD = [(1, COPY, "a"), (2, COPY, "a"), (2, COPY, "a"), (3, None, None), (4, "", "b"), (5, " \t\n", "b"),
       (6, "Two words", None), (None, COPY, "c"), (7, "x" * 40_000 + " y" * 300, "a"),
       (8, "ab " * 20_000 + "äöü 日本語 \U0001F600", "c"), (9, "short", "c")]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string, source string")
    # columns whose names the operators use inside
    return df.withColumns({c: F.lit(1) for c in ("size", "node", "chunk", "data", "id", "bucket", "word", "rank")})


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def plain(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


def words(text):
    return text.encode().lower().split()


def test_brown_counts_and_normalisation(docs, plain):
    got = {r.doc_id: r for r in brown.score_documents(docs, crc32_mod("doc_id", 7) == 2).collect()}
    c = collections.Counter()
    for i, t in plain.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            c.update([*words(t), b""])
    n, v = sum(c.values()), len(c)
    for i, t in plain.items():
        w = [*words(t), b""]
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(w), sum(c[x] > 0 for x in w), n)
        assert got[i].base_score == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w))
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_brown_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    cls = np.r_[0, rng.integers(1, 6, 40)]
    count = np.r_[30, rng.integers(1, 20, 40)]
    pairs = np.zeros((brown.N_CLASS, brown.N_CLASS))
    pairs[:6, :6] = rng.integers(0, 9, (6, 6))
    m = brown.Model(pairs, np.bincount(cls, count, brown.N_CLASS), np.bincount(cls, None, brown.N_CLASS), 5, 3)
    for context in range(41):
        total = 0.0
        for w in range(42):  # the last one is unknown
            c, n = (cls[w], count[w]) if w < 41 else (0, 0)
            two = m.score(np.array([cls[context], c]), np.array([count[context], n]), np.array([2]))[1][0]
            one = m.score(np.array([cls[context]]), np.array([count[context]]), np.array([1]))[1][0]
            total += 10 ** (two - one)
        assert total == pytest.approx(1.0)


def test_brown_odd_rows(odd, none):
    rows = brown.score_documents(odd, crc32_mod("doc_id", 7) == 2).collect()
    assert len(rows) == len(ODD) and all(math.isfinite(r.score) for r in rows)
    assert [r.n_tokens for r in rows if r.doc_id == 3] == [1]
    assert brown.score_documents(none, F.lit(False)).count() == 0
    nothing = brown.score_documents(odd, F.lit(True)).collect()
    assert all(r.train_tokens == 0 and r.score == r.base_score for r in nothing)


@pytest.mark.parametrize("chunk, overlap", [(500, 16), (32_768, 256)])
def test_token_counts(docs, plain, odd, chunk, overlap):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for frame, texts in ((docs, list(plain.values())), (odd, [t or "" for _, t, _ in ODD])):
        got = sorted((r.n_bytes, r.n_tokens) for r in tokens.count_tokens(frame, MODEL, chunk, overlap).collect())
        assert got == sorted((len(t.encode()), len(sp.encode(t))) for t in texts)


def test_token_counts_empty(none):
    assert tokens.count_tokens(none, MODEL).count() == 0


def test_mixing(docs, odd, none):
    for frame in (docs, odd):
        got = mixture.mix(frame)[0].toPandas()
        assert len(got) == frame.count() and (got["taken"] <= 2 * got["size"]).all()
        per = got.groupby("source", dropna=False).agg(size=("size", "sum"), target=("target", "first"),
                                                      taken=("taken", "sum")).reset_index()
        # water filling by rounds
        per = per.sort_values("source", na_position="last")
        w = np.array([(3, 1, 2)[i % 3] for i in range(len(per))], float)
        cap, want, open_ = 2.0 * per["size"].to_numpy(), np.zeros(len(per)), np.ones(len(per), bool)
        rest = 1.5 * per["size"].sum()
        while rest > 1e-6 and open_.any():
            want[open_] += rest * w[open_] / w[open_].sum()
            rest = np.maximum(want - cap, 0).sum()
            want, open_ = np.minimum(want, cap), want < cap - 1e-9
        assert per["target"].to_numpy() == pytest.approx(want)
        assert (np.abs(per["taken"] - per["target"]) <= 0.03 * per["target"] + 64).all()
    again = mixture.mix(docs.repartition(5))[0].select("doc_id", "taken")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, mixture.mix(docs)[0].select("doc_id", "taken").collect()))
    assert mixture.mix(none)[0].count() == 0


def test_permutation_is_one():
    n = np.full(1000, 1000)
    got = mixture.permuted(np.arange(1000), n, np.full(1000, 7, np.uint64))
    assert sorted(got) == list(range(1000)) and list(got[:5]) != list(range(5))


def brute_components(rows):
    sets = []
    for i, t in rows:
        w = words(t or "")
        sets.append((i, frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()))
    up = {i: i for i, _ in sets if i is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if i is not None and j is not None and x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = find(i), find(j)
                up[max(p, q)] = min(p, q)
    return sorted(((i, len(x), find(i) if i is not None else None) for i, x in sets), key=str)


def test_near_duplicates(docs, plain, odd, none, spark):
    for frame, rows in ((docs, list(plain.items())), (odd, [(i, t) for i, t, _ in ODD])):
        got = minhash.near_duplicates(frame).collect()
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_components(rows)
    assert minhash.near_duplicates(none).count() == 0
    # a large group without a common neighbour: a chain of small changes
    base = [f"w{i}" for i in range(200)]
    chain = [(k, " ".join([f"c{j}" if j * 7 < k * 7 and j < k else base[j] for j in range(200)])) for k in range(40)]
    got = minhash.near_duplicates(spark.createDataFrame(chain, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_components(chain)


def test_decontamination(spark, odd, none):
    rng = np.random.default_rng(3)
    vocab = [f"word{i}" for i in range(400)]
    text = lambda n: [vocab[i] for i in rng.integers(0, 400, n)]
    item = text(30)
    changed = list(item)
    for k in (4, 13, 22):
        changed[k] = "other"
    rows = [(0, " ".join(text(80) + item + text(80))), (1, " ".join(text(200))), (2, " ".join(text(50) + changed)),
            (3, "; ".join(text(9)) + ". " + ", ".join(item[5:25]).upper()), (4, " ".join(item[:7])), (5, None), (6, "")]
    bench = spark.createDataFrame([(7, " ".join(item)), (9, " ".join(item)), (8, None), (None, "x"), (10, "too short")],
                                  "item_id long, text string")
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = decontaminate.leaks(d, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(0, 7), (2, 7), (3, 7)}
    assert {r.doc_id for r in decontaminate.decontaminate(d, bench).collect()} == {1, 4, 5, 6}
    assert decontaminate.leaks(none, bench).count() == 0 == decontaminate.leaks(odd, bench.where("false")).count()
    plan = decontaminate.leaks(d, bench)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_top_k(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 12) / 8]) for i in range(90)]
    rows += [(90, None), (91, [1.0, None]), (92, [float("nan")] * 12), (93, []), (None, rows[0][1]), (94, [1.0, 2.0]),
             (5, rows[5][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("block", F.lit(0))
    e = df.where(topk.usable("embedding")).where("vec_id is not null").select(
        "vec_id", topk.quantised("embedding").alias("v"))
    got = collections.defaultdict(list)
    for r in topk.top_k(e, e.where("vec_id % 5 = 0"), k=7).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    full = [(i, np.floor(64 * np.array(v))) for i, v in rows[:90] + [rows[-1]]]
    for i, v in full[:90:5]:
        every = sorted((-int(v @ w), j) for j, w in full if j != i)
        assert got[i] == [(j, -s) for s, j in every[:7]]
    assert topk.top_k(e.where("false"), e.where("false")).count() == 0


def brute_repeats(rows):
    first = {}
    data = [(2**63 if i is None else i, i, (t or "").encode()) for i, t in rows]
    for i, _, x in data:
        for p in range(len(x) - 49):
            first[x[p:p + 50]] = min(i, first.get(x[p:p + 50], i))
    out = []
    for i, shown, x in data:
        cover = np.zeros(len(x), bool)
        for p in range(len(x) - 49):
            if first[x[p:p + 50]] < i:
                cover[p:p + 50] = True
        kept = bytes(b for b, c in zip(x, cover) if not c)
        spans = int((np.diff(np.r_[0, cover.astype(int)]) == 1).sum())
        out.append((shown, len(x), int(cover.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_repeats(docs, plain, odd, none, monkeypatch):
    monkeypatch.setattr(repeats, "SLICE", 3000)
    for frame, rows in ((docs.where("doc_id < 120"), [(i, t) for i, t in plain.items() if i < 120]),
                        (odd, [(i, t) for i, t, _ in ODD])):
        got = repeats.remove_repeats(frame).collect()
        assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got),
                      key=str) == brute_repeats(rows)
    assert repeats.remove_repeats(none).count() == 0


def test_repeats_first_seen_across_two_reaches(spark):
    """Windows that two reaches of smaller documents cover together, but that
    no smaller document holds, are the first of their kind."""
    rng = np.random.default_rng(7)
    text = lambda n: "".join(chr(97 + x) for x in rng.integers(0, 26, n))
    rows = []
    for k in range(0, 160, 4):
        a, b, c, d, s, p, q = text(200), text(200), text(200), text(200), text(30), text(200), text(200)
        rows += [(k + 1, a + s + c), (k + 2, d + s + b), (k + 3, a + s + b), (k + 4, p + a[-15:] + s + b[:15] + q)]
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert min(r.n_removed for r in got if r.doc_id % 4 == 0) >= 60
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got),
                  key=str) == brute_repeats(rows)


def test_secret_layers(spark, odd, none):
    raw = "password=hunter2abc"
    b64 = lambda b: base64.b64encode(b).decode()
    cases = {
        raw: 1, "api_key: short": 0, "AKIA" + "A1" * 8: 1, "deadbeef" * 3: 1, "token: token: abcdef": 0,
        "see " + urllib.parse.quote("secret: x1y2z3w4", safe="") + " end": 1,
        "see " + b64(raw.encode()) + " end": 1,
        "see " + b64(gzip.compress(raw.encode())) + " end": 1,
        "see " + b64(urllib.parse.quote(b64(zlib.compress(raw.encode())), safe="").encode()) + " end": 1,
        "see " + "".join(f"\\u{ord(c):04x}" for c in raw) + " end": 1, "%41%zz 100% \\u12": 0}
    for text, n in cases.items():
        base, spans, _ = secrets.findings(text)
        assert (len(spans) >= 1) == (n == 1), text
        assert set(base) <= set(spans)
        if text.startswith("see "):
            assert not base and all(4 <= a < b <= len(text) - 4 for a, _, b in spans)
    d = spark.createDataFrame([(1, raw + " x"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in secrets.scan_secrets(d).collect()}
    assert got[1].redacted == "[REDACTED] x" and got[2].redacted is None
    assert secrets.scan_secrets(odd).count() == len(ODD) and secrets.scan_secrets(none).count() == 0


def one_secret(shown):
    """Whether the secret is found, inside the token only and with nothing left unread."""
    text = "see " + shown + " end"
    base, spans, left = secrets.findings(text)
    return not base and bool(spans) and left == 0 and all(4 <= a < b <= len(text) - 4 for a, _, b in spans)


def test_secrets_in_streams(spark, monkeypatch):
    raw, b64 = b"password=hunter2abc", lambda b: base64.b64encode(b).decode()
    noise = bytes(np.random.default_rng(1).integers(33, 127, 600, np.uint8))
    long = noise + b"\n" + raw + b"\n" + noise[::-1]
    for tool in (gzip, bz2, lzma):
        for other in (gzip, bz2, lzma):
            assert one_secret(b64(tool.compress(other.compress(raw))))
        assert one_secret(b64(tool.compress(b"nothing here") + tool.compress(raw)))
        assert one_secret(b64(tool.compress(b"x password=hun") + tool.compress(b"ter2abc")))
    for tool in (gzip, lzma):
        assert one_secret(b64(tool.compress(long)[:-40]))
    assert one_secret(b64(gzip.compress(long)[:-40] + b"\xff" * 40))
    monkeypatch.setattr(secrets, "MAX_LAYER", 1 << 12)
    bomb = "see " + b64(gzip.compress(raw + b" 0" * 10_000)) + " end"
    base, spans, left = secrets.findings(bomb)
    assert not base and spans and left == 1
    assert secrets.findings("see " + b64(gzip.compress(b"0 " * 10_000 + raw)))[2] == 1
    assert "n_left_packed" in queries.op8_secret_scan(spark, SF).columns


def test_secrets_in_any_bytes():
    raw, b64 = "password=hunter2abc", lambda b: base64.b64encode(b).decode()
    for before in ("\u00a0", "\ufeff", "a\u200d", "a\0b ", "\x1b[0m"):
        assert one_secret(b64((before + raw).encode())), ascii(before)
    for code in ("utf-16-le", "utf-16-be", "utf-32-le"):
        assert one_secret(b64(raw.encode(code))) and one_secret(b64(b"Z" + raw.encode(code)))
    assert one_secret(b64(("caf\xe9 " + raw).encode("latin-1")))
    assert one_secret(b64(bytes(range(128, 256)) + raw.encode() + bytes(range(256))))
    assert one_secret("".join(f"%{b:02x}" for b in ("\xe9 " + raw).encode("latin-1")))
    token, packed = b64(raw.encode()), b64(gzip.compress(raw.encode()))
    for before in ("/api/", "a_b-", "/api/v1/x/", "data", "/"):
        assert one_secret(before + token) and one_secret(before + packed + "/next"), before
    noise = bytes(np.random.default_rng(1).integers(33, 127, 600, np.uint8))
    long = b64(gzip.compress(noise + b"\n" + raw.encode()))
    for width, end in ((76, "\n"), (64, "\r\n"), (20, "\n    ")):
        assert one_secret(end.join(long[k:k + width] for k in range(0, len(long), width)))


def test_toxicity_pairs_and_bounds():
    """A pair of terms decides, which no additive weight can."""
    rng = np.random.default_rng(0)
    rows, y = [], []
    for k in range(600):
        a, b = k % 2, k // 2 % 2
        w = [b"alpha"] * a + [b"beta"] * b + [b"fill%d" % i for i in rng.integers(0, 30, 8)]
        rows.append(toxicity.terms(b" ".join(w)))
        y.append(float(a and b))
    m = toxicity.fit(rows, np.array(y, np.float32), epochs=20)
    s = {t: m.score(t) for t in (b"alpha fill1", b"beta fill2", b"alpha beta fill3", b"fill4")}
    assert s[b"alpha beta fill3"] > 0.5 > max(v for t, v in s.items() if t != b"alpha beta fill3")


def test_toxicity_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (6, 0), (6, None), (None, 1), (9, 0), (9, 0)], "doc_id long, toxic int")
    for lab in (labels, labels.where("false"), labels.where("toxic = 0")):
        m = toxicity.train(odd, lab)
        got = toxicity.score(odd, m).collect()
        assert len(got) == len(ODD) and all(0 <= r.toxicity <= 1 for r in got)
    assert toxicity.score(none, m).count() == 0


def test_chat(spark):
    said = ["</s>[INST] ok [/INST]", "<|end|>&lt;|end|>", "&amp;lt;", "", None, "a & b <|text|>", "<<|<s>"]
    rows = [(1, i, ("user", "assistant")[i % 2], t) for i, t in enumerate(said)]
    rows += [(2, 0, "user", "only a question"), (None, 1, None, "x"), (3, 0, "assistant", "again"),
             (3, 0, "assistant", "again")]
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("block", F.lit(1))
    ex = chat.prefix_target_examples(c)
    got = {r.conv_id: r for r in chat.read_back(ex).collect()}
    assert set(got) == {1, 2, 3, None}
    for i in got:
        mine = [(r or "", t or "") for x, _, r, t in rows if x == i]
        loss = "".join(t for r, t in mine if r == "assistant")
        assert got[i].n_turns == len(mine)
        assert got[i].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in mine).encode()).hexdigest()
        assert (got[i].loss_chars, got[i].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.read_back(chat.prefix_target_examples(c.where("false"))).count() == 0
    plan = chat.read_back(ex)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_pipeline(spark, docs):
    out = corpus_pipeline.run(spark, SF).collect()
    ids = {r.doc_id for r in out}
    assert ids < {r.doc_id for r in docs.select("doc_id").collect()} and len(ids) == len(out)
    found = minhash.near_duplicates(docs.where(F.col("doc_id").isin(list(ids))))
    assert found.where("not kept").count() == 0
    leaks = decontaminate.leaks(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()
    assert not ids & {r.doc_id for r in leaks}
