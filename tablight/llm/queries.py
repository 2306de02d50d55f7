"""One query per operator over the test tables, and SQL twins where SQL can
express the result.  Each applies its operator with production parameters to
the whole table and derives the digest columns from the operator's output."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablight.llm import (bpe, brown, chat, decontaminate, merkle, minhash, mixture, repeats, resample, secrets, tokens,
                          topk, toxicity)
from tablight.llm.common import crc32_mod, tbl

Query = Callable[[SparkSession, str], DataFrame]
TOKENIZER = "piece_bpe_32k.model"
WORD_TOKENIZER = "word_bpe_49k.json"


def op1_brown_scoring(spark: SparkSession, d: str) -> DataFrame:
    return brown.score_documents(tbl(spark, d, "documents"), crc32_mod("doc_id", 7) == 2)


def op2_token_counts(spark: SparkSession, d: str) -> DataFrame:
    return tokens.count_tokens(tbl(spark, d, "documents"), public_tokenizers.path(TOKENIZER))


def op3_source_mixing(spark: SparkSession, d: str) -> DataFrame:
    docs, _ = mixture.mix(tbl(spark, d, "documents"))
    return docs.select("doc_id", "size", "source_size", "target", "taken")


def op4_minhash_dedup(spark: SparkSession, d: str) -> DataFrame:
    return minhash.near_duplicates(tbl(spark, d, "documents"))


def op5_decontamination(spark: SparkSession, d: str) -> DataFrame:
    return decontaminate.leaks(tbl(spark, d, "documents"), tbl(spark, d, "benchmark"))


def op6_exact_topk(spark: SparkSession, d: str) -> DataFrame:
    e = tbl(spark, d, "embeddings").where(topk.usable("embedding"))
    e = e.where("vec_id is not null").select("vec_id", topk.quantised("embedding").alias("v"))
    return topk.top_k(e, e.where("vec_id % 20 = 0"), k=20)


def op7_repeat_removal(spark: SparkSession, d: str) -> DataFrame:
    return repeats.remove_repeats(tbl(spark, d, "documents")).drop("cut")


def op8_secret_scan(spark: SparkSession, d: str) -> DataFrame:
    found = secrets.scan_secrets(tbl(spark, d, "documents"), redacted=False)
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(
        ":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("secret_base", lambda x: x["kind"] == kind)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in secrets.KINDS],
                        F.sha2(joined("secret_base").cast("binary"), 256).alias("base_sha256"),
                        joined("secret_spans").alias("spans"), "n_left_packed")


def op9_toxicity(spark: SparkSession, d: str) -> DataFrame:
    docs = tbl(spark, d, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, tbl(spark, d, "labels")))
    return scored.select("doc_id", F.coalesce(crc32_mod("doc_id", toxicity.FOLDS) == 0, F.lit(False)).alias("held_out"),
                         F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def op10_chat_format(spark: SparkSession, d: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                F.lit(said).alias("text"))
    rows = tbl(spark, d, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.read_back(chat.prefix_target_examples(rows))


def op11_bpe_round_trip(spark: SparkSession, d: str) -> DataFrame:
    coded = bpe.encode(tbl(spark, d, "documents"), public_tokenizers.path(WORD_TOKENIZER), decode=True)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256)
                        .alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op12_importance_resampling(spark: SparkSession, d: str) -> DataFrame:
    return resample.resample(tbl(spark, d, "documents"), tbl(spark, d, "benchmark"))


def op13_merkle_manifest(spark: SparkSession, d: str) -> DataFrame:
    third = F.coalesce(crc32_mod("doc_id", 3) == 0, F.lit(False))
    tampered = F.when(third, merkle.lowered(F.col("text"))).otherwise(F.col("text"))
    return merkle.verify(merkle.manifest(tbl(spark, d, "documents"), "lang", tampered))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_brown_scoring, op2_token_counts, op3_source_mixing, op4_minhash_dedup, op5_decontamination, op6_exact_topk,
    op7_repeat_removal, op8_secret_scan, op9_toxicity, op10_chat_format, op11_bpe_round_trip,
    op12_importance_resampling, op13_merkle_manifest)}

#: CRC-32 (before the last complement) of a list of bytes, bit by bit.
CRC32_SQL = """list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {bytes}), lambda crc, b: list_reduce(
    list_prepend(xor(crc, b), [CAST(0 AS BIGINT) FOR j IN generate_series(1, 8)]),
    lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END))"""

ORACLE: dict[str, str] = {
    "op6_exact_topk": """
WITH v AS (SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
             AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([a[1] * a[2] FOR a IN list_zip(q.v, c.v)]) AS BIGINT) AS score
      FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20""",
    "op10_chat_format": """
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, 23
        + length(replace(replace(replace(replace(replace(regexp_replace(role, '&(amp|lt|lb);', '&amp;\\1;', 'g'),
          '<|', '&lt;|'), '<s>', '&lt;s>'), '</s>', '&lt;/s>'), '[INST]', '&lb;INST]'), '[/INST]', '&lb;/INST]'))
        + length(replace(replace(replace(replace(replace(regexp_replace(text, '&(amp|lt|lb);', '&amp;\\1;', 'g'),
          '<|', '&lt;|'), '<s>', '&lt;s>'), '</s>', '&lt;/s>'), '[INST]', '&lb;INST]'), '[/INST]', '&lb;/INST]')) AS w
      FROM t),
p AS (SELECT *, sum(w) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS upto,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS back FROM e)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(upto) FILTER (role = 'assistant' OR back = 1) AS BIGINT) AS formatted_chars
FROM p GROUP BY conv_id""",
    "op12_importance_resampling": """
WITH w AS (SELECT doc_id, rowid AS r, unnest(regexp_extract_all(translate(coalesce(text, ''),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word
           FROM (SELECT *, row_number() OVER () AS rowid FROM documents)),
b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word
      FROM benchmark),
v AS (SELECT word, xor(CRC_OF_BYTES, 4294967295) % 10000 AS bucket
      FROM (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM w UNION SELECT word FROM b))),
s AS (SELECT bucket, count(*) AS s FROM w JOIN v USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM b JOIN v USING (word) GROUP BY bucket),
g AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * ((SELECT sum(s) FROM s)::DOUBLE + 10000)
        / ((s::DOUBLE + 1) * (coalesce((SELECT sum(t) FROM t), 0)::DOUBLE + 10000)))) AS BIGINT) AS gain
      FROM s LEFT JOIN t USING (bucket)),
d AS (SELECT r, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS weight
      FROM w JOIN v USING (word) JOIN g USING (bucket) GROUP BY r),
x AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8)
          AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
      FROM (SELECT *, row_number() OVER () AS r FROM documents) LEFT JOIN d USING (r)),
k AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20
               ORDER BY score DESC, doc_id NULLS LAST) END AS place FROM x)
SELECT doc_id, n_features, weight, score,
       CASE WHEN place <= (SELECT 10 * count(*) // 100 FROM x WHERE n_features >= 20) THEN place END AS rank
FROM k""".replace("CRC_OF_BYTES", CRC32_SQL.format(
        bytes="[CAST('0x' || substr(h, CAST(i AS BIGINT), 2) AS BIGINT) FOR i IN generate_series(1, length(h), 2)]")),
    "op13_merkle_manifest": """
WITH RECURSIVE d AS (SELECT *, row_number() OVER () AS row,
    coalesce(xor(CRC_OF_BYTES, 4294967295) % 3 = 0, false) AS third,
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents),
f AS (SELECT row, doc_id, lang, third,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS own, coalesce(strlen(low) || ':' || low, '-') AS lowered FROM d),
leaves AS (SELECT row, doc_id, lang, leaf, changed,
             row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, row) - 1 AS pos,
             count(*) OVER (PARTITION BY lang) AS n
           FROM (SELECT *, sha256(head || own) AS leaf, sha256(head || CASE WHEN third THEN lowered ELSE own END) AS changed
                 FROM f)),
langs AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) AS g FROM (SELECT DISTINCT lang FROM documents)),
nodes AS (SELECT g, 0 AS lvl, pos, leaf AS h, n FROM leaves JOIN langs ON leaves.lang IS NOT DISTINCT FROM langs.lang
    UNION ALL SELECT g, lvl + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 7) // 8
    FROM nodes WHERE n > 1 GROUP BY g, lvl, pos // 8),
tops AS (SELECT 0 AS lvl, g - 1 AS pos, h, (SELECT count(*) FROM langs) AS n FROM nodes WHERE n = 1
    UNION ALL SELECT lvl + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 7) // 8
    FROM tops WHERE n > 1 GROUP BY lvl, pos // 8),
every AS (SELECT g, lvl, pos, h, n FROM nodes UNION ALL SELECT 0 AS g, lvl, pos, h, n FROM tops),
flanks AS (SELECT a.g, a.lvl, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l,
             coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
           FROM every a JOIN every b ON a.g = b.g AND a.lvl = b.lvl AND a.pos // 8 = b.pos // 8
           WHERE a.n > 1 GROUP BY a.g, a.lvl, a.pos),
path AS (SELECT row, g AS home, g, 0 AS lvl, pos, changed AS h, '' AS proof
      FROM leaves JOIN langs ON leaves.lang IS NOT DISTINCT FROM langs.lang
    UNION ALL SELECT row, home, k.g, CASE WHEN f.g IS NULL THEN 0 ELSE k.lvl + 1 END,
      CASE WHEN f.g IS NULL THEN home - 1 ELSE k.pos // 8 END, CASE WHEN f.g IS NULL THEN k.h ELSE sha256(f.l || k.h || f.r) END,
      CASE WHEN f.g IS NULL THEN k.proof ELSE k.proof || f.l || f.r END
    FROM (SELECT p.row, p.home, CASE WHEN e.n = 1 THEN 0 ELSE p.g END AS g, p.lvl, p.pos, p.h, p.proof, p.g AS was, e.n
          FROM path p JOIN every e ON p.g = e.g AND p.lvl = e.lvl AND p.pos = e.pos) k
      LEFT JOIN flanks f ON k.was = f.g AND k.lvl = f.lvl AND k.pos = f.pos
    WHERE k.n > 1 OR k.was > 0),
done AS (SELECT p.row, p.h AS folded_root, p.proof FROM path p JOIN tops t ON p.g = 0 AND p.lvl = t.lvl AND t.n = 1)
SELECT doc_id, leaf, s.h AS subroot, t.h AS root, sha256(proof) AS proof_sha256, folded_root, folded_root = t.h AS verified
FROM leaves JOIN langs ON leaves.lang IS NOT DISTINCT FROM langs.lang JOIN nodes s ON s.g = langs.g AND s.n = 1
     JOIN done USING (row) JOIN tops t ON t.n = 1""".replace("CRC_OF_BYTES", CRC32_SQL.format(
        bytes="[CAST(ord(c) AS BIGINT) FOR c IN string_split(doc_id::VARCHAR, '')]")),
}


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
