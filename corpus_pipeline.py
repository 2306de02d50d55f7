"""A corpus pipeline of five stages over ``documents``.

Toxic documents go, then all but one document of each near-duplicate group,
then documents that hold benchmark passages; secrets are replaced in the texts
of what is left; last, the mix counts how many words of each document it takes.
Each stage gets the documents its predecessor kept and, but for the last,
returns the same columns.  Documents with a null doc_id can't be told apart and
pass the filters; a doc_id that occurs more than once is one document for
near-duplicates, so one of its rows stays.  Null and empty texts pass all
filters; an empty table gives an empty one; texts of any length are read whole;
columns beyond those of ``documents`` come along unchanged, whatever their
names (the last stage returns its own columns only).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablight.llm import decontaminate, minhash, mixture, secrets, toxicity
from tablight.llm.common import Scratch, split_by_ids, tbl


#: Columns that the operators add; columns of the documents with such names step aside meanwhile.
ADDED = {"toxicity", "_found", "secret_base", "secret_spans", "n_left_packed", "redacted"}


def apart(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The documents with clashing columns renamed, and all names to restore."""
    names = {f"its {c}" if c.lower() in ADDED else c: c for c in docs.columns}
    return docs.toDF(*names), names


def restored(docs: DataFrame, names: dict[str, str]) -> DataFrame:
    return docs.select(*[F.col(f"`{c}`").alias(old) for c, old in names.items()])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, tbl(spark, sf_dir, "labels"))
    docs, names = apart(docs)
    return restored(toxicity.score(docs, model).where(F.col("toxicity") < 0.5), names)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(docs).where("doc_id is not null")
    # ids that go, and ids of several rows of which one stays; all other rows stay where they are
    special = found.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("kept").alias("kept"))
    special = Scratch(spark).save(special.where("not kept or n > 1").select("doc_id", "kept"), "special", keep=True)
    away, near = split_by_ids(docs, special)
    keys = special.select(F.col("doc_id").alias("_id of special"), F.col("kept").alias("_kept of special"))
    met = near.join(keys, near["doc_id"] == keys["_id of special"], "left")
    out = away.unionAll(met.where("`_id of special` is null").select(*[near[c] for c in docs.columns]))
    if special.where("kept").isEmpty():
        return out
    several = met.where("`_kept of special`").select(*[near[c] for c in docs.columns])
    return out.unionAll(several.dropDuplicates(["doc_id"]))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, tbl(spark, sf_dir, "benchmark"))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs, names = apart(docs)
    found = secrets.scan_secrets(docs)
    changed = (F.size("secret_spans") > 0) | (F.col("n_left_packed") > 0)
    found = found.withColumn("text", F.col("redacted"))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return restored(found, names)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed, _ = mixture.mix(docs)
    return mixed.select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [("toxicity", drop_toxic), ("minhash_dedup", drop_near_duplicates), ("decontamination", drop_leaks),
          ("secret_scan", hide_secrets), ("source_mixing", mix_sources)]

#: The classifier, the near-duplicates and the pseudorandom mix have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tbl(spark, sf_dir, "documents")
    scratch = Scratch(spark)
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name, keep=True)
    return docs
