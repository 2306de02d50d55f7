"""Operator 13: a Merkle manifest of a dataset, kept as strings of whole levels.

A leaf is the SHA-256 of a row's fields, each written as its UTF-8 length, a
colon and its value.  Leaves are placed by id within their group (language) and
cut into aligned blocks of ``BLOCK`` = 8^3; a block keeps each level of its own
tree as one string of 64 hex digits per node.  Fixed-width substrings of 8 nodes
hash to the next level, the substrings to the left and right of a node in its
run are its sibling segments.  Block roots are leaves of a tree of their own,
so the same step recurses until every group has one node; the groups' roots, in
order, form the last tree.  Level strings are held as binary of ASCII digits:
substrings there are cut without a scan from the start.

On the way down each block joins the sibling segments that its root has above
it, so a row's proof is never shuffled; only ids and digests move, no texts, and
no group of rows is larger than a block.

Defined cases: null fields are written as ``-``; null ids come first and are
never tampered with; equal ids are ordered by leaf, equal rows are leaves of
their own; a null group comes first; an empty table has no rows and no root;
extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablight.llm.common import Scratch, positions

ARITY_BITS, LEVELS, HEX = 3, 3, 64
ARITY, BLOCK = 1 << ARITY_BITS, 1 << (ARITY_BITS * LEVELS)
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SEGMENTS = "array<struct<left: binary, right: binary>>"


def _field(c: Column) -> Column:
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(row: dict[str, Column]) -> Column:
    return F.sha2(F.concat(*[_field(row[f]) for f in FIELDS]), 256)


def lowered(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def _cut(level: Column, first: Column, nodes: Column) -> Column:
    """``nodes`` digests of a level, from node ``first`` on."""
    return F.substring(level, first * HEX + 1, nodes * HEX)


def _parents(level: Column) -> Column:
    runs = F.ceil(F.length(level) / (HEX * ARITY)).cast("int")
    hashed = F.transform(F.sequence(F.lit(0), runs - 1),
                         lambda i: F.sha2(_cut(level, i * ARITY, F.lit(ARITY)), 256))
    return F.array_join(hashed, "").cast("binary")


def _blocks(nodes: DataFrame, keep: list[str], scratch: Scratch, name: str) -> DataFrame:
    """nodes (grp, pos, n, h, *keep) -> one row per block: grp, block, n, its
    level strings l0 ... l3 (null above a group's only node) and the kept
    columns as ``items`` in order."""
    grouped = nodes.groupBy("grp", F.expr(f"pos div {BLOCK}").alias("block"), "n").agg(
        F.sort_array(F.collect_list(F.struct("pos", "h", *keep))).alias("items"))
    out = grouped.withColumn("l0", F.array_join("items.h", "").cast("binary"))
    for i in range(LEVELS):
        below = F.col(f"l{i}")
        done = (F.col("n") <= BLOCK) & (F.length(below) <= HEX)
        out = out.withColumn(f"l{i + 1}", F.when(~done, _parents(below)))
    items = F.transform("items", lambda x: F.struct(*[x[k].alias(k) for k in keep])) if keep else F.lit(None)
    return scratch.save(out.withColumn("items", items), name, keep=name == "tree-0")


def _root() -> Column:
    return F.coalesce(*[F.col(f"l{k}") for k in range(LEVELS, -1, -1)]).cast("string")


def _build(leaves: DataFrame, keep: list[str], scratch: Scratch, name: str) -> list[DataFrame]:
    """The blocks of each storey: leaves (grp, pos, n, h, *keep), then the
    roots of the blocks below, until every group has one block."""
    storeys = [_blocks(leaves, keep, scratch, f"{name}-0")]
    while not (open_ := storeys[-1].where(F.col("n") > BLOCK)).isEmpty():
        nodes = open_.select("grp", F.col("block").alias("pos"), F.expr(f"(n + {BLOCK - 1}) div {BLOCK}").alias("n"),
                             _root().alias("h"))
        storeys.append(_blocks(nodes, [], scratch, f"{name}-{len(storeys)}"))
    return storeys


def _segments(i: Column) -> Column:
    """Sibling segments of node i of a block, from its own level up to the
    block's root, then what lies above the block."""
    own = []
    for k in range(LEVELS):
        at = F.shiftright(i, ARITY_BITS * k)
        run = F.shiftleft(F.shiftright(at, ARITY_BITS), ARITY_BITS)
        level = F.col(f"l{k}")
        own.append(F.when(F.col(f"l{k + 1}").isNotNull(),
                          F.struct(_cut(level, run, at - run).alias("left"),
                                   _cut(level, at + 1, run + (ARITY - 1) - at).alias("right"))))
    return F.concat(F.filter(F.array(*own), lambda s: s.isNotNull()), F.col("above"))


def _descend(storeys: list[DataFrame], above: DataFrame | None, scratch: Scratch, name: str) -> DataFrame:
    """Blocks of the lowest storey with ``above``: the segments over them.
    ``above`` has grp, above and what else is known of the group, which goes
    along; without it nothing lies above the groups."""
    path, known = None, [c for c in above.columns if c not in ("grp", "above")] if above else []
    for s in range(len(storeys) - 1, -1, -1):
        blocks = storeys[s]
        last = blocks.where(F.col("n") <= BLOCK)
        if above is None:
            found = last.withColumn("above", F.array().cast(SEGMENTS))
        else:
            found = last.join(above.withColumnRenamed("grp", "_g"), last["grp"].eqNullSafe(F.col("_g"))).drop("_g")
        if path is not None:
            inner = blocks.where(F.col("n") > BLOCK)
            found = found.unionByName(inner.join(path, inner["grp"].eqNullSafe(F.col("_g"))
                                                 & (inner["block"] == path["_i"])).drop("_g", "_i"))
        if s == 0:
            return found
        nodes = (F.length("l0") / HEX).cast("int")
        each = F.transform(F.sequence(F.lit(0), nodes - 1), lambda i: F.struct(
            i.alias("i"), _segments(i).cast(SEGMENTS).alias("above")))
        path = scratch.save(found.select("grp", "block", *known, F.inline(each)).select(
            F.col("grp").alias("_g"), (F.col("block") * BLOCK + F.col("i")).alias("_i"), "above", *known),
            f"{name}-path{s}", keep=(name, s) == ("tree", 1))
    raise AssertionError("no storeys")


def folded(leaf: Column, segments: Column) -> Column:
    """The root that a leaf and its sibling segments lead to."""
    return F.aggregate(segments, leaf,
                       lambda acc, s: F.sha2(F.concat(s["left"], acc.cast("binary"), s["right"]), 256))


def manifest(documents: DataFrame, group: str = "lang", tampered: Column | None = None) -> DataFrame:
    """doc_id, leaf, changed_leaf, subroot, root and ``proof`` (array of the
    left and right sibling segments, level by level) for every row.
    ``tampered`` is another text per row, hashed into ``changed_leaf`` (null:
    the row's own)."""
    scratch = Scratch(documents.sparkSession)
    row = {f: F.col(f) for f in FIELDS}
    other = leaf_hash(row | {"text": tampered}) if tampered is not None else F.lit(None).cast("string")
    hashed = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(group).alias("grp"),
                              leaf_hash(row).alias("h"), other.alias("changed"))
    leaves = positions(hashed, "grp", ["doc_id", "h"], scratch, "leaves")
    storeys = _build(leaves, ["doc_id", "changed"], scratch, "tree")

    roots = reduce(DataFrame.unionAll, [s.where(F.col("n") <= BLOCK).select("grp", _root().alias("h"))
                                        for s in storeys])
    roots = scratch.save(roots.select(F.lit(0).alias("one"), "grp", "h"), "roots")
    tops = positions(roots, "one", ["grp"], scratch, "roots").select(
        F.col("one").alias("grp"), "pos", "n", "h", F.struct(F.col("grp").alias("of")).alias("of"))
    top = _build(tops, ["of"], scratch, "top")
    root = top[-1].where(F.col("n") <= BLOCK).select(_root().alias("root"))
    crowned = _descend(top, None, scratch, "top")
    above = crowned.select(F.inline(F.transform("items", lambda x, i: F.struct(
        x["of"]["of"].alias("grp"), _cut(F.col("l0"), i, F.lit(1)).cast("string").alias("subroot"),
        _segments(i).cast(SEGMENTS).alias("above")))))
    # one root for all: a literal, not a join
    first = root.first()
    above = scratch.save(above.withColumn("root", F.lit(first["root"] if first else None).cast("string")), "above", keep=True)
    found = _descend(storeys, above, scratch, "tree")
    proofs = found.select("subroot", "root", F.inline(F.transform("items", lambda x, i: F.struct(
        x["doc_id"].alias("doc_id"), _cut(F.col("l0"), i, F.lit(1)).cast("string").alias("leaf"),
        x["changed"].alias("changed_leaf"), _segments(i).cast(SEGMENTS).alias("proof")))))
    scratch.close()
    return proofs.select("doc_id", "leaf", "changed_leaf", "subroot", "root", "proof")


def verify(proofs: DataFrame) -> DataFrame:
    """Each row's proof digest, the root that its changed leaf (or else its own)
    folds to, and whether that is the root."""
    siblings = F.transform("proof", lambda s: F.concat(s["left"], s["right"]).cast("string"))
    digest = F.sha2(F.array_join(siblings, "").cast("binary"), 256)
    back = folded(F.coalesce("changed_leaf", "leaf"), F.col("proof"))
    return proofs.select("doc_id", "leaf", "subroot", "root", digest.alias("proof_sha256"),
                         back.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))
