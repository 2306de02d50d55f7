"""Records that may span lines, cut out of large files by many tasks.

A text file is scanned in splits, and a split can't see whether it begins inside
a quoted field.  So each block of lines is read under both assumptions; what it
does to the state is one of four functions (keep, flip, always inside, always
outside).  Composing them along the file is a running count of flips since the
last block that sets the state outright -- a window over one row per block, not
over lines.  With the state at each block known, every line knows whether it
starts and ends inside a record.  Lines that are a record by themselves stay
where they are; only the lines of longer records are shuffled, each to its
record.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablight.session import checkpoint_dir, cut_lineage


def ends_open(line: bytes, inside: bool, sep: bytes, quote: bytes = b'"') -> bool:
    """Whether a quoted field is open at the end of a line that starts inside
    one (or not).  A quote opens a field only as its first character; two in a
    row inside stand for one."""
    at = 0
    if not inside and quote not in line:
        return False
    while True:
        if inside:
            at = line.find(quote, at)
            if at < 0:
                return True
            if line.startswith(quote, at + 1):
                at += 2
                continue
            inside = False
        elif line.startswith(quote, at):
            inside, at = True, at + 1
            continue
        at = line.find(sep, at)
        if at < 0:
            return False
        at += 1


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, start, value): every line with the file block it lies in."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"),
        F.expr("substring(cast(value as binary), 1, octet_length(value) - if(endswith(value, '\\r'), 1, 0))").alias("value"))


def _walk(batches: Iterator[pa.RecordBatch], sep: bytes) -> Iterator[tuple]:
    """(batch, path, start, no, out, ins) for each line: its number in the block
    and (starts, ends) inside, if the block starts outside or inside."""
    where, no, state = None, 0, (False, True)
    for batch in batches:
        paths, starts, values = (batch.column(i).to_pylist() for i in range(3))
        rows = []
        for path, start, value in zip(paths, starts, values, strict=True):
            if (path, start) != where:
                where, no, state = (path, start), 0, (False, True)
            if b'"' in value:
                after = (ends_open(value, state[0], sep), ends_open(value, state[1], sep))
            else:
                after = state
            rows.append((path, start, no, value, state, after))
            no, state = no + 1, after
        yield rows


def _block_effects(lines: DataFrame, sep: str) -> DataFrame:
    """One row per block: the state after it, from either state before it, and
    the first line that is not blank."""
    delimiter = sep.encode()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, list] = {}
        for rows in _walk(batches, delimiter):
            for path, start, no, value, _, after in rows:
                block = found.setdefault((path, start), [False, True, None])
                block[0], block[1] = after
                if block[2] is None and value.strip():
                    block[2] = no
        out = [(p, s, *b) for (p, s), b in found.items()]
        yield pa.RecordBatch.from_pylist(
            [dict(zip(("path", "start", "from_out", "from_in", "first_no"), r, strict=True)) for r in out],
            schema=pa.schema([("path", pa.string()), ("start", pa.int64()), ("from_out", pa.bool_()),
                              ("from_in", pa.bool_()), ("first_no", pa.int64())]))

    return lines.mapInArrow(work, "path string, start long, from_out boolean, from_in boolean, first_no long")


def block_states(lines: DataFrame, sep: str) -> DataFrame:
    """(path, start, inside, first, unclosed): whether each block starts inside
    a quoted field, the number of the file's first line with text (in its
    block), and whether the file ends with a field still open."""
    earlier = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sets = F.col("from_out") == F.col("from_in")
    flips = (~sets & F.col("from_out")).cast("long")
    b = _block_effects(lines, sep).withColumn("flips", F.coalesce(F.sum(flips).over(earlier), F.lit(0)))
    b = b.withColumn("set", F.last(F.when(sets, F.struct(F.col("from_out").cast("long").alias("to"), "flips")),
                                   ignorenulls=True).over(earlier))
    since = F.coalesce(F.col("set.to") + F.col("flips") - F.col("set.flips"), F.col("flips"))
    b = b.withColumn("inside", since % 2 == 1)
    last = F.when(F.col("inside"), F.col("from_in")).otherwise(F.col("from_out"))
    head = F.first(F.when(F.col("first_no").isNotNull(), F.struct("start", "first_no")), ignorenulls=True)
    return b.select("path", "start", "inside", F.last(last).over(whole).alias("unclosed"), head.over(whole).alias("head"))


def spans_lines(spark: SparkSession, path: str | list[str]) -> bool:
    """Whether some line has an odd number of quotes, as every line has where a
    field with a line end opens or closes.  One scan, no shuffle."""
    text = F.col("value")
    quotes = F.length(text) - F.length(F.replace(text, F.lit('"'), F.lit("")))
    return not spark.read.option("lineSep", "\n").text(path).where(quotes % 2 == 1).isEmpty()


def csv_records(spark: SparkSession, path: str | list[str], sep: str) -> DataFrame:
    """(path, is_first, unclosed, record): the records of CSV files, bytes as
    they are but for line ends; ``is_first`` marks a file's first record with
    text.  In a file that ends inside a quoted field (``unclosed``) quotes mean
    nothing, and every line is a record."""
    lines = _lines(spark, path)
    delimiter = sep.encode()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _walk(batches, delimiter):
            path, start, no, value, before, after = zip(*rows, strict=True) if rows else ((),) * 6
            cols = [pa.array(path, pa.string()), pa.array(start, pa.int64()), pa.array(no, pa.int64()),
                    pa.array(value, pa.binary())]
            cols += [pa.array([s[k] for s in side], pa.bool_()) for side in (before, after) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(cols, ["path", "start", "no", "value", "b0", "b1", "a0", "a1"])

    states = cut_lineage(block_states(lines, sep))
    numbered = lines.mapInArrow(
        work, "path string, start long, no long, value binary, b0 boolean, b1 boolean, a0 boolean, a1 boolean")
    known = numbered.join(states, ["path", "start"])
    quoted = ~F.col("unclosed")
    at = known.select(
        "path", "start", "no", "value", "unclosed",
        (quoted & F.when(F.col("inside"), F.col("b1")).otherwise(F.col("b0"))).alias("began"),
        (quoted & F.when(F.col("inside"), F.col("a1")).otherwise(F.col("a0"))).alias("goes_on"),
        ((F.col("head.start") == F.col("start")) & (F.col("head.first_no") == F.col("no"))).alias("is_first"))
    alone = at.where(~F.col("began") & ~F.col("goes_on")).select("path", "is_first", "unclosed", F.col("value").alias("record"))
    several = _assembled(cut_lineage(at.where("began or goes_on")), "\n", "is_first")
    return alone.unionByName(several.withColumn("unclosed", F.lit(False)))


def _assembled(parts: DataFrame, joiner: str, *first: str) -> DataFrame:
    """(path, first, record): records of several lines, joined; columns
    ``first`` come from a record's first line.  A line belongs to the last line
    before it that opened a record: in its block, else the last one of an
    earlier block."""
    opens = F.when(~F.col("began"), F.col("no"))
    inner = Window.partitionBy("path", "start").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.withColumn("own", F.last(opens, ignorenulls=True).over(inner))
    blocks = parts.groupBy("path", "start").agg(F.max(opens).alias("opened"))
    earlier = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    carried = F.last(F.when(F.col("opened").isNotNull(), F.struct("start", "opened")), ignorenulls=True).over(earlier)
    blocks = blocks.select("path", "start", carried.alias("carried"))
    parts = parts.join(blocks, ["path", "start"])
    home = F.when(F.col("own").isNotNull(), F.struct(F.col("start").alias("start"), F.col("own").alias("opened"))) \
        .otherwise(F.col("carried"))
    lines = F.sort_array(F.collect_list(F.struct("start", "no", "value", *first)))
    grouped = parts.withColumn("home", home).groupBy("path", "home").agg(lines.alias("lines"))
    joined = F.concat_ws(joiner, F.transform("lines", lambda x: x["value"].cast("string"))).cast("binary")
    return grouped.select("path", *[F.col("lines")[0][c].alias(c) for c in first], joined.alias("record"))


# --------------------------------------------------------------------------
# JSON arrays
# --------------------------------------------------------------------------

_ESCAPED = re.compile(rb"\\.", re.DOTALL)


def _depths(segment: bytes) -> tuple[int, int, int]:
    """(1 if it flips "inside a string", change of depth if it starts outside,
    if it starts inside); the ``}`` after it not counted."""
    parts = _ESCAPED.sub(b"", segment).split(b'"') if b'"' in segment else [segment]
    change = [0, 0]
    for side in (0, 1):
        for part in parts[side::2]:
            change[side] += part.count(b"{") + part.count(b"[") - part.count(b"]")
    return (len(parts) - 1) % 2, *change


def _json_walk(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """(path, start, no, value, in0, in1, before0, before1, after0, after1) of
    each segment: whether it starts inside a string and the depth before and after
    it, from the block's start, if that is outside or inside a string."""
    where, no, inside, depth = None, 0, 0, [0, 0]
    for batch in batches:
        rows = []
        for path, start, value in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if (path, start) != where:
                where, no, inside, depth = (path, start), 0, 0, [0, 0]
            flip, *change = _depths(value)
            # a block that starts inside is inside wherever one that starts outside is not
            after = [depth[h] + change[inside ^ h] - (1 if inside ^ h ^ flip == 0 else 0) for h in (0, 1)]
            rows.append((path, start, no, value, inside, inside ^ 1, *depth, *after, inside ^ flip))
            no, inside, depth = no + 1, inside ^ flip, after
        yield rows


def json_array_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(record): the objects of top-level JSON arrays, one to a row, as text."""
    segments = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"),
        F.col("value").cast("binary").alias("value"))

    def effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[tuple, tuple] = {}
        for rows in _json_walk(batches):
            for r in rows:
                last[r[0], r[1]] = (r[10], r[8], r[9])
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in last], pa.string()), pa.array([k[1] for k in last], pa.int64()),
             *[pa.array([v[i] for v in last.values()], pa.int64()) for i in range(3)]], ["path", "start", "flip", "d0", "d1"])

    earlier = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    blocks = segments.mapInArrow(effects, "path string, start long, flip long, d0 long, d1 long")
    blocks = blocks.withColumn("inside", F.coalesce(F.sum("flip").over(earlier), F.lit(0)) % 2)
    change = F.when(F.col("inside") == 1, F.col("d1")).otherwise(F.col("d0"))
    blocks = blocks.select("path", "start", "inside", F.coalesce(F.sum(change).over(earlier), F.lit(0)).alias("depth"))
    blocks = cut_lineage(blocks)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "start", "no", "value", "in0", "in1", "before0", "before1", "after0", "after1", "end0"]
        types = [pa.string(), pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 7]
        for rows in _json_walk(batches):
            cols = zip(*rows, strict=True) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    numbered = segments.mapInArrow(
        work, "path string, start long, no long, value binary, in0 long, in1 long, before0 long, before1 long, "
              "after0 long, after1 long, end0 long").join(blocks, ["path", "start"])
    side = lambda a, b: F.when(F.col("inside") == 1, F.col(b)).otherwise(F.col(a))
    outside = side("in0", "in1") == 0
    ends_outside = (F.col("end0") + F.col("inside")) % 2 == 0
    at = numbered.select(
        "path", "start", "no", "value",
        (~(outside & (F.col("depth") + side("before0", "before1") <= 1))).alias("began"),
        (~(ends_outside & (F.col("depth") + side("after0", "after1") == 1))).alias("goes_on"))
    alone = at.where(~F.col("began") & ~F.col("goes_on")).select(F.col("value").alias("record"))
    several = _assembled(cut_lineage(at.where("began or goes_on")), "}")
    text = F.concat(F.col("record").cast("string"), F.lit("}"))
    # what stands between records goes; line ends can't be part of a string
    text = F.translate(F.regexp_replace(text, r"^[\s,\[\x{FEFF}]+", ""), "\r\n", "  ")
    return alone.unionByName(several.select("record")).select(text.alias("record")).where(F.col("record").startswith("{"))


def json_array(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A JSON array file by way of JSON lines, which many tasks write and read."""
    out = f"{checkpoint_dir(spark).rstrip('/')}/json-lines-{uuid.uuid4().hex}"
    json_array_lines(spark, path).write.text(out)
    return spark.read.json(out)
