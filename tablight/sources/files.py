"""File sources and sinks."""

from __future__ import annotations

import csv
import io
import json
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablight.sources import records

_DELIMITERS = ",;\t|"


def sniff_delimiter(lines: list[str]) -> str:
    """Pick the delimiter whose per-line count is most consistent (and > 0)
    over the sampled lines; falls back to the standard sniffer, then ','."""
    lines = [ln for ln in lines if ln.strip()]
    best, best_score = ",", (-1, -1)
    for d in _DELIMITERS:
        counts = [ln.count(d) for ln in lines]
        if not counts or max(counts) == 0:
            continue
        mode = max(set(counts), key=counts.count)
        score = (counts.count(mode), mode)
        if score > best_score:
            best, best_score = d, score
    if best_score[0] < 0 and lines:
        try:
            return csv.Sniffer().sniff("\n".join(lines)).delimiter
        except csv.Error:
            return ","
    return best


_CORRUPT = "_not_parsed"


def _header(sample: list[str], sep: str) -> list[str]:
    """Column names from the first line with text; blank ones are numbered,
    repeated ones get their number appended."""
    first = next((r for r in csv.reader(io.StringIO("\n".join(sample).lstrip("\ufeff")), delimiter=sep) if any(x.strip() for x in r)), [])
    seen = Counter(n.lower() for n in first)
    return [f"_c{i}" if not n.strip() else f"{n}{i}" if seen[n.lower()] > 1 else n for i, n in enumerate(first)]


def _fields(spark: SparkSession, path: str, sep: str, names: list[str], encoding: str) -> DataFrame:
    """The columns as text, and ``_CORRUPT``: the record where its number of
    fields is not that of the header."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names] + [T.StructField(_CORRUPT, T.StringType())])
    options = {"sep": sep, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT, "escape": '"'}
    if not records.spans_lines(spark, path):
        return (spark.read.options(**options, header=True, encoding=encoding, columnPruning=False)
                .schema(schema).csv(path))
    cut = records.csv_records(spark, path, sep).where("not is_first")
    text = F.decode("record", encoding) if encoding != "UTF-8" else F.col("record").cast("string")
    cut = cut.select("unclosed", text.alias("record")).where(F.trim("record") != "")
    options |= {"multiLine": "true", "maxCharsPerColumn": "-1"}
    fields = ", ".join(f"`{f.name}` string" for f in schema)
    parsed = F.when(F.col("unclosed"), F.from_csv("record", fields, options | {"quote": ""})) \
        .otherwise(F.from_csv("record", fields, options))
    return cut.select(parsed.alias("row")).select("row.*")


def _too_long(sep: str, fields: int) -> Column:
    """The record has more fields than the header (separators in quotes don't
    count)."""
    bare = F.regexp_replace(_CORRUPT, '"[^"]*"', "")
    return F.coalesce(F.length(bare) - F.length(F.replace(bare, F.lit(sep), F.lit(""))) >= fields, F.lit(False))


_INT, _FLOAT = r"^[+-]?\d{1,19}$", r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_DATE, _TIME = r"^\d{4}-\d{2}-\d{2}$", r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}"


def with_types(df: DataFrame) -> DataFrame:
    """Text columns as the narrowest type that all of their values fit: int,
    bigint, double, date, timestamp, boolean, else text.  Empty values are
    missing.  One aggregate over the table, no shuffle of rows."""
    cols = {c: F.nullif(F.col(f"`{c}`"), F.lit("")) for c in df.columns}
    tries = {"int": lambda c: c.rlike(_INT) & c.try_cast("int").isNotNull(),
             "bigint": lambda c: c.rlike(_INT) & c.try_cast("bigint").isNotNull(),
             "double": lambda c: c.rlike(_FLOAT),
             "date": lambda c: c.rlike(_DATE) & c.try_cast("date").isNotNull(),
             "timestamp": lambda c: (c.rlike(_DATE) | c.rlike(_TIME)) & c.try_cast("timestamp").isNotNull(),
             "boolean": lambda c: F.lower(c).isin("true", "false")}
    row = df.agg(*[F.count(c).alias(f"n{i}") for i, c in enumerate(cols.values())],
                 *[F.count_if(t(c)).alias(f"{k}{i}") for i, c in enumerate(cols.values()) for k, t in tries.items()]).first()
    out = []
    for i, (name, c) in enumerate(cols.items()):
        fits = [k for k in tries if row[f"n{i}"] and row[f"{k}{i}"] == row[f"n{i}"]]
        out.append((c.cast(fits[0]) if fits else c).alias(name))
    return df.select(*out)


def read_csv(spark: SparkSession, path: str, sample_lines: int = 20) -> DataFrame:
    """CSV with a sniffed delimiter and header.

    A quoted field may hold delimiters, line ends and doubled quotes, at any
    split of the file (``records``); a file that ends inside a quoted field is
    read with quoting off.  Records with more fields than the header are left
    out (``skipped_csv`` counts them), shorter ones are filled with nulls, blank
    lines don't count.  Empty fields, quoted or not, are missing values.  Only
    ``sample_lines`` lines reach the driver, for the delimiter and the names.
    The encoding is decided by the whole path: if any line is not valid UTF-8,
    all of it is read as latin-1.  Files of one path share their header."""
    df, names, sep = _parsed_csv(spark, path, sample_lines)
    kept = df.where(~_too_long(sep, len(names)) & _all_read(names))
    return with_types(kept.select(*[F.col(f"`{n}`") for n in names]))


def skipped_csv(spark: SparkSession, path: str, sample_lines: int = 20) -> DataFrame:
    """One row: records of the path that ``read_csv`` keeps and leaves out."""
    df, names, sep = _parsed_csv(spark, path, sample_lines)
    out = df.select(_too_long(sep, len(names)).alias("out"), _all_read(names).alias("all"))
    return out.where("all").agg(F.count_if(~F.col("out")).alias("kept"), F.count_if("out").alias("skipped"))


def _all_read(names: list[str]) -> Column:
    """Always true, but reads every column: a scan of CSV files must not ask for
    the unparsed record alone."""
    return F.hash(*[F.col(f"`{n}`") for n in names]) <= 2**31 - 1


def _parsed_csv(spark: SparkSession, path: str, sample_lines: int) -> tuple[DataFrame, list[str], str]:
    sample = [r[0] for r in spark.read.text(path).limit(sample_lines).collect()]
    sep = sniff_delimiter(sample)
    names = _header(sample, sep)
    broken = spark.read.text(path).where(~F.is_valid_utf8("value"))
    encoding = "UTF-8" if broken.isEmpty() else "ISO-8859-1"
    return _fields(spark, path, sep, names, encoding), names, sep


def _whole_object(line: str) -> bool:
    try:
        return isinstance(json.loads(line), dict)
    except ValueError:
        return False


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON as an array of records, one record per line, or one object.

    What the file begins with decides; only its first line or, of an array, the
    text up to the first ``}`` reaches the driver.  A line that is a whole object
    means JSON lines.  ``[`` means an array of records, of any size and layout:
    it is cut at its records by many tasks (``records``).  An unfinished object
    is one record and read by one task."""
    start = spark.read.option("lineSep", "}").text(path).where("trim(value) <> ''").select(
        F.ltrim(F.translate("value", "\ufeff\r\n\t", "   ")).startswith("[")).first()
    if start and start[0]:
        return records.json_array(spark, path)
    first = spark.read.text(path).where("trim(value) <> ''").first()
    if first and not _whole_object(first[0]):
        return spark.read.option("multiLine", True).json(path)
    return spark.read.json(path)


def save(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """S3: write Parquet (snappy)."""
    df.write.mode(mode).option("compression", "snappy").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """S3: read Parquet back."""
    return spark.read.parquet(path)

