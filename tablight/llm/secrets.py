"""Operator 8: secret scans with a recursive decoding worklist.

The raw text is scanned for three kinds of secrets.  Then a worklist of layers
runs to a fixpoint: every layer is unwrapped in all ways that apply (URL
escapes, Unicode escapes, base64, gzip, zlib, bzip2 or xz streams, two-byte
characters), each new layer is scanned with the same patterns, and its findings
are mapped to the span of the raw text they came from.  A layer that was seen
before (same text from the same span) is not taken up again, so cycles end.

Decoded bytes are read one character a byte (Latin-1), whatever they are: all
patterns are ASCII, so UTF-8, other code pages and binary need no telling
apart.  Base64 is read at all four alignments, so that letters and separators
before a token do no harm, line by line and with the lines joined.  Streams may
start anywhere in a layer; members that follow each other are one text, and a
damaged or truncated stream gives what could be read of it.

Defined cases: null and empty texts hold nothing; rows are independent, so
repeated rows give repeated results; empty tables give no rows; columns other
than the named ones pass through untouched.  Of a stream that unpacks to more
than ``MAX_LAYER`` characters (an archive bomb) the first ``MAX_LAYER`` are
read, and no more layers are taken up once those of a document hold
``MAX_TOTAL`` characters; what is left unread so is counted in
``n_left_packed`` and hidden whole in the redacted text.  Nothing else is
limited.
"""

from __future__ import annotations

import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
#: A greedy run that is too short holds no longer run, so the least length can
#: stand in the pattern; the look-behind only saves failing attempts.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
UNICODE = re.compile(r"\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}")
_B = "[A-Za-z0-9+/_-]"
#: The shortest finding has 12 characters, so 16 in base64.
BASE64 = re.compile(rf"(?<!{_B}){_B}{{16,}}={{0,2}}")
WRAPPED = re.compile(rf"(?<!{_B}){_B}++(?:[ \t]*+(?:\r\n?|\n)[ \t]*+{_B}++)++={{0,2}}")
_MAGIC = (r"(?P<zlib>\x1f\x8b\x08|x[\x01^\x9c\xda])|(?P<bz2>BZh[1-9](?:1AY&SY|\x17rE8P\x90))|(?P<xz>\xfd7zXZ\x00)")
MAGIC = re.compile(_MAGIC.encode())
STREAMS = {"zlib": lambda: zlib.decompressobj(47), "bz2": bz2.BZ2Decompressor, "xz": lzma.LZMADecompressor}
BROKEN = (zlib.error, OSError, lzma.LZMAError, EOFError, ValueError)
#: A layer without any of these holds no finding and no further layer.
LIVE = re.compile(rf"(?i:passw|secret|token|api_?key)|AKIA|[0-9a-f]{{24}}|%[0-9A-Fa-f]{{2}}|\\[uUx]|{_B}{{16}}|"
                  rf"{_B}[ \t]*[\r\n]|[!-~]\x00|\x00[!-~]|{_MAGIC}", re.ASCII)
URLSAFE = str.maketrans("-_", "+/", "= \t\r\n")
MAX_LAYER = 64 << 20
MAX_TOTAL = 4 * MAX_LAYER

Span = tuple[int, int, int]  # start, kind, end


def scan(text: str) -> list[Span]:
    """Start, kind and end of every finding, leftmost and non-overlapping per kind."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


class Layer:
    """A decoded text and, for each of its characters, the raw span behind it
    (``None``: the raw text itself)."""

    def __init__(self, text: str, starts: np.ndarray | None = None, ends: np.ndarray | None = None):
        self.text, self.starts, self.ends = text, starts, ends

    def spans(self) -> tuple[np.ndarray, np.ndarray]:
        if self.starts is None:
            n = len(self.text)
            return np.arange(n, dtype=np.int64), np.arange(1, n + 1, dtype=np.int64)
        return self.starts, self.ends

    def raw(self, start: int, end: int) -> tuple[int, int]:
        if self.starts is None:
            return start, end
        return int(self.starts[start:end].min()), int(self.ends[start:end].max())


def _spliced(layer: Layer, pieces: list[tuple[int, int, str, np.ndarray, np.ndarray]]) -> Layer:
    """The layer with pieces replaced: (start, end, new text, source start and
    end of each new character)."""
    text, (s, e) = layer.text, layer.spans()
    out, ss, ee, at = [], [], [], 0
    for a, b, new, frm, to in pieces:
        out += [text[at:a], new]
        ss += [s[at:a], s[frm]]
        ee += [e[at:a], e[to - 1]]
        at = b
    out.append(text[at:])
    return Layer("".join(out), np.concatenate([*ss, s[at:]]), np.concatenate([*ee, e[at:]]))


def _percent(layer: Layer) -> Iterator[Layer]:
    if "%" not in layer.text:
        return
    pieces = []
    for m in PERCENT.finditer(layer.text):
        frm = np.arange(m.start(), m.end(), 3)
        pieces.append((m.start(), m.end(), bytes.fromhex(m.group().replace("%", "")).decode("latin-1"), frm, frm + 3))
    if pieces:
        yield _spliced(layer, pieces)


def _unicode(layer: Layer) -> Iterator[Layer]:
    if "\\" not in layer.text:
        return
    pieces = []
    for m in UNICODE.finditer(layer.text):
        code = int(m.group()[2:], 16)
        if code < 0x110000 and not 0xD800 <= code < 0xE000:
            pieces.append((m.start(), m.end(), chr(code), np.array([m.start()]), np.array([m.end()])))
    if pieces:
        yield _spliced(layer, pieces)


def _base64(layer: Layer) -> Iterator[Layer]:
    spans = None
    for pattern in (BASE64, WRAPPED):
        for m in pattern.finditer(layer.text):
            token = m.group().translate(URLSAFE)
            pos = None
            for k in range(4):
                n = len(token) - k
                n -= n % 4 == 1
                if n < 16:
                    break
                text = binascii.a2b_base64(token[k:k + n] + "=" * (-n % 4)).decode("latin-1")
                if not LIVE.search(text):
                    continue
                if pos is None:
                    spans = spans or layer.spans()
                    pos = m.start() + np.flatnonzero([not c.isspace() for c in m.group()])
                four = k + np.arange(len(text)) // 3 * 4
                yield Layer(text, spans[0][pos[four]], spans[1][pos[np.minimum(four + 4, len(pos)) - 1]])


def _stream(data: bytes, at: int, kind: str, room: int, fine: int | None = None) -> tuple[bytes, int, bool]:
    """What the stream from a place on holds, up to ``room`` bytes and one more,
    as far as it can be read; where it ends, and if it does.  From ``fine`` on
    it is fed byte by byte, to get all that lies before the damage."""
    tool, out, size, pos = STREAMS[kind](), [], 0, at
    try:
        while pos < len(data) and not tool.eof and size <= room:
            to = pos + (1 << 16) if fine is None else fine if pos < fine else pos + 1
            got = tool.decompress(data[pos:to], room + 1 - size)
            out.append(got)
            size, pos = size + len(got), min(to, len(data))
    except BROKEN:
        if fine is None:
            return _stream(data, at, kind, room, pos)
    return b"".join(out), pos - (len(tool.unused_data) if tool.eof else 0), tool.eof


def _packed(layer: Layer, left: list[tuple[int, int]]) -> Iterator[Layer]:
    data, at = layer.text.encode("latin-1", "replace"), 0
    while m := MAGIC.search(data, at):
        out, end, whole = _stream(data, m.start(), m.lastgroup, MAX_LAYER)
        at = end if whole else m.start() + 1
        while whole and len(out) <= MAX_LAYER:  # further members, after the padding of xz
            pad = end
            while data[pad:pad + 4] == b"\0\0\0\0":
                pad += 4
            more = MAGIC.match(data, pad)
            if not more or more.lastgroup != m.lastgroup:
                break
            got, end, whole = _stream(data, pad, m.lastgroup, MAX_LAYER - len(out))
            out, at = out + got, end if whole else pad + 1
        a, b = layer.raw(m.start(), max(end, m.end()))
        if len(out) > MAX_LAYER:
            left.append((a, b))
            out = out[:MAX_LAYER]
        if out:
            yield Layer(out.decode("latin-1"), np.broadcast_to(np.int64(a), len(out)), np.broadcast_to(np.int64(b), len(out)))


def _wide(layer: Layer) -> Iterator[Layer]:
    """Characters of two bytes (UTF-16; UTF-32 in two steps): every other
    character, those without a NUL beside them blanked out."""
    if "\0" not in layer.text:
        return
    x = np.frombuffer(layer.text.encode("latin-1", "replace"), np.uint8)
    nul = np.r_[False, x == 0, False]
    kept = np.where(nul[:-2] | nul[2:], x, 0x80).astype(np.uint8)
    s, e = layer.spans()
    for k in (0, 1):
        text = kept[k::2].tobytes().decode("latin-1")
        if LIVE.search(text):
            yield Layer(text, s[k::2], e[k::2])


def _findings(text: str) -> tuple[list[Span], list[Span], list[tuple[int, int]]]:
    base = scan(text)
    every, seen, left, total = set(base), set(), [], 0
    work = [Layer(text)]
    while work:
        layer = work.pop()
        for unwrap in (_percent(layer), _unicode(layer), _base64(layer), _packed(layer, left), _wide(layer)):
            for new in unwrap:
                key = (hashlib.blake2b(new.text.encode("utf-8", "surrogatepass"), digest_size=16).digest(),
                       int(new.starts[0]) if len(new.starts) else 0, int(new.ends[-1]) if len(new.ends) else 0)
                if key in seen:
                    continue
                seen.add(key)
                total += len(new.text)
                if total > MAX_TOTAL:
                    left += [x.raw(0, len(x.text)) for x in [layer, new, *work]]
                    return base, sorted(every), left
                work.append(new)
                for start, kind, end in scan(new.text):
                    a, b = new.raw(start, end)
                    every.add((a, kind, b))
    return base, sorted(every), left


def findings(text: str) -> tuple[list[Span], list[Span], int]:
    """Findings in the raw text; findings in raw and decoded layers, as raw
    spans; number of layers left unread or read in part."""
    base, spans, left = _findings(text)
    return base, spans, len(left)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def redact(text: str, spans: list[Span], mark: str = "[REDACTED]") -> str:
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


SPAN_TYPE = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
                                      T.StructField("end", T.LongType())]))


def scan_secrets(documents: DataFrame, text_col: str = "text", redacted: bool = True) -> DataFrame:
    """All columns, then secret_base and secret_spans (arrays of kind, start,
    end in code points), n_left_packed and, if asked for, the redacted text."""
    out = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("kind", T.IntegerType()),
                                    T.StructField("end", T.LongType())]))
    kind = T.StructType([T.StructField("base", out), T.StructField("spans", out),
                         T.StructField("left", T.IntegerType()), T.StructField("redacted", T.StringType())])

    @F.pandas_udf(kind)
    def work(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            text = text or ""
            base, spans, left = _findings(text)
            hide = sorted([*spans, *[(a, -1, b) for a, b in left]])
            rows.append((base, spans, len(left), redact(text, hide) if redacted and hide else None))
        return pd.DataFrame(rows, columns=["base", "spans", "left", "redacted"])

    names = F.array(*[F.lit(k) for k in KINDS])
    shown = lambda c: F.transform(c, lambda x: F.struct(
        F.element_at(names, x["kind"] + 1).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    got = documents.withColumn("_found", work(F.col(text_col)))
    got = got.withColumns({"secret_base": shown(F.col("_found.base")), "secret_spans": shown(F.col("_found.spans")),
                           "n_left_packed": F.col("_found.left")})
    if redacted:
        got = got.withColumn("redacted", F.coalesce("_found.redacted", F.col(text_col)))
    return got.drop("_found")
