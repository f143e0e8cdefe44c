"""Secret scans: keywords by an Aho-Corasick automaton, patterns only at its hits, checksums at the end.

One pass of the automaton over the lower-cased bytes of a text finds all keywords (``KEYWORDS``). Only
at a hit, and anchored there, a pattern is tried on the text itself; a pattern begins with its keyword,
so the hits, taken in order and each beyond the match before, give the leftmost non-overlapping
matches. Long runs of hex digits have no keyword: their limits are read off the table of byte classes.

The kinds of ``BASE`` are decided by their length. The kinds of ``CHECKED`` are added only if the
checksum that such a token carries is right: the CRC-32 in base 62 at the end of access tokens of two
code hosts, and the double SHA-256 of a base-58 private wallet key. Base spans stay in any case.

Positions are code points, ends exclusive. Edge cases: a null text is empty and has no spans. Invalid
bytes count as the code points that their leading bytes begin. Spans of different kinds may overlap and
are all kept; of one kind, ties at a start cannot occur. Repeated rows get repeated results, rows
without id are searched. Very long texts are searched whole, in time linear in their length. Other
columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.llm.common import pick, scored

BASE = ("assign", "access", "hex")
CHECKED = ("host_token", "package_token", "wallet_key")
KINDS = (*BASE, *CHECKED)
#: Keywords in lower case and the kind that each may begin. Fixed values.
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign",
    "akia": "access",
    "ghp_": "host_token", "gho_": "host_token", "ghu_": "host_token", "ghs_": "host_token", "ghr_": "host_token",
    "npm_": "package_token",
    "xprv": "wallet_key",
}
#: Patterns over bytes as characters. Fixed values.
PATTERNS = {
    "assign": re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
    "access": re.compile(r"AKIA[A-Z0-9]+", re.A),
    "host_token": re.compile(r"gh[pousr]_([A-Za-z0-9]{36})(?![A-Za-z0-9])", re.A),
    "package_token": re.compile(r"npm_([A-Za-z0-9]{36})(?![A-Za-z0-9])", re.A),
    "wallet_key": re.compile(r"(xprv[1-9A-HJ-NP-Za-km-z]{107})(?![A-Za-z0-9])", re.A),
}
VALUE_CHARS, ACCESS_CHARS, HEX_CHARS = 8, 16, 32
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
HEX = np.zeros(256, bool)
HEX[list(b"0123456789abcdef")] = True
SPANS = "array<struct<start:int,order:int,stop:int,kind:string>>"


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        found.add_word(word, (len(word), kind))
    found.make_automaton()
    return found


def crc_ends(token: str) -> bool:
    """Whether the last six characters are the CRC-32 of the others in base 62."""
    code, digits = zlib.crc32(token[:-6].encode()), ""
    for _ in range(6):
        code, digit = divmod(code, 62)
        digits = BASE62[digit] + digits
    return token[-6:] == digits


def double_hash_ends(key: str) -> bool:
    """Whether the last four bytes of a base-58 key are the double SHA-256 of the others."""
    number = 0
    for letter in key:
        number = number * 58 + BASE58.index(letter)
    if number >> (8 * 82):
        return False
    raw = number.to_bytes(82, "big")
    return hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


VALID: dict[str, Callable[[re.Match], bool]] = {
    "assign": lambda m: len(m[1]) >= VALUE_CHARS,
    "access": lambda m: len(m[0]) >= ACCESS_CHARS,
    "host_token": lambda m: crc_ends(m[1]),
    "package_token": lambda m: crc_ends(m[1]),
    "wallet_key": lambda m: double_hash_ends(m[1]),
}


def keyword_spans(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, stop, kind) in characters of ``text``, which stand for one byte each."""
    free = dict.fromkeys(KINDS, 0)
    hits = sorted((last + 1 - size, kind) for last, (size, kind) in automaton().iter(text.lower()))
    for start, kind in hits:
        match = PATTERNS[kind].match(text, start) if start >= free[kind] else None
        if match:
            free[kind] = match.end()
            if VALID[kind](match):
                yield start, match.end(), kind


def hex_spans(data: np.ndarray) -> Iterator[tuple[int, int, str]]:
    if len(data) < HEX_CHARS:
        return
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = HEX[data]
    edges = np.flatnonzero(np.diff(inside))
    start, stop = edges[::2], edges[1::2]
    for i in np.flatnonzero(stop - start >= HEX_CHARS):
        yield int(start[i]), int(stop[i]), "hex"


def spans(text: bytes) -> list[tuple[int, int, int, str]]:
    """(start, order, stop, kind) of all secrets of a text in code points, sorted."""
    data = np.frombuffer(text, np.uint8)
    found = [*keyword_spans(text.decode("latin-1")), *hex_spans(data)]
    if not found:
        return []
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    return sorted((int(points[a]), KINDS.index(kind), int(points[b]), kind) for a, b, kind in found)


def found(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, spans (start, order, stop, kind) in order; the first orders are the base kinds."""

    def run(text: pa.Array) -> list[pa.Array]:
        texts = text.cast(pa.large_binary()).fill_null(b"")
        fields = [("start", pa.int32()), ("order", pa.int32()), ("stop", pa.int32()), ("kind", pa.string())]
        rows = [[dict(zip(("start", "order", "stop", "kind"), s)) for s in spans(t.as_py())] for t in texts]
        return [pa.array(rows, pa.list_(pa.struct(fields)))]

    return scored(pick(docs, doc_id=id_col, text=text_col), "text", f"spans {SPANS}", run).select("doc_id", "spans")


def text_of(spans_: Column) -> Column:
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def op13_secrets(spark, folder: str) -> DataFrame:
    """Secrets of all documents, as counts and digests."""
    rows = found(spark.read.parquet(f"{folder}/documents.parquet"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = text_of(F.filter("spans", lambda s: s["order"] < len(BASE)))
    return rows.select("doc_id", *[count(kind) for kind in BASE], F.sha2(base, 256).alias("base_sha256"), text_of(F.col("spans")).alias("spans"))
