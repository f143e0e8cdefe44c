"""Fill-in-the-middle: a text is cut in three and written prefix, suffix, middle or suffix, prefix, middle.

A text is a row of units, code points or words with the blanks after them. They are the lowest lane of
an indexable skip list; of every lane above, one link spans ``FAN`` links of the lane below and carries
its widths: how many units, code points and bytes it passes. A cut at a unit rank starts in the top
lane and goes along it while the accumulated units stay within the rank, then a lane down, and so on;
what it has passed is the place of the cut in code points and bytes, exactly, after at most ``FAN``
links in each lane. The ranks are draws from the digest of the document's id.

Texts are handled as bytes, so no text, however long or badly encoded, is copied but into its output.
``restored`` takes an output apart again at its marks; a text that holds a mark itself stays plain.

Edge cases: a null or empty text has no units, is plain and gives an empty output. A row without id
draws from the empty id. Repeated rows get repeated results. Very long texts are cut like others. A text of one unit has one
empty part at least, ties between the two ranks make the middle empty. Other columns pass through, those
with the name of a result are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.llm.bytesets import BLANKS
from orderlens.llm.common import pick, quoted, scored

FAN = 32
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: In hundredths: draws from here on leave a text plain; below here the suffix comes first.
PLAIN_FROM, SPM_BELOW = 90, 20
RESULT = "n long, form string, prefix_chars long, middle_chars long, output string"


class SkipList:
    """Lanes of links, each with its widths in units, code points and bytes; the lowest lane has the units."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        widths = np.stack([np.ones(len(points), np.int64), points, sizes])
        self.lanes = [widths]
        while widths.shape[1] > FAN:
            widths = np.add.reduceat(widths, np.arange(0, widths.shape[1], FAN), axis=1)
            self.lanes.append(widths)

    def place(self, rank: int) -> tuple[int, int]:
        """Code points and bytes before the unit of this rank."""
        at, left, points, sizes = 0, rank, 0, 0
        for widths in reversed(self.lanes):
            links = widths[:, at : at + FAN]
            passed = int(np.searchsorted(np.cumsum(links[0]), left, "right"))
            units, more_points, more_sizes = links[:, :passed].sum(1).tolist()
            left, points, sizes = left - units, points + more_points, sizes + more_sizes
            at = (at + passed) * FAN
        return points, sizes


def unit_starts(data: np.ndarray, unit: str) -> np.ndarray:
    """First bytes of the units of a text; the units tile it."""
    if unit == "char":
        first = (data & 0xC0) != 0x80
    elif unit == "word":
        blank = BLANKS[data]
        first = ~blank
        first[1:] &= blank[:-1]
    else:
        raise ValueError(f"unknown unit: {unit}")
    first[:1] = True
    return np.flatnonzero(first)


def skip_list(data: np.ndarray, unit: str) -> SkipList:
    starts = unit_starts(data, unit)
    sizes = np.diff(np.append(starts, len(data)))
    if unit == "char" or not len(data):
        return SkipList(np.ones(len(starts), np.int64), sizes)
    return SkipList(np.add.reduceat(((data & 0xC0) != 0x80).astype(np.int64), starts), sizes)


def draws(ident: str) -> list[int]:
    """Four numbers of 32 bits for a document."""
    digest = hashlib.sha256(f"1:{ident}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4)]


def infilled(text: bytes, ident: str, unit: str = "char") -> tuple[int, str, int | None, int | None, bytes]:
    """Units, form, code points of prefix and middle (none if plain), output."""
    data = np.frombuffer(text, np.uint8)
    units = skip_list(data, unit)
    n = units.lanes[0].shape[1]
    h1, h2, h3, h4 = draws(ident)
    if not n or h3 % 100 >= PLAIN_FROM or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    (points, a), (upto, b) = units.place(first), units.place(second)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < SPM_BELOW:
        return n, "spm", points, upto - points, b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return n, "psm", points, upto - points, b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def original(output: bytes, form: str) -> bytes:
    """The text that an output of this form was made from."""
    if form == "plain":
        return output
    outer, inner = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    head, middle = output.removeprefix(outer).split(MIDDLE, 1)
    one, other = head.split(inner, 1)
    return one + middle + other if form == "psm" else other + middle + one


def as_texts(values: list[bytes]) -> pa.Array:
    """Bytes as a column of texts, as they are."""
    return pa.array(values, pa.binary()).cast(pa.string(), safe=False)


def transformed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "char") -> DataFrame:
    """``docs`` with n, form, prefix_chars, middle_chars and output."""

    def run(text: pa.Array, ident: pa.Array) -> list[pa.Array]:
        texts = text.cast(pa.large_binary()).fill_null(b"")
        found = [infilled(t.as_py(), i or "", unit) for t, i in zip(texts, ident.to_pylist())]
        n, form, prefix, middle, output = zip(*found) if found else ((),) * 5
        return [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), as_texts(output)]

    return scored(docs, text_col, RESULT, run, ident=quoted(id_col).cast("string"))


def restored(docs: DataFrame, output_col: str = "output", form: Column | None = None, name: str = "restored") -> DataFrame:
    """``docs`` with the texts that their outputs were made from."""

    def run(output: pa.Array, forms: pa.Array) -> list[pa.Array]:
        outputs = output.cast(pa.large_binary()).fill_null(b"")
        return [as_texts([original(o.as_py(), f) for o, f in zip(outputs, forms.to_pylist())])]

    return scored(docs, output_col, f"{name} string", run, form=F.col("form") if form is None else form)


def op12_fill_in_middle(spark, folder: str) -> DataFrame:
    """Cuts and digests of all documents, with code points as units."""
    docs = pick(spark.read.parquet(f"{folder}/documents.parquet"), doc_id="doc_id", text="text")
    back = restored(transformed(docs).drop("text"))
    digest = lambda name: F.sha2(F.col(name), 256).alias(f"{name}_sha256")
    return back.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output"), digest("restored"))


SQL = """
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS x, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), d AS (
  SELECT doc_id, x, CAST(length(x) AS BIGINT) AS n,
         CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
  FROM t
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN n = 0 OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM d
), o AS (
  SELECT *, CASE form WHEN 'plain' THEN x
         WHEN 'psm' THEN '<P>' || substr(x, 1, a) || '<S>' || substr(x, b + 1) || '<M>' || substr(x, a + 1, b - a)
         ELSE '<S>' || substr(x, b + 1) || '<P>' || substr(x, 1, a) || '<M>' || substr(x, a + 1, b - a) END AS out
  FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(out) AS output_sha256, sha256(x) AS restored_sha256
FROM o
"""
