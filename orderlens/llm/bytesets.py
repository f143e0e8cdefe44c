"""Texts of an Arrow batch as one numpy array of bytes, and hashed features of them.

All functions work on whole batches, so that a byte costs some nanoseconds. Texts are cut into
runs of about a megabyte, at document limits, which bounds the memory of a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

RUN_BYTES, RUN_DOCS = 1 << 20, 512
MIX = np.uint64(0x9E3779B97F4A7C15)
BLANKS = np.zeros(256, bool)
BLANKS[[9, 10, 11, 12, 13, 32]] = True

FOLD = np.arange(256, dtype=np.uint8)
FOLD[:128] = 32
FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the texts one after another, and the limits of each; a null is an empty text."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column) or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    limits = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    return np.frombuffer(column.buffers()[2], np.uint8)[limits[0] : limits[-1]], limits - limits[0]


def encoded(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    return text_bytes(pa.array(texts, pa.string()))


def folded(data: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and for the capital Latin letters after the lead byte C3."""
    out = FOLD[data]
    if len(data) > 1:
        capital = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][capital] += 0x20
    return out


def runs(limits: np.ndarray, size: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of documents of about ``size`` bytes, or one longer document."""
    first, last = 0, len(limits) - 1
    while first < last:
        fit = int(np.searchsorted(limits, limits[first] + size, "right")) - 1
        end = max(first + 1, min(first + RUN_DOCS, fit))
        yield first, end
        first = end


def owners(limits: np.ndarray) -> np.ndarray:
    """The document of every byte."""
    return np.repeat(np.arange(len(limits) - 1, dtype=np.int64), np.diff(limits))


def gram_codes(data: np.ndarray, owner: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Every run of ``length`` bytes within a document as a number, and its document."""
    n = len(data) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    code = data[:n].astype(np.uint64)
    for k in range(1, length):
        code = (code << np.uint64(8)) | data[k : n + k]
    within = owner[:n] == owner[length - 1 :]
    return code[within], owner[:n][within]


def bucket(code: np.ndarray, bits: int, salt: int) -> np.ndarray:
    """Buckets of numbers by multiplicative hashing."""
    mixed = (code + np.uint64(salt)) * MIX
    mixed ^= mixed >> np.uint64(29)
    return ((mixed * MIX) >> np.uint64(64 - bits)).astype(np.int64)


def word_limits(data: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of all documents start and end."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~BLANKS[data]
    start = inside[1:-1] & ~inside[:-2]
    end = inside[1:-1] & ~inside[2:]
    edges = limits[:-1][np.diff(limits) > 0]
    start[edges] = inside[1:-1][edges]
    last = limits[1:][np.diff(limits) > 0] - 1
    end[last] = inside[1:-1][last]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


STEP, BACK = 0x5851F42D4C957F2D, pow(0x5851F42D4C957F2D, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 1 to base ** n, modulo 2 ** 64; kept for runs of usual size."""
    if n > 2 * RUN_BYTES:
        return np.multiply.accumulate(np.full(n, base, np.uint64))
    if len(_powers.get(base, ())) < n:
        _powers[base] = np.multiply.accumulate(np.full(2 * RUN_BYTES, base, np.uint64))
    return _powers[base][:n]


def word_codes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit number for each word, the same for the same bytes, by a rolling polynomial."""
    if not len(start):
        return np.zeros(0, np.uint64)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(STEP, len(data)), out=total[1:])
    code = (total[end] - total[start]) * powers(BACK, len(data))[start]
    code ^= code >> np.uint64(31)
    return code * MIX + (end - start).astype(np.uint64)


_buckets: dict[tuple[int, int], np.ndarray] = {}


def gram_buckets(data: np.ndarray, length: int, bits: int) -> np.ndarray:
    """The bucket of every run of ``length`` bytes along the last axis; those of one or two bytes come from a table."""
    n = data.shape[-1] - length + 1
    if length > 2:
        code = data[..., :n].astype(np.uint64)
        for k in range(1, length):
            code <<= np.uint64(8)
            code |= data[..., k : n + k]
        code += np.uint64(length)
        code *= MIX
        code ^= code >> np.uint64(29)
        code *= MIX
        code >>= np.uint64(64 - bits)
        return code.view(np.int64)
    if (length, bits) not in _buckets:
        _buckets[length, bits] = bucket(np.arange(1 << 8 * length, dtype=np.uint64), bits, length)
    code = data[..., :n] if length == 1 else (data[..., :n].astype(np.uint16) << np.uint16(8)) | data[..., 1:]
    return _buckets[length, bits].take(code)


def hashed_counts(data: np.ndarray, limits: np.ndarray, lengths: tuple[int, ...], bits: int) -> np.ndarray:
    """Counts of hashed byte n-grams: a row for each document of the run."""
    docs = len(limits) - 1
    base, inner, cells = np.repeat(np.arange(docs) << bits, np.diff(limits)), limits[1:-1], []
    for length in lengths:
        n = len(data) - length + 1
        if n > 0:
            cell = gram_buckets(data, length, bits)
            cell += base[:n]
            for back in range(1, length):  # runs that cross a limit count in a cell of their own
                across = inner - back
                cell[across[(across >= 0) & (across < n)]] = docs << bits
            cells.append(cell)
    found = np.bincount(np.concatenate(cells) if cells else np.zeros(0, np.int64), minlength=(docs << bits) + 1)
    return found[: docs << bits].astype(np.float32).reshape(docs, 1 << bits)


def unit_rows(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; rows of zeros stay."""
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(length > 0, length, 1)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * np.asarray(x, np.float64)))
