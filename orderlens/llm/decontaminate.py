"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Texts are words of letters, digits and bytes above 127, in lower case. Every run of ``size`` words
of a test item is a seed. A first pass counts the documents of each seed. In every stretch of
``STRETCH`` neighbouring seeds of an item the rarer half, by rank and whatever the counts, are keys of the
item. Its common seeds are no keys alone, but two seeds that do not overlap and are at most
``REACH`` words apart in the item are a key together. So a word run that half the corpus has
joins nothing by itself, and an edited copy whose few whole runs are common ones is still found by two of them.

A second pass cuts out the regions around keys: a document's seed that is a key, and two seeds of it
that are one together. A region reaches as far as the items of the key are long, in classes by powers
of four. Equal passages are one from there on, whatever the number of documents that hold them,
and carry their places along. Passages meet items by a join on the key, and are
aligned with them word by word (match 2, other word -1, gap -1). The score is
that of the best local alignment over that of the whole item: 1 for a verbatim copy; one for which
a quarter of the words were exchanged still has about 0.6. A passage that has too few of the item's
words for the asked score, in any order, cannot reach it and is not aligned.

The passes look seeds and keys up in bitmaps of fixed size, so nothing that is broadcast grows with
the benchmark or the corpus; what a bitmap lets through by chance does not meet a key in the join.

Edge cases: null and empty texts hold no words; items of fewer than ``size`` words are not searched.
Repeated documents and items are each found. Rows without id are searched and give a null id. Ties
between alignments go to the one that ends first. An empty table on either side gives no rows.
Other columns of the input are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderlens.llm.bytesets import MIX, runs, text_bytes, word_codes, word_limits
from orderlens.llm.common import pick, quoted
from orderlens.session import cut_lineage, small_side

SIZE, LEAST = 3, 0.6
#: Neighbouring seeds of which the rarer half are keys; words between two seeds that are a key together,
#: in the item and in a document, where words may have been put in.
STRETCH, REACH, SPREAD = 8, 12, 24
BITMAP_BITS = 25
MATCH, OTHER, GAP = 2, -1, -1

WORD = np.full(256, 32, np.uint8)
for _first, _last in (("0", "9"), ("a", "z")):
    WORD[ord(_first) : ord(_last) + 1] = np.arange(ord(_first), ord(_last) + 1)
WORD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
WORD[128:] = np.arange(128, 256)


def seeds(data: np.ndarray, limits: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """Seeds of a run: code, first word, document; and where all words start and end."""
    start, end = word_limits(data, limits)
    code, doc = word_codes(data, start, end), np.searchsorted(limits, start, "right") - 1
    n = max(0, len(code) - size + 1)
    mixed = np.zeros(n, np.uint64)
    for k in range(size):
        mixed = (mixed ^ code[k : n + k]) * MIX
        mixed ^= mixed >> np.uint64(32)
    first = np.flatnonzero(doc[:n] == doc[size - 1 :][:n])
    return mixed[first].view(np.int64), first, doc[first], start, end, doc


def by_run(text: pa.Array, size: int) -> Iterator[tuple]:
    data, limits = text_bytes(text)
    data = WORD[data]
    for first, end in runs(limits):
        part = data[limits[first] : limits[end]]
        yield first, part, *seeds(part, limits[first : end + 1] - limits[first], size)


def in_bitmap(bitmap: np.ndarray, code: np.ndarray) -> np.ndarray:
    at = code.view(np.uint64) >> np.uint64(64 - BITMAP_BITS)
    return (bitmap[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) > 0


def bitmap_of(key_rows: DataFrame) -> np.ndarray:
    """One bit for each seed: 2 ** BITMAP_BITS bits, whatever the number of keys."""
    at = F.shiftrightunsigned("key", 64 - BITMAP_BITS)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))
    bits = key_rows.select(F.shiftright(at, 6).alias("slot"), bit.alias("bit"))
    found = bits.groupBy("slot").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (BITMAP_BITS - 6), np.uint64)
    out[found.column("slot").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def paired(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The key of two seeds in this order."""
    mixed = (left.view(np.uint64) * MIX) ^ (right.view(np.uint64) + MIX)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * MIX
    return (mixed ^ (mixed >> np.uint64(32))).view(np.int64)


def item_seeds(items: DataFrame, size: int) -> DataFrame:
    """(item, reach, at, seed, other): each seed of an item, alone and with each that may be a key with it.

    ``reach`` is the least power of four that the item has not more words than.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, _, code, first, doc, _, _, owner in by_run(batch.column(1), size):
                words = np.bincount(owner, minlength=int(doc.max(initial=-1)) + 1)
                reach = 4 ** np.ceil(np.log2(np.maximum(words, 1)) / 2).astype(np.int64)
                n, parts = len(code), [(np.arange(len(code)), None)]
                for step in range(size, REACH + 1):
                    near = np.arange(max(0, n - step))
                    parts.append((near[doc[near] == doc[near + step]], step))
                for at, step in parts:
                    other = pa.nulls(len(at), pa.int64()) if step is None else pa.array(code[at + step])
                    start = first[at] - np.searchsorted(owner, doc[at])
                    columns = [batch.column(0).take(pa.array(doc[at] + low)), pa.array(reach[doc[at]]), pa.array(start), pa.array(code[at]), other]
                    yield pa.RecordBatch.from_arrays(columns, ["item", "reach", "at", "seed", "other"])

    return items.select("item", "text").mapInArrow(run, "item long, reach long, at long, seed long, other long").distinct()


def seed_counts(docs: DataFrame, bitmap, size: int) -> DataFrame:
    """(seed, documents) of the seeds in the bitmap; a task adds up a batch before anything is dealt out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.zeros(0, np.int64)]
            for _, _, code, _, doc, _, _, _ in by_run(batch.column(0), size):
                hit = in_bitmap(bitmap.value, code)
                code, doc = code[hit], doc[hit]
                order = np.lexsort((code, doc))
                code, doc = code[order], doc[order]
                parts.append(code[np.append(True, (code[1:] != code[:-1]) | (doc[1:] != doc[:-1]))[: len(code)]])
            seed, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(seed), pa.array(n)], ["seed", "n"])

    return docs.select("text").mapInArrow(run, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("documents"))


def item_keys(every: DataFrame, counts: DataFrame) -> DataFrame:
    """(item, reach, key): in each stretch the rarer half of the seeds, and all pairs of seeds."""
    alone = every.where("other is null").join(counts, "seed", "left").fillna(0, ["documents"])
    stretch = [F.col("item"), F.floor(F.col("at") / STRETCH)]
    ranked = alone.withColumn("rank_", F.row_number().over(Window.partitionBy(*stretch).orderBy("documents", "seed", "at")))
    ranked = ranked.withColumn("of_", F.count(F.lit(1)).over(Window.partitionBy(*stretch)))
    rare = ranked.where(F.col("rank_") <= F.ceil(F.col("of_") / 2)).select("item", "reach", F.col("seed").alias("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = paired(*(batch.column(i).to_numpy().astype(np.int64) for i in (2, 3)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(key)], ["item", "reach", "key"])

    pairs = every.where("other is not null").select("item", "reach", "seed", "other")
    return rare.union(pairs.mapInArrow(run, "item long, reach long, key long")).distinct()


def key_hits(code: np.ndarray, first: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """Possible keys of a run's seeds: key, first word, word behind the last, document.

    A seed is one alone, and together with each of the two that follow it without overlap.
    """
    parts = [(code, first, first + size, doc)]
    after = np.searchsorted(first, first + size)
    for more in (0, 1):
        at = np.flatnonzero(after + more < len(code))
        other = after[at] + more
        near = (doc[at] == doc[other]) & (first[other] - first[at] <= SPREAD)
        at, other = at[near], other[near]
        parts.append((paired(code[at], code[other]), first[at], first[other] + size, doc[at]))
    return tuple(np.concatenate(part) for part in zip(*parts))


def regions(docs: DataFrame, seeds_bitmap, key_bitmaps, size: int) -> DataFrame:
    """(doc_id, place, region, reach, passage, found): words around keys, the digest of these words, the keys in them.

    Keys of one reach that are at most that many words apart share a region, which goes so far to both sides.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, place, reaches, passage, found = [], [], [], [], []
            for low, data, code, first, doc, start, end, owner in by_run(batch.column(0), size):
                hit = in_bitmap(seeds_bitmap.value, code)
                if not hit.any():
                    continue
                possible = key_hits(code[hit], first[hit], doc[hit], size)
                for reach, bitmap in key_bitmaps.value.items():
                    some = in_bitmap(bitmap, possible[0])
                    key, left_word, right_word, owner_doc = (part[some] for part in possible)
                    if not len(key):
                        continue
                    order = np.argsort(left_word, kind="stable")
                    key, left_word, right_word, owner_doc = (part[order] for part in (key, left_word, right_word, owner_doc))
                    new = np.append(True, (owner_doc[1:] != owner_doc[:-1]) | (left_word[1:] - left_word[:-1] > reach))
                    for a, b in zip(np.flatnonzero(new), np.append(np.flatnonzero(new)[1:], len(key))):
                        own = np.searchsorted(owner, [owner_doc[a], owner_doc[a] + 1])
                        left, right = max(own[0], left_word[a] - reach), min(own[1], right_word[a:b].max() + reach)
                        row.append(int(owner_doc[a]) + low)
                        place.append(int(left - own[0]))
                        reaches.append(reach)
                        passage.append(data[start[left] : end[right - 1]].tobytes())
                        found.append(np.unique(key[a:b]))
            columns = [
                batch.column(1).take(pa.array(row, pa.int64())),
                pa.array(place, pa.int64()),
                pa.array(reaches, pa.int64()),
                pa.array(passage, pa.binary()),
                pa.array(found, pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "place", "reach", "passage", "found"])

    cut = docs.select("text", "doc_id").mapInArrow(run, "doc_id long, place long, reach long, passage binary, found array<long>")
    digest = F.struct(F.xxhash64("passage", "reach").alias("h1"), F.xxhash64(F.lit(1), "passage", "reach").alias("h2"))
    return cut.withColumn("region", digest)


def aligned(passage: bytes, item: bytes) -> tuple[float, int]:
    """Best local alignment score over that of the whole item, and the passage's word where it ends."""
    a, b = item.split(), passage.split()
    number = {word: i for i, word in enumerate(dict.fromkeys(a))}
    codes = np.array([number.get(word, -1) for word in b])
    step = GAP * np.arange(len(b) + 1)
    row, best, at = np.zeros(len(b) + 1, np.int64), 0, 0
    for word in a:
        new = np.zeros(len(b) + 1, np.int64)
        new[1:] = np.maximum(row[:-1] + np.where(codes == number[word], MATCH, OTHER), row[1:] + GAP)
        # a gap in the item: the best cell to the left, less a step for each word between
        row = np.maximum(np.maximum.accumulate(np.maximum(new, 0) - step) + step, 0)
        if row.max() > best:
            best, at = int(row.max()), int(row.argmax())
    return best / (MATCH * len(a)), at


def reachable(passage: bytes, item: bytes) -> float:
    """No alignment scores more: the share of the item's words that the passage has, in any order."""
    need = Counter(item.split())
    return (need & Counter(passage.split())).total() / need.total()


def alignments(pairs: DataFrame, least: float) -> DataFrame:
    """(region, item, score, ends) of the ``pairs`` (region, item, passage, item_text) that score ``least`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                aligned(p, i) if reachable(p, i) >= least else (-1.0, 0) for p, i in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            ]
            score, at = np.array([f[0] for f in found], np.float64), np.array([f[1] for f in found], np.int64)
            good = pa.array(score >= least)
            columns = [column.filter(good) for column in (batch.column(0), batch.column(1), pa.array(score), pa.array(at))]
            yield pa.RecordBatch.from_arrays(columns, ["region", "item", "score", "ends"])

    ordered = pairs.select("region", "item", "passage", "item_text")
    return ordered.mapInArrow(run, "region struct<h1:long,h2:long>, item long, score double, ends long")


def normalised(items: DataFrame) -> DataFrame:
    """The words of each item, folded as those of the passages are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, limits = text_bytes(batch.column(1))
            raw = WORD[data].tobytes()
            texts = [raw[a:b] for a, b in zip(limits[:-1], limits[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], ["item", "item_text"])

    return items.select("item", "text").mapInArrow(run, "item long, item_text binary")


def leaks(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, score, end_word) for every document and item that align with ``least`` or more.

    ``end_word`` is the word of the document at which the best alignment ends.
    """
    spark = docs.sparkSession
    rows = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), "text")
    items = pick(benchmark, item=item_col, text=item_text).select(F.col("item").cast("long"), "text")
    every = cut_lineage(item_seeds(items, size))
    reaches = [r.reach for r in every.select("reach").distinct().collect()]  # a handful of powers of four
    if not reaches:
        return spark.createDataFrame([], "doc_id long, item_id long, score double, end_word long")
    seeds_bitmap = spark.sparkContext.broadcast(bitmap_of(every.select(F.col("seed").alias("key"))))
    keys = cut_lineage(item_keys(every, seed_counts(rows, seeds_bitmap, size)))
    key_bitmaps = spark.sparkContext.broadcast({reach: bitmap_of(keys.where(F.col("reach") == reach)) for reach in sorted(reaches)})
    cut = cut_lineage(regions(rows, seeds_bitmap, key_bitmaps, size))
    passages = cut.groupBy("region").agg(F.first("passage").alias("passage"), F.first("reach").alias("reach"), F.first("found").alias("found"))
    met = passages.select("region", "reach", F.explode("found").alias("key")).join(keys, ["key", "reach"])
    pairs = met.select("region", "item").distinct().join(passages.select("region", "passage"), "region")
    texts = normalised(items).withColumnRenamed("item", "item_").distinct()
    good = alignments(pairs.join(texts, F.col("item").eqNullSafe(F.col("item_"))), least)
    found = good.join(cut.select("region", "doc_id", "place"), "region").withColumn("end_word", F.col("place") + F.col("ends"))
    best = found.groupBy("doc_id", "item").agg(F.max(F.struct("score", (-F.col("end_word")).alias("end"))).alias("best"))
    return best.select("doc_id", F.col("item").alias("item_id"), "best.score", (-F.col("best.end")).alias("end_word"))


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """The rows of ``docs`` whose id has no leak; rows without id go by the leaks of such rows."""
    leaked = small_side(leaks(docs, benchmark, id_col=id_col, **how).select(F.col("doc_id").alias("leaked_")).distinct())
    named, same = leaked.where("leaked_ is not null"), quoted(id_col) == F.col("leaked_")
    # rows without id are apart: in a join they would all be one key
    without = docs.where(quoted(id_col).isNull() & F.lit(leaked.where("leaked_ is null").isEmpty()))
    return docs.where(quoted(id_col).isNotNull()).join(named, same, "left_anti").unionByName(without)


def op3_decontaminate(spark, folder: str) -> DataFrame:
    """All pairs of a document and a test item that it holds a copy of."""
    docs, items = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "benchmark"))
    return leaks(docs, items)
