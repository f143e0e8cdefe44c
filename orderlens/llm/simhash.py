"""SimHash near-duplicates by pivot distance tables.

A fingerprint has one bit for each of the 64 bits of the XXH64 values of a text's word shingles:
1 if the bit is set in over half of them. Documents link when their fingerprints differ in at most
``most`` bits, and a component is what links reach.

Candidates come from distances to reference fingerprints. 48 references are masked to one of four
blocks of 16 bits. Two fingerprints that differ in at most two bits agree in at least two blocks,
so there they have the very same distances to all references: each fingerprint is dealt to six
cells, one for each pair of blocks, keyed by its distances. Within a cell, pairs are discarded when
the distances to any of 16 whole reference fingerprints differ by more than ``most`` (by the
triangle inequality the fingerprints then differ in more bits); what survives is verified bit by
bit. No link is lost. The fingerprints of a cell with more than
``CELL_ROWS`` are dealt again by the same rule over blocks of 8, then of 4 bits, where a cell holds
a few hundred at most; so no task compares an unbounded group, and a cell gives back a spanning
forest of its links, never all pairs.

Exact copies share a fingerprint and are one row from the start. Links become components by
hooking and shortcutting over distributed tables; only counters reach the driver.

Edge cases: a null text has no words; no words give fingerprint zero, linked like any other; fewer
words than a shingle has give the whole sequence as one shingle. Repeated rows get repeated
results. Rows without id get the component's smallest id, null if none of them has one. Other
columns of the input are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.llm.common import pick, quoted, scored
from orderlens.session import cut_lineage

BITS, SEED = 64, 42
CELL_ROWS = 4096
REFERENCES_A_BLOCK, PIVOTS = 12, 16


def signed(number: int) -> int:
    """A 64-bit pattern as the long that Spark holds."""
    return number - (1 << 64) if number >> 63 else number


def references(count: int, bits: int, salt: int) -> list[int]:
    """Reference patterns by a fixed rule."""
    return [xxhash.xxh64_intdigest(b"%d/%d" % (salt, i), SEED) >> (64 - bits) for i in range(count)]


PIVOT_PATTERNS = np.array(references(PIVOTS, 64, 0), np.uint64)


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 of every shingle of ``size`` words, repeats included."""
    words = text.lower().split()
    if len(words) < size:
        shingles = [b" ".join(words)] if words else []
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(size))))
    return np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), shingles), np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(BITS, np.int64)
    for first in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[first : first + (1 << 16)], ">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, size: int = 3, text_col: str = "text", name: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of each text as a long."""

    def run(text: pa.Array) -> list[pa.Array]:
        texts = text.cast(pa.large_binary()).fill_null(b"")
        found = (majority(shingle_hashes(t.as_py(), size)) for t in texts)
        return [pa.array(np.fromiter(found, np.uint64, len(texts)).view(np.int64))]

    return scored(docs, text_col, f"{name} long", run)


def block_distances(fingerprint: Column, block: int, width: int, salt: int) -> Column:
    """Distances to the references of one block of bits, 5 bits of a long for each."""
    mask = ((1 << width) - 1) << (block * width)
    packed = F.lit(0).cast("long")
    for j, pattern in enumerate(references(REFERENCES_A_BLOCK, width, 1 + salt + block)):
        differing = fingerprint.bitwiseXOR(F.lit(signed(pattern << (block * width)))).bitwiseAND(F.lit(signed(mask)))
        packed = packed.bitwiseOR(F.shiftleft(F.bit_count(differing).cast("long"), 5 * j))
    return packed


def dealt(distinct: DataFrame, most: int, width: int) -> DataFrame:
    """Each fingerprint in the cells of all choices of blocks that ``most`` bits may leave alone."""
    blocks = range(BITS // width)
    rows = distinct.select("fp", *[block_distances(F.col("fp"), b, width, 100 * width).alias(f"d{b}") for b in blocks])
    keys = [
        F.xxhash64(F.lit(width), F.lit(i), *[F.col(f"d{b}") for b in chosen])
        for i, chosen in enumerate(combinations(blocks, len(blocks) - most))
    ]
    return rows.select(F.explode(F.array(*keys)).alias("cell"), "fp")


def cell_links(cell: np.ndarray, fp: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within cells (rows sorted by cell), as a spanning forest of row numbers."""
    n = len(fp)
    distance = np.bitwise_count(fp[:, None] ^ PIVOT_PATTERNS[None, :]).astype(np.int8)
    left, right = [], []
    at = np.arange(n)
    for step in range(1, n):
        at = at[at + step < n]
        at = at[cell[at] == cell[at + step]]
        if not len(at):
            break
        alive = at
        for pivot in range(PIVOTS):
            alive = alive[np.abs(distance[alive, pivot] - distance[alive + step, pivot]) <= most]
        alive = alive[np.bitwise_count(fp[alive] ^ fp[alive + step]) <= most]
        left.append(alive)
        right.append(alive + step)
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    linked = np.flatnonzero(root != np.arange(n))
    return linked, root[linked]


def compared(cells: DataFrame, most: int) -> DataFrame:
    """Links (a, b) of fingerprints that share a cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64))

        def found(cell: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            node, root = cell_links(cell, fp.view(np.uint64), most)
            pairs = np.unique(np.stack([fp[node], fp[root]], 1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])

        for batch in batches:
            cell = np.concatenate([held[0], batch.column(0).to_numpy()])
            fp = np.concatenate([held[1], batch.column(1).to_numpy()])
            # the last cell may go on in the next batch
            whole = int(np.searchsorted(cell, cell[-1], "left")) if len(cell) else 0
            held = (cell[whole:], fp[whole:])
            if whole:
                yield found(cell[:whole], fp[:whole])
        if len(held[0]):
            yield found(*held)

    parts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_cells = cells.distinct().repartition(parts, "cell").sortWithinPartitions("cell", "fp")
    return sorted_cells.mapInArrow(run, "a long, b long")


def links(distinct: DataFrame, most: int = 2, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Links (a, b) between the fingerprints ``fp`` that differ in at most ``most`` (0 to 7) bits.

    Their transitive closure is that of all links; within a cell only a spanning forest is given.
    """
    if not 0 <= most <= 7:
        raise ValueError("most must be 0 to 7")
    widths = [w for w in (16, 8, 4) if BITS // w > most]
    out, rows = None, distinct.select("fp")
    for width in widths:
        cells = dealt(rows, most, width)
        crowded = cut_lineage(cells.groupBy("cell").count().where(F.col("count") > cell_rows).select("cell"))
        last = width == widths[-1] or crowded.isEmpty()
        found = compared(cells if last else cells.join(crowded, "cell", "left_anti"), most)
        out = found if out is None else out.union(found)
        if last:
            return out
        # two fingerprints that share a crowded cell meet again in narrower ones
        rows = cut_lineage(cells.join(crowded, "cell").select("fp").distinct())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the smallest node it can reach.

    Each round hooks a node's root to the smallest grandparent among its neighbours and halves the
    paths, so that rounds grow with the logarithm of the longest path. State goes to the shared
    folder after each round.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = cut_lineage(both.where("a != b").distinct())
    state = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
    state = cut_lineage(state.select("node", F.least("node", "low").alias("root")))
    while True:
        above = state.select(F.col("node").alias("root"), F.col("root").alias("above"))
        grand = state.join(above, "root").select("node", "root", "above")
        seen = both.join(grand.select(F.col("node").alias("b"), F.col("above").alias("low")), "b")
        least = seen.groupBy(F.col("a").alias("node")).agg(F.min("low").alias("low"))
        known = grand.join(least, "node").withColumn("low", F.least("low", "above"))
        hooks = known.select(
            F.explode(F.array(F.struct(F.col("node"), "low"), F.struct(F.col("root").alias("node"), "low"))).alias("h")
        )
        new = cut_lineage(hooks.groupBy("h.node").agg(F.min("h.low").alias("root")))
        changed = new.join(state.withColumnRenamed("root", "old"), "node").where("root != old")
        done = changed.isEmpty()
        state = new
        if done:
            return state


def grouped(
    docs: DataFrame, size: int = 3, most: int = 2, id_col: str = "doc_id", text_col: str = "text", cell_rows: int = CELL_ROWS
) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_hash, fingerprint (long), component_id, first.

    ``text_hash`` tells rows without id, or with the same id, apart; ``first`` marks the rows that
    stand for their component: those with the smallest id, then the smallest hash.
    """
    rows = pick(docs, doc_id=id_col, text=text_col)
    keyed = fingerprints(rows.withColumn("text_hash", F.xxhash64("text")), size, "text", "fp")
    keyed = cut_lineage(keyed.select("fp", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash").alias("row")))
    own = cut_lineage(keyed.groupBy("fp").agg(F.min("row").alias("own")))
    joined = cut_lineage(components(links(own.select("fp"), most, cell_rows)))
    rooted = own.join(joined.withColumnRenamed("node", "fp"), "fp", "left")
    merged = rooted.where("root is not null").groupBy("root").agg(F.min("own").alias("merged"))
    named = rooted.join(merged, "root", "left").select("fp", F.coalesce("merged", "own").alias("head"))
    return keyed.join(named, "fp").select(
        "row.doc_id",
        "row.text_hash",
        F.col("fp").alias("fingerprint"),
        F.col("head.doc_id").alias("component_id"),
        (F.col("row") == F.col("head")).alias("first"),
    )


def deduplicated(docs: DataFrame, size: int = 3, most: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stand for their component, one for each.

    Of rows with the same id and text one stays. The texts move once, by id and text hash, which no
    group of copies makes uneven.
    """
    first = grouped(docs, size, most, id_col, text_col).where("first")
    first = first.select(F.struct("doc_id", "text_hash").alias("key_")).distinct()
    keyed = docs.withColumn("key_", F.struct(quoted(id_col).alias("doc_id"), F.xxhash64(quoted(text_col)).alias("text_hash")))
    return keyed.join(first, "key_", "left_semi").dropDuplicates(["key_"]).drop("key_")


def op6_simhash(spark, folder: str) -> DataFrame:
    """Fingerprint and component of every document: 3-word shingles, at most 2 differing bits."""
    found = grouped(spark.read.parquet(f"{folder}/documents.parquet"), 3, 2)
    text = F.lpad(F.lower(F.hex("fingerprint")), 16, "0")
    return found.select("doc_id", text.alias("fingerprint"), "component_id")
