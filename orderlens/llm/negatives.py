"""Hard-negative mining by an L2AP-style threshold join.

Every vector is taken as whole numbers, floor(256 x), and scored by its inner product with an anchor.
An anchor's positives are the best other rows of its label; the negatives of a positive are the best
rows of other labels whose score lies between two shares of the positive's score (its *window*).

Rows meet anchors in a threshold join (``survivors``). The dimensions are ordered by their mean
square over all rows and cut into segments, the postings of the index. A row is posted in a segment
only while the norm of its remaining dimensions, times the largest such norm of the anchors, could
reach the lowest threshold alone; the suffix behind that is covered by the bound and left out. Scores
are accumulated segment by segment, and a pair goes as soon as its partial score plus the product of
both remaining norms stays below the anchor's threshold. The pairs that are left are completed with the
dimensions that the index left out.

Thresholds start where a normal distribution with the moments of all rows expects ``FIRST`` rows and
are lowered, for the anchors whose windows are not full, until each window is full or has reached its
own lower end. Within a task a threshold rises to the last kept score once a window is full there. So
thresholds steer the work only; the result is exact.

Anchors go through in blocks of about ``BLOCK``, each broadcast to all rows; a task gives back at most
``positives`` or ``negatives`` rows a window, whatever the number of rows with equal vectors. Only the
positives of one block and counts reach the driver.

Edge cases: rows with a null id, label or vector, or with a null or non-finite component, take no part.
Components beyond 2 ** 22 in size are taken as that;
scores are exact up to 2 ** 53. Vectors of different lengths are filled up with
zeros; an empty vector scores zero with all. Ties go to the smaller id. Repeated rows each take a place;
rows with the anchor's own id are not its positives; repeated anchors give repeated results. A label with too few rows gives
fewer positives, an empty table no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlens.llm.common import pick
from orderlens.session import cut_lineage, scratch_path, small_side

SCALE, LARGEST = 256.0, 1 << 22
POSITIVES, NEGATIVES = 5, 10
#: The window of a positive in hundredths of its score.
LEAST, MOST = 30, 90
BLOCK, PAIRS = 4096, 1 << 20
SEGMENTS = 4
#: Rows that the first threshold of a window is to let through, and how many times more the next one.
FIRST, MORE = 40, 16
#: Share of living pairs below which the scores are accumulated pair by pair.
SPARSE = 0.1
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def whole_numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Components of all vectors as whole numbers, the length of each vector, and which vectors are complete."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    fine = np.bincount(owner, weights=~np.isfinite(values), minlength=len(lengths)) == 0
    whole = np.floor(SCALE * np.where(np.isfinite(values), values, 0))
    return np.clip(whole, -LARGEST, LARGEST).astype("<i4"), lengths, fine


def prepared(rows: DataFrame) -> DataFrame:
    """(id, label, vector) of the rows (id, label, vector) that take part; vectors as 32-bit whole numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.and_(pc.and_(batch.column(0).is_valid(), batch.column(1).is_valid()), batch.column(2).is_valid()))
            whole, lengths, fine = whole_numbers(batch.column(2))
            limits = np.concatenate([[0], 4 * np.cumsum(lengths)]).astype(np.int32)
            vectors = pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(limits), pa.py_buffer(whole)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), vectors], ["id", "label", "vector"]).filter(pa.array(fine))

    typed = rows.select(F.col("id").cast("long"), F.col("label").cast("long"), F.col("vector").cast("array<double>"))
    return typed.mapInArrow(run, "id long, label long, vector binary")


def matrix(vectors: pa.Array, order: np.ndarray) -> np.ndarray:
    """Vectors as rows, their dimensions in the given order; what a vector lacks is zero."""
    lengths = pc.binary_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64) // 4
    flat = np.frombuffer(b"".join(vectors.to_pylist()), "<i4")
    if (lengths == len(order)).all():
        full = flat.reshape(len(lengths), len(order))
    else:
        full = np.zeros((len(lengths), len(order)), "<i4")
        full[np.arange(len(order)) < lengths[:, None]] = flat
    return full[:, order].astype(np.int64)


@dataclass
class Moments:
    """Mean and variance of every dimension over all rows, and the order of the dimensions."""

    rows: int
    mean: np.ndarray
    variance: np.ndarray
    order: np.ndarray


def moments(rows: DataFrame) -> Moments:
    """Each task sums its rows by dimension; the driver gets one row for each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((0, 2))
        for batch in batches:
            widest = max(pc.max(pc.binary_length(batch.column(0))).as_py() or 0, 0) // 4
            x = matrix(batch.column(0), np.arange(widest)).astype(np.float64)
            total = np.pad(total, ((0, max(0, widest - len(total))), (0, 0)))
            total[:widest] += np.stack([x.sum(0), (x * x).sum(0)], 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total[:, 0]), pa.array(total[:, 1])], ["dim", "s", "s2"])

    found = rows.select("vector").mapInArrow(run, "dim long, s double, s2 double").groupBy("dim").agg(F.sum("s"), F.sum("s2"))
    sums = np.array(sorted(map(tuple, found.collect()))).reshape(-1, 3)
    n = rows.count()
    mean, square = sums[:, 1] / max(n, 1), sums[:, 2] / max(n, 1)
    order = np.lexsort((np.arange(len(square)), -square))
    return Moments(n, mean[order], np.maximum(square - mean * mean, 0)[order], order)


@dataclass
class Anchors:
    """A block of anchors; ``low`` and ``high`` are the windows (a row for each anchor) that rows may score in."""

    number: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def only(self, which: np.ndarray) -> Anchors:
        return Anchors(*(getattr(self, name)[which] for name in ("number", "ids", "labels", "vectors", "low", "high")))


def suffix_norms(x: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Norm of what is left of every row from each cut on, a little enlarged for rounding."""
    squares = np.stack([(x[:, a:b].astype(np.float64) ** 2).sum(1) for a, b in zip(cuts[:-1], cuts[1:])], 1)
    left = np.cumsum(squares[:, ::-1], 1)[:, ::-1]
    return np.pad(np.sqrt(left) * (1 + 1e-9), ((0, 0), (0, 1)))


def survivors(x: np.ndarray, q: np.ndarray, threshold: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, score) of every pair that scores the anchor's ``threshold`` or more."""
    size, threshold = max(x.shape[1], 1), np.asarray(threshold, np.float64)
    # doubles hold all sums of these products exactly, and are the faster ones
    exact = np.abs(x).max(initial=0).astype(float) * np.abs(q).max(initial=0) * size < 2**52
    x, q = (x.astype(np.float64), q.astype(np.float64)) if exact else (x, q)
    cuts = np.unique(np.linspace(0, size, min(SEGMENTS, size) + 1).astype(int))
    left, right = suffix_norms(x, cuts), suffix_norms(q, cuts)
    lowest, segments = threshold.min(initial=np.inf), len(cuts) - 1
    posted = (left[:, :-1] * right[:, :-1].max(0, initial=0) >= lowest).sum(1)  # segments that the index holds of a row
    row = np.flatnonzero(posted > 0) if lowest > 0 else np.arange(len(x))
    posted = np.where(lowest > 0, posted, segments)
    partial = np.zeros((len(row), len(q)), x.dtype)
    done = 0
    while done < segments:  # whole segments at once, as long as many pairs live
        inside = posted[row] > done
        partial[inside] += x[row[inside], cuts[done] : cuts[done + 1]] @ q[:, cuts[done] : cuts[done + 1]].T
        done += 1
        at = np.minimum(done, posted[row])
        alive = partial + left[row, at][:, None] * right.T[at] >= threshold
        if alive.mean() < SPARSE if alive.size else True:
            break
    at, anchor = np.nonzero(alive) if partial.size else (np.zeros(0, np.int64),) * 2
    score, row = partial[at, anchor], row[at]
    upto = np.minimum(posted[row], done)
    for k in range(segments):  # the rest pair by pair, first what the index holds, in the end what it left out
        missing = upto <= k
        if missing.any():
            part = slice(cuts[k], cuts[k + 1])
            score[missing] += (x[row[missing], part] * q[anchor[missing], part]).sum(1)
            keep = score + left[row, k + 1] * right[anchor, k + 1] >= threshold[anchor]
            keep |= upto > k + 1
            row, anchor, score, upto = row[keep], anchor[keep], score[keep], upto[keep]
    good = score >= threshold[anchor]
    return row[good], anchor[good], score[good].astype(np.int64)


def best_of(slot: np.ndarray, score: np.ndarray, ident: np.ndarray, most: int) -> tuple[np.ndarray, ...]:
    """The ``most`` best of each slot: higher scores first, then smaller ids; sorted."""
    order = np.lexsort((ident, -score, slot))
    slot, score, ident = slot[order], score[order], ident[order]
    rank = np.arange(len(slot)) - np.searchsorted(slot, slot, "left")
    return slot[rank < most], score[rank < most], ident[rank < most]


def joined(rows: DataFrame, anchors: Anchors, order: np.ndarray, same: bool, most: int) -> DataFrame:
    """(anchor, window, place, score, id): the ``most`` best rows of each window of each anchor.

    ``same`` asks for rows of the anchor's label, other than itself, else for rows of other labels.
    """
    held = rows.sparkSession.sparkContext.broadcast(anchors)
    windows = anchors.low.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = held.value
        low, best = a.low.astype(np.float64), (np.zeros(0, np.int64),) * 3
        step = max(1, PAIRS // max(1, len(a.ids)))
        for batch in batches:
            ids, labels = (batch.column(i).to_numpy() for i in (0, 1))
            for first in range(0, batch.num_rows, step):
                part = slice(first, first + step)
                x = matrix(batch.column(2)[part], order)
                row, anchor, score = survivors(x, a.vectors, low.min(1))
                row = row + first
                fits = labels[row] == a.labels[anchor]
                fits = fits & (ids[row] != a.ids[anchor]) if same else ~fits
                row, anchor, score = row[fits], anchor[fits], score[fits]
                found = [best]
                for w in range(windows):
                    inside = (score >= low[anchor, w]) & (score <= a.high[anchor, w])
                    found.append((anchor[inside] * windows + w, score[inside], ids[row[inside]]))
                best = best_of(*(np.concatenate(parts) for parts in zip(*found)), most)
                slots, n = np.unique(best[0], return_counts=True)
                full = slots[n == most]
                last = best[1][np.searchsorted(best[0], full, "right") - 1]
                low.reshape(-1)[full] = last  # an equal score may still win by its id
        slot, score, ident = best
        columns = [pa.array(v) for v in (a.number[slot // windows], slot % windows, score, ident)]
        yield pa.RecordBatch.from_arrays(columns, ["anchor", "window", "score", "id"])

    found = rows.mapInArrow(run, "anchor long, window long, score long, id long")
    ranks = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "id")
    return found.withColumn("place", F.row_number().over(ranks)).where(F.col("place") <= most)


def level(expected: np.ndarray, mean: np.ndarray, deviation: np.ndarray) -> np.ndarray:
    """The score that a share ``expected`` of normally distributed scores reaches; no limit from a half on."""
    normal = NormalDist()
    z = np.array([normal.inv_cdf(1 - e) if 0 < e < 0.5 else -math.inf for e in expected])
    return np.where(np.isfinite(z), np.floor(mean + np.where(np.isfinite(z), z, 0) * deviation), -np.inf)


def positives_of(rows: DataFrame, block: Anchors, sizes: np.ndarray, about: Moments, most: int) -> list[tuple]:
    """(anchor, place, positive, score) of a block, which bounds what the driver gets."""
    mean, deviation = block.vectors @ about.mean, np.sqrt((block.vectors.astype(float) ** 2) @ about.variance)
    need = np.minimum(most, sizes - 1)
    found, expected, todo = [], np.full(len(sizes), float(FIRST)), np.flatnonzero(need > 0)
    while len(todo):
        low = level(expected[todo] / sizes[todo], mean[todo], deviation[todo])
        asked = replace(block.only(todo), low=low[:, None], high=np.full((len(todo), 1), np.inf))
        hits = joined(rows, asked, about.order, True, most).select("anchor", "place", "id", "score").collect()
        got = np.bincount([h.anchor for h in hits], minlength=len(sizes))[todo]
        full = (got >= need[todo]) | np.isneginf(low)
        done = set(todo[full].tolist())
        found += [tuple(h) for h in hits if h.anchor in done]
        todo = todo[~full]
        expected *= MORE
    return found


def negatives_of(rows: DataFrame, block: Anchors, positives: list[tuple], about: Moments, most: int, least: int, upto: int, places: int) -> Iterator[DataFrame]:
    """(anchor, window, place, score, id) of the windows of a block, each as soon as it is full."""
    low, high = np.full((len(block.ids), places), np.inf), np.full((len(block.ids), places), -np.inf)
    for anchor, place, _, score in positives:
        low[anchor, place - 1], high[anchor, place - 1] = -(-least * score // 100), upto * score // 100
    low, high = np.where(low > high, np.inf, low), np.where(low > high, -np.inf, high)
    mean, deviation = block.vectors @ about.mean, np.sqrt((block.vectors.astype(float) ** 2) @ about.variance)
    open_, expected = np.isfinite(low), float(FIRST)
    while open_.any():
        todo = np.flatnonzero(open_.any(1))
        z = (high[todo] - mean[todo, None]) / np.maximum(deviation[todo, None], 1e-9)
        above = 0.5 * np.vectorize(math.erfc, otypes=[float])(np.where(open_[todo], z, 0) / math.sqrt(2))
        share = above + expected / max(about.rows, 1)
        start = np.stack([level(share[:, w], mean[todo], deviation[todo]) for w in range(places)], 1)
        start = np.where(open_[todo], np.maximum(low[todo], np.minimum(start, high[todo])), np.inf)
        if expected > FIRST * MORE:
            start = np.where(open_[todo], low[todo], np.inf)
        asked = replace(block.only(todo), low=start, high=np.where(open_[todo], high[todo], -np.inf))
        hits = cut_lineage(joined(rows, asked, about.order, False, most))
        counts = np.zeros(low.shape, np.int64)
        for anchor, window, n in hits.groupBy("anchor", "window").agg(F.count(F.lit(1))).collect():
            counts[anchor, window] = n
        full = open_.copy()
        full[todo] &= (counts[todo] >= most) | (start <= low[todo])
        slots = [(int(a), int(w)) for a, w in np.argwhere(full)]
        settled = rows.sparkSession.createDataFrame(slots, "anchor long, window long")  # at most a block's windows
        yield hits.join(F.broadcast(settled), ["anchor", "window"], "left_semi")
        open_ &= ~full
        expected *= MORE


def mined(vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``is_anchor`` is a condition on the column ``id``.
    """
    spark = vectors.sparkSession
    rows = cut_lineage(prepared(pick(vectors, id=id_col, label=label_col, vector=vector_col)))
    about = moments(rows)
    sizes = small_side(rows.groupBy("label").agg(F.count(F.lit(1)).alias("size")))
    anchors = cut_lineage(rows.where(is_anchor).join(sizes, "label").select("id", "label", "vector", "size"))
    blocks = math.ceil(anchors.count() / block)
    if not blocks:
        return spark.createDataFrame([], RESULT)
    # stored rows keep their numbers
    dealt = anchors.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)))
    path = scratch_path(spark, "negatives")
    spark.createDataFrame([], RESULT).write.parquet(path)
    for b in range(blocks):
        held = dealt.where(F.col("block") == b).toArrow()
        n = held.num_rows
        if not n:
            continue
        vectors_ = matrix(held.column("vector").combine_chunks(), about.order)
        empty = np.zeros((n, 1))
        one = Anchors(np.arange(n), held.column("id").to_numpy(), held.column("label").to_numpy(), vectors_, empty, empty)
        best = positives_of(rows, one, held.column("size").to_numpy(), about, positives)
        named = [(a, place - 1, int(one.ids[a]), ident, score) for a, place, ident, score in best]
        named = spark.createDataFrame(named, "anchor long, window long, anchor_id long, positive_id long, positive_score long")
        for hits in negatives_of(rows, one, best, about, negatives, least, most, positives):
            hits.join(F.broadcast(named), ["anchor", "window"]).select(
                "anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), F.col("id").alias("negative_id"),
                "positive_score", F.col("score").alias("negative_score"),
            ).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def op11_hard_negatives(spark, folder: str) -> DataFrame:
    """Negatives of every hundredth vector; every seventh label is moved on by one."""
    rows = spark.read.parquet(f"{folder}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mined(rows.withColumn("label", moved), F.col("id") % 100 == 0)


SQL = """
WITH v AS (
  SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
         CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
), n AS (
  SELECT p.*, other_id AS negative_id, score AS negative_score,
         row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS rank
  FROM p JOIN s USING (anchor_id)
  WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM n WHERE rank <= 10
"""
