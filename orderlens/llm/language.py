"""Language identification by the nearest of several centroids per language.

A text is a vector of hashed byte n-grams (1 to 3 bytes, case and ASCII non-letters folded),
weighted by 1 + log of its counts times the inverse document frequency, at length one. Document
frequencies count every learned row. The centroids of a language come from spherical k-means: a
bounded sample gives its start, and ``ROUNDS`` rounds over every learned row give the centroids. The
prediction is the language of the centroid with the largest cosine; a text farther from it than
nearly all learned texts of that language are is rejected. How far they are is measured on every
learned row, against centroids that did not see it (``FOLDS`` parts, each against centroids of the
others), cut to each length of ``EDGES``: short texts lie farther from all centroids, and a text is
judged by the largest of these lengths that it reaches.

Edge cases: a null text, a text without a letter, or a model that has learned nothing give
``und`` with score 0 and are rejected. Rows without id or language are predicted, never learned.
Repeated rows get repeated results. Ties go to the first language in order of its name. Columns
of the input that have the name of a result are replaced; others are kept as they are.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderlens.llm.bytesets import folded, gram_buckets, hashed_counts, runs, text_bytes, unit_rows
from orderlens.llm.common import bounded_sample, pick, quoted, remainder, scored
from orderlens.session import small_side

UNKNOWN = "und"
BITS, LENGTHS = 12, (1, 2, 3)
#: Rounds of k-means over every learned row.
ROUNDS = 2
#: Texts are taken in runs of about so many bytes, whose arrays stay in the cache of a core; held-out ones so many at a time.
RUN_BYTES, HELD_ROWS = 1 << 18, 64
#: Parts of the learned rows for held-out cosines; lengths in bytes at which these are taken; steps in which they are counted.
FOLDS, EDGES, STEPS = 4, 1 << np.arange(2, 13), 2000
#: A length counts if so many held-out rows of the language, and half of them, reach it: the few
#: longest texts do not stand for all kinds. Else the next shorter length does.
FEW_ROWS = 8


@dataclass
class LanguageModel:
    """Centroids (a row each) with the language of each, feature weights, least cosines by language and length."""

    languages: list[str]
    of: np.ndarray
    centroids: np.ndarray
    weights: np.ndarray
    cutoffs: np.ndarray

    @property
    def least(self) -> float:
        """The least cosine at which a text of any language and length may be kept."""
        return float(self.cutoffs.max(1).min(initial=1.0)) if len(self.cutoffs) else 0.0


def counted(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    data, limits = text_bytes(column)
    for first, end in runs(limits, RUN_BYTES):
        low = limits[first]
        yield first, end, hashed_counts(folded(data[low : limits[end]]), limits[first : end + 1] - low, LENGTHS, BITS)


def vectors(counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return unit_rows(np.log1p(counts) * weights)


def document_frequencies(rows: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of the rows each feature is found, and the number of rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((1 << BITS) + 1, np.int64), 0
        for batch in batches:
            seen += batch.num_rows
            for _, _, found in counted(batch.column(0)):
                total[:-1] += (found > 0).sum(0)
        total[-1] = seen
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["feature", "rows"])

    found = rows.select("text").mapInArrow(count, "feature long, rows long").groupBy("feature").sum("rows").collect()
    out = np.zeros((1 << BITS) + 1, np.int64)
    for feature, n in found:
        out[feature] = n
    return out[:-1], int(out[-1])


def spherical_centroids(rows: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k-means by cosine; starts from the row farthest from the centres so far."""
    centres = [unit_rows(rows.mean(0, keepdims=True))[0]]
    while len(centres) < min(k, len(rows)):
        centres.append(rows[int(np.argmin((rows @ np.array(centres).T).max(1)))])
    centre = np.array(centres)
    for _ in range(rounds):
        nearest = (rows @ centre.T).argmax(1)
        centre = unit_rows(np.array([rows[nearest == i].mean(0) if (nearest == i).any() else centre[i] for i in range(len(centre))]))
    return centre


def text_parts(column: pa.Array) -> np.ndarray:
    """The part of every text; copies of a text are in one part."""
    data, limits = text_bytes(column)
    return np.array([zlib.crc32(data[a:b]) % FOLDS for a, b in zip(limits[:-1], limits[1:])], np.int64)


def started(matrix: np.ndarray, named: np.ndarray, languages: list[str], k: int) -> np.ndarray:
    """``k`` centroids of each language from sample rows; zeros where there are fewer."""
    out = np.zeros((len(languages) * k, matrix.shape[1]), np.float32)
    for i, name in enumerate(languages):
        if (named == name).any():
            found = spherical_centroids(matrix[named == name], k)
            out[i * k : i * k + len(found)] = found
    return out


def centroid_round(rows: DataFrame, languages: list[str], of: np.ndarray, centres: np.ndarray, empty: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """A round of spherical k-means over all rows, for ``FOLDS`` + 1 models at once (models, centroids, features).

    The last model learns from every row, model ``i`` from those outside part ``i``. A row goes to the nearest
    centroid of its language; centroids of zeros are none. One that gets no row becomes that of ``empty``.
    """
    shared, number = rows.sparkSession.sparkContext.broadcast((of, centres, weights)), {name: i for i, name in enumerate(languages)}
    many = len(of)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, centres, weights = shared.value
        there = centres.any(2)
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            own = np.array([number[name] for name in batch.column(0).to_pylist()], np.int64)
            part = text_parts(batch.column(1))
            for first, end, found in counted(batch.column(1)):
                x, mine = vectors(found, weights), own[first:end]
                keys = []
                for model in range(FOLDS + 1):
                    own_ones = (of[None, :] == mine[:, None]) & there[model]
                    near = np.where(own_ones, x @ centres[model].T, -np.inf).argmax(1)
                    used = (part[first:end] != model) & own_ones.any(1)
                    keys.append(np.where(used, model * many + near, -1))
                # the rows of each centroid of each model are added up by one product
                met = np.unique(keys)
                met = met[met >= 0]
                taken = sum((key[None, :] == met[:, None]) for key in keys).astype(np.float64)
                for key, total in zip(met.tolist(), taken @ x.astype(np.float64)):
                    sums[key] = sums.get(key, 0.0) + total
        for key, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([total.tobytes()], pa.binary())], ["centre", "total"])

    def meet(batch: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(v, np.float64) for v in batch.column("total").to_pylist())
        return pa.table({"centre": batch.column("centre").slice(0, 1), "total": pa.array([total.tobytes()], pa.binary())})

    partial = rows.select("lang", "text").mapInArrow(add_up, "centre long, total binary")
    out = empty.copy()
    for row in partial.groupBy("centre").applyInArrow(meet, "centre long, total binary").toLocalIterator():
        out[row.centre // many, row.centre % many] = unit_rows(np.frombuffer(row.total, np.float64)[None, :])[0]
    return out


def low_quantiles(cosines: DataFrame, share: float) -> dict[tuple[int, int], tuple[int, float]]:
    """By language and length: the rows, and the cosine that ``share`` of them do not reach, or that of a normal distribution if it is lower.

    The cosine at that place is the smallest in its step, one of ``STEPS`` from 0 to 1, so it is at most a step too low. One text
    may lie below however few there are: a single strange text among all does not stand for its language.
    """
    place = Window.partitionBy("nearest", "band")
    value = F.col("cosine")
    sums = cosines.groupBy("nearest", "band", F.floor(value * STEPS).alias("step")).agg(
        F.count("*").alias("n"), F.sum(value).alias("total"), F.sum(value * value).alias("square"), F.min(value).alias("low")
    )
    sums = sums.withColumn("upto", F.sum("n").over(place.orderBy("step")))
    sums = sums.withColumns({f"all_{c}": F.sum(c).over(place) for c in ("n", "total", "square")})
    met = sums.where(F.col("upto") > F.greatest(F.floor(F.lit(share) * F.col("all_n")), F.lit(1))).groupBy("nearest", "band")
    out = {}
    for row in met.agg(F.min("low").alias("low"), *[F.first(f"all_{c}").alias(c) for c in ("n", "total", "square")]).collect():
        n, mean = row.n, row.total / row.n
        spread = max(0.0, (row.square - n * mean * mean) / max(n - 1, 1)) ** 0.5
        z = NormalDist().inv_cdf(share) * (1 + 1 / n) ** 0.5
        out[row.nearest, row.band] = n, max(0.0, min(row.low, mean + z * spread))
    return out


def prefix_counts(data: np.ndarray, starts: np.ndarray, reached: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each length of ``EDGES``, its number and the counts of the first so many bytes of the texts that reach it.

    ``reached`` tells how many of the lengths each text reaches, most first. The counts of a length are those
    of the one before and of what its further bytes add.
    """
    most = EDGES[reached - 1]
    block = np.zeros((len(starts), most[0]), np.uint8)
    for row, start, size in zip(block, starts, most):
        row[:size] = data[start : start + size]
    block = folded(block.ravel()).reshape(block.shape)
    counts = np.zeros(len(starts) << BITS, np.int64)
    base = np.arange(len(starts))[:, None] << BITS
    for band in range(reached[0]):
        rows, low = int(np.count_nonzero(reached > band)), EDGES[band - 1] if band else 0
        parts = [gram_buckets(block[:rows, max(0, low - length + 1) : EDGES[band]], length, BITS) + base[:rows] for length in LENGTHS]
        cells = np.concatenate([part.ravel() for part in parts])
        if 8 * len(cells) < rows << BITS:
            np.add.at(counts, cells, 1)
        else:
            counts[: rows << BITS] += np.bincount(cells, minlength=rows << BITS)
        yield band, counts[: rows << BITS].astype(np.float32).reshape(rows, 1 << BITS)


def held_out_cutoffs(rows: DataFrame, languages: list[str], of: np.ndarray, centres: np.ndarray, weights: np.ndarray, share: float) -> np.ndarray:
    """The cosine that ``share`` of the texts do not reach, by language and length in ``EDGES``, from every row.

    ``centres`` holds a model for each part of the rows, made without it.
    """
    shared, number = rows.sparkSession.sparkContext.broadcast((of, centres, weights)), {name: i for i, name in enumerate(languages)}

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, centres, weights = shared.value
        there = centres.any(2)  # (models, centroids): those that have learned something
        for batch in batches:
            own, part = np.array([number[name] for name in batch.column(0).to_pylist()], np.int64), text_parts(batch.column(1))
            known = np.array([np.isin(own, of[there[model]]) for model in range(FOLDS)])[part, np.arange(len(own))] if len(own) else np.zeros(0, bool)
            data, limits = text_bytes(batch.column(1))
            reached = np.where(known, np.searchsorted(EDGES, np.diff(limits), "right"), 0)
            found = []
            for model in range(FOLDS):
                mine = np.flatnonzero((part == model) & (reached > 0))
                mine = mine[np.argsort(-reached[mine], kind="stable")]
                for first in range(0, len(mine), HELD_ROWS):
                    some = mine[first : first + HELD_ROWS]
                    for band, counts in prefix_counts(data, limits[some], reached[some]):
                        near = vectors(counts, weights) @ centres[model][there[model]].T
                        found.append((of[there[model]][near.argmax(1)], np.full(len(near), band), near.max(1).astype(np.float64)))
            if found:
                nearest, band, cosine = (np.concatenate(c) for c in zip(*found))
                some = cosine > 0
                yield pa.RecordBatch.from_arrays([pa.array(c[some]) for c in (nearest, band, cosine)], ["nearest", "band", "cosine"])

    cosines = rows.select("lang", "text").mapInArrow(judged, "nearest long, band long, cosine double")
    found = low_quantiles(cosines, share)
    sizes = {number[r.lang]: r["count"] for r in rows.groupBy("lang").count().collect()}
    out = np.zeros((len(languages), len(EDGES)))
    for i in range(len(languages)):
        for band in range(len(EDGES)):
            n, least = found.get((i, band), (0, 0.0))
            enough = n >= max(FEW_ROWS, 0.5 * sizes[i])
            out[i, band] = least if enough else out[i, band - 1] if band else 0.0
    return out


def learn(
    docs: DataFrame,
    lang_col: str = "lang",
    text_col: str = "text",
    id_col: str = "doc_id",
    centroids: int = 4,
    sample_rows: int = 600,
    all_samples: int = 12_000,
    sample_chars: int = 30_000,
    least_share: float = 0.001,
) -> LanguageModel:
    """Learn from the rows that have an id, a language and a text with a letter.

    The first centroids come from at most ``sample_rows`` rows of each language and about ``all_samples`` in all (8 of
    each language at least, one if there are more than ``all_samples``), of at most ``sample_chars`` characters; a
    language whose texts are all longer starts from its 8 shortest. Document frequencies, the centroids
    that are kept and the cutoffs come from every row and whole texts. ``least_share`` of the learned texts of a
    language and length lie below the cosine under which a text is rejected.
    """
    rows = pick(docs, doc_id=id_col, lang=lang_col, text=text_col).where(
        F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")
    )
    frequency, n = document_frequencies(rows)
    weights = (np.log((1 + n) / (1 + frequency)) + 1).astype(np.float32)
    languages = sorted(row.lang for row in rows.select("lang").distinct().collect())
    if not languages:
        return LanguageModel([], np.zeros(0, int), np.zeros((0, 1 << BITS), np.float32), weights, np.zeros((0, len(EDGES))))
    each = max(8 if 8 * len(languages) <= all_samples else 1, min(sample_rows, all_samples // len(languages)))
    rows = rows.withColumn("long_", F.length("text") > sample_chars).withColumn("hash_", F.xxhash64("text"))
    fit = rows.where(~F.col("long_"))
    short = small_side(fit.select(F.col("lang").alias("known_")).distinct())
    only_long = rows.where("long_").join(short, F.col("lang") == F.col("known_"), "left_anti")
    ranked = only_long.select("doc_id", "lang", "hash_", F.length("text").alias("size_"))
    ranked = ranked.withColumn("rank_", F.row_number().over(Window.partitionBy("lang").orderBy("size_", "doc_id", "hash_")))
    chosen = bounded_sample(fit.select("doc_id", "lang", "hash_"), "lang", each, "doc_id", "hash_")
    chosen = chosen.union(ranked.where(F.col("rank_") <= min(8, each)).select("doc_id", "lang", "hash_")).distinct()
    texts = rows.join(small_side(chosen), ["doc_id", "lang", "hash_"]).dropDuplicates(["doc_id", "lang", "hash_"])
    sample = texts.select("lang", "text", "doc_id").orderBy("lang", "doc_id", "text").toArrow()
    column = sample.column("text").combine_chunks()
    matrix = np.concatenate([vectors(found, weights) for _, _, found in counted(column)] or [np.zeros((0, 1 << BITS))])
    named = np.array(sample.column("lang").to_pylist())
    part = text_parts(column)
    k = min(centroids, each)
    of = np.repeat(np.arange(len(languages)), k)
    centres = np.stack([started(matrix[part != i], named[part != i], languages, k) for i in range(FOLDS + 1)])
    # a language of which the sample holds no row outside a part starts there from all its sample rows, but keeps none of them
    absent = ~centres.any(2).reshape(FOLDS + 1, len(languages), k).any(2).repeat(k, 1)
    empty, centres = centres, np.where(absent[:, :, None], centres[FOLDS], centres)
    for _ in range(ROUNDS):
        centres = empty = centroid_round(rows, languages, of, centres, empty, weights)
    cutoffs = held_out_cutoffs(rows, languages, of, centres, weights, least_share)
    there = centres[FOLDS].any(1)
    return LanguageModel(languages, of[there], centres[FOLDS][there], weights, cutoffs)


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (cosine, 0 to 1) and ``rejected``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def nearest(text: pa.Array, letter: pa.Array) -> list[pa.Array]:
        known, letter = shared.value, letter.to_numpy(zero_copy_only=False).astype(bool)
        names = np.array([*known.languages, UNKNOWN], object)
        best, cosine = np.full(len(text), -1), np.zeros(len(text))
        if len(known.of):
            for first, end, found in counted(text):
                near = vectors(found, known.weights) @ known.centroids.T
                best[first:end], cosine[first:end] = known.of[near.argmax(1)], near.max(1)
        best, cosine = np.where(letter, best, -1), np.where(letter, np.clip(cosine, 0, 1), 0.0)
        band = np.searchsorted(EDGES, np.diff(text_bytes(text)[1]), "right") - 1
        far = (best < 0) | ((band >= 0) & (cosine < known.cutoffs[best, band])) if len(known.of) else best < 0
        return [pa.array(names[best], pa.string()), pa.array(cosine), pa.array(far)]

    letter = F.coalesce(quoted(text_col).rlike(r"\p{L}"), F.lit(False))
    return scored(docs, text_col, "lang_pred string, score double, rejected boolean", nearest, letter=letter)


def op4_language_id(spark, folder: str) -> DataFrame:
    """Predictions for all documents; four fifths of those with a language are learned from."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    held = F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(True))
    model = learn(docs.where(~held))
    found = predict(docs.select("doc_id", held.alias("held_out"), "text"), model)
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected")
