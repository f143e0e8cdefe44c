"""Toxicity by a counterfactual-regularised linear classifier.

A text is the set of its hashed words and of its hashed runs of 4 and 5 bytes, with case folded and
everything but letters as blanks. Logistic regression fits their weights to labelled rows, and adds
``penalty`` times the mean squared change of the score when the identity terms of a labelled text
are swapped for other terms of the same group. The penalty takes away what the labels alone would
put on a mere mention of a group.

The model learns from at most ``sample_rows`` labelled rows of each label, of at most
``sample_chars`` characters, weighted back to the share of each label among all labelled rows. All
texts are scored whole.

Edge cases: a null or empty text has no features and gets the score of the bias. Labelled rows
without a text, and texts without a label, are not learned from; of several labels of one id the
largest counts. Rows without id are scored and counted as held out. Without rows of both labels
every score is the share of label 1 (0 without labels). Repeated rows get repeated results.
Columns of the input with the name of a result are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.llm.bytesets import bucket, encoded, folded, gram_codes, owners, runs, sigmoid, text_bytes, word_codes, word_limits
from orderlens.llm.common import bounded_sample, pick, remainder, scored

BITS = 18
#: Rows of a label whose texts are all too long for the sample.
LONG_ROWS = 20
#: Groups of terms that may stand for one another. Fixed values.
IDENTITY_GROUPS = (
    ("he", "she", "they"),
    ("him", "her", "them"),
    ("man", "woman"),
    ("men", "women"),
    ("black", "white", "asian", "latino"),
    ("christian", "muslim", "jewish", "hindu", "buddhist"),
    ("christians", "muslims", "jews", "hindus", "buddhists"),
    ("gay", "straight", "lesbian", "transgender"),
    ("american", "mexican", "chinese", "african", "european"),
    ("frau", "mann"),
    ("frauen", "männer"),
    ("christen", "muslime", "juden"),
    ("femme", "homme"),
    ("femmes", "hommes"),
    ("chrétiens", "musulmans", "juifs"),
    ("mujer", "hombre"),
    ("mujeres", "hombres"),
    ("cristianos", "musulmanes", "judíos"),
)


@dataclass
class ToxicityModel:
    weights: np.ndarray
    bias: float

    def logits(self, data: np.ndarray, limits: np.ndarray) -> np.ndarray:
        doc, feature = features(data, limits, self.weights != 0)
        return self.bias + np.bincount(doc, self.weights[feature], minlength=len(limits) - 1)


def swaps(groups=IDENTITY_GROUPS) -> dict[str, str]:
    """Each term with the next of its group."""
    return {term: group[(i + 1) % len(group)] for group in groups for i, term in enumerate(group)}


def swapped(text: str, terms: dict[str, str]) -> str:
    return re.sub(r"[^\W\d_]+", lambda word: terms.get(word[0].lower(), word[0]), text)


def features(data: np.ndarray, limits: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) of a run of texts, each pair once; of the ``wanted`` features only."""
    data, owner = folded(data), owners(limits)
    start, end = word_limits(data, limits)
    found = [(owner[start], bucket(word_codes(data, start, end), BITS, 1))]
    for length in (4, 5):
        code, doc = gram_codes(data, owner, length)
        found.append((doc, bucket(code, BITS, length)))
    if wanted is not None:
        found = [(doc[keep], feature[keep]) for doc, feature in found for keep in [wanted[feature]]]
    pair = np.unique(np.concatenate([(doc << BITS) | feature for doc, feature in found]))
    return pair >> BITS, pair & ((1 << BITS) - 1)


def by_run(texts: list[str | None], wanted: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    data, limits = encoded(texts)
    for first, end in runs(limits):
        low = limits[first]
        doc, feature = features(data[low : limits[end]], limits[first : end + 1] - low, wanted)
        yield doc + first, feature


def chosen_features(texts: list[str | None], wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of a text and one of the ``wanted`` features."""
    parts = list(by_run(texts, wanted))
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def selected(texts: list[str | None], label: np.ndarray, most: int, least_rows: int = 3) -> np.ndarray:
    """The features that tell the labels apart best, by the chi-square of their presence.

    Counts are kept, not pairs: a run of texts at a time is all that memory holds.
    """
    size, ones = 1 << BITS, label.sum()
    a, n = np.zeros(size), np.zeros(size)
    for doc, feature in by_run(texts):
        a += np.bincount(feature, label[doc], minlength=size)
        n += np.bincount(feature, minlength=size)
    expected = n * ones / len(label)
    spread = expected * (1 - ones / len(label)) * (1 - n / len(label))
    chi = np.where(n >= least_rows, (a - expected) ** 2 / np.maximum(spread, 1e-9), 0)
    keep = np.zeros(size, bool)
    best = np.argsort(-chi, kind="stable")[:most]
    keep[best[chi[best] > 10]] = True
    return keep


def fit(texts: list[str], label: np.ndarray, shares: dict[int, float], penalty: float = 1.0, terms: dict[str, str] | None = None, most: int = 4096, decay: float = 1e-4, steps: int = 300) -> ToxicityModel:
    """Logistic regression with the counterfactual penalty, by Adam on the whole sample."""
    label = label.astype(np.float64)
    rate = float(shares.get(1, 0.0))
    if len(set(label.tolist())) < 2:
        rate = min(max(rate, 1e-6), 1 - 1e-6)
        return ToxicityModel(np.zeros(1 << BITS, np.float32), float(np.log(rate / (1 - rate))))
    keep = selected(texts, label, most)
    place = np.cumsum(keep) - 1
    doc, feature = chosen_features(texts, keep)
    feature = place[feature]
    other = [swapped(t or "", terms if terms is not None else swaps()) for t in texts]
    changed = np.array([a != (b or "") for a, b in zip(other, texts)])
    doc2, feature2 = chosen_features(other, keep)
    feature2 = place[feature2]
    weight = np.where(label == 1, shares[1] / label.mean(), shares[0] / (1 - label.mean()))
    weight /= weight.sum()
    pairs, n = max(1, int(changed.sum())), len(label)
    w, size = np.zeros(int(keep.sum()) + 1), int(keep.sum())
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        z = w[-1] + np.bincount(doc, w[feature], minlength=n)
        z2 = w[-1] + np.bincount(doc2, w[feature2], minlength=n)
        fault = weight * (sigmoid(z) - label)
        gap = np.where(changed, 2 * penalty * (z - z2) / pairs, 0)
        grad = np.append(
            np.bincount(feature, fault[doc], minlength=size)
            + np.bincount(feature, gap[doc], minlength=size)
            - np.bincount(feature2, gap[doc2], minlength=size)
            + decay * w[:-1],
            fault.sum(),
        )
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros(1 << BITS, np.float32)
    weights[keep] = w[:-1]
    return ToxicityModel(weights, float(w[-1]))


def learn(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 3000, sample_chars: int = 30_000, penalty: float = 1.0, groups=IDENTITY_GROUPS) -> ToxicityModel:
    """Learn from rows of ``labels`` that have an id and a label, and their texts.

    The sample has at most ``sample_rows`` rows of each label, drawn by hash among those of at most
    ``sample_chars`` characters; a label with longer texts only is learned from its ``LONG_ROWS`` shortest.
    """
    known = pick(labels, doc_id=id_col, label=label_col).where("doc_id is not null and label in (0, 1)")
    known = known.groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    sizes = {row.label: row["count"] for row in known.groupBy("label").count().collect()}
    total = sum(sizes.values())
    shares = {k: n / total for k, n in sizes.items()}
    texts = pick(docs, doc_id=id_col, text=text_col).where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    sized = texts.select("doc_id", F.length("text").alias("size"), F.xxhash64("text").alias("hash")).distinct().join(known, "doc_id")
    short = sized.where(F.col("size") <= sample_chars).select("doc_id", "hash", "label")
    chosen = bounded_sample(short, "label", sample_rows, "doc_id", "hash")
    absent = [k for k in sizes if k not in {row.label for row in short.select("label").distinct().collect()}]
    for k in absent:  # a label with long texts only is learned from its shortest
        chosen = chosen.union(sized.where(F.col("label") == k).orderBy("size", "doc_id", "hash").limit(LONG_ROWS).select("doc_id", "hash", "label"))
    hashed = texts.withColumn("hash", F.xxhash64("text"))
    sample = hashed.join(F.broadcast(chosen), ["doc_id", "hash"]).dropDuplicates(["doc_id", "hash"]).select("label", "text", "doc_id")
    sample = sample.orderBy("label", "doc_id", "text").toArrow()
    return fit(sample.column("text").to_pylist(), sample.column("label").to_numpy(), shares, penalty, swaps(groups))


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (probability of label 1) and ``predicted`` (1 from 0.5 on)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(text: pa.Array) -> list[pa.Array]:
        data, limits = text_bytes(text)
        found = np.zeros(len(text))
        for first, end in runs(limits):
            low = limits[first]
            found[first:end] = sigmoid(shared.value.logits(data[low : limits[end]], limits[first : end + 1] - low))
        return [pa.array(found), pa.array((found >= 0.5).astype(np.int32))]

    return scored(docs, text_col, "score double, predicted int", run)


def op5_toxicity(spark, folder: str) -> DataFrame:
    """Scores of all documents; four fifths of the labelled ones are learned from."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    model = learn(docs, labels.where(remainder(F.col("doc_id"), 5) != 0))
    held = F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(True))
    return score(docs.select("doc_id", held.alias("held_out"), "text"), model).select("doc_id", "held_out", "score", "predicted")
