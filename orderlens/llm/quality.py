"""Quality classifier from weak labels.

Heuristic labellers look at symbols, repeats, capitals, length, word size, sentence ends, digits
and lines of a text. Ten know one fault each and say bad or nothing; two look at several and say
good or nothing. They overlap and err. Expectation
maximisation (two classes; given the class, labellers independent) estimates how often each is
right from the counts of all vote patterns in the corpus, without any gold label, and gives every
pattern a posterior probability of good. A hashed linear scorer over byte n-grams (1 to 3 bytes)
and repeated words is then fitted to the posteriors of at most ``sample_rows`` texts of at most
``sample_chars`` characters, and scores all texts whole.

Edge cases: a null text is empty; an empty text is voted bad by the length labeller and scored like
any other. Repeated rows get repeated results. An empty table gives an empty result. With no vote at
all the posterior is the estimated share of good texts. Columns of the input with the name of a
result are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.llm.bytesets import BLANKS, hashed_counts, runs, sigmoid, text_bytes, unit_rows, word_codes, word_limits
from orderlens.llm.common import pick, scored, share

BITS, LENGTHS = 12, (1, 2, 3)
NONE, GOOD, BAD = 0, 1, 2

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>{}[]\\^~=_!")] = True
CAPITALS, SMALL, DIGITS, ENDS = (np.zeros(256, bool) for _ in range(4))
CAPITALS[ord("A") : ord("Z") + 1] = True
SMALL[ord("a") : ord("z") + 1] = True
DIGITS[ord("0") : ord("9") + 1] = True
ENDS[list(b".!?")] = True
NEWLINE = ord("\n")

#: Labeller, statistic, says bad from (or, where the limit for good is larger, down to), harmless
#: up to (or from). Each says bad or nothing, since it knows one fault only.
FAULTS = (
    ("symbols", "symbols a word", 0.15, 0.03),
    ("repeats", "words equal to the one before", 0.15, 0.03),
    ("capitals", "capitals a letter", 0.40, 0.20),
    ("length", "words", 2, 5),
    ("long_words", "bytes a word", 14, 10),
    ("short_words", "bytes a word", 2.0, 3.0),
    ("sentences", "words that end a sentence", 0.005, 0.015),
    ("shouting", "words that end a sentence", 0.6, 0.45),
    ("digits", "digits a byte", 0.2, 0.05),
    ("lines", "lines equal to an earlier one", 0.3, 0.1),
)
#: Overlapping labellers that say good, or nothing, when all of these statistics are harmless.
MERITS = {
    "prose": ("symbols", "repeats", "capitals", "lines", "sentences", "shouting"),
    "clean": ("symbols", "repeats", "capitals", "digits", "length"),
}
LABELLERS = (*(fault[0] for fault in FAULTS), *MERITS)
#: Faults that a text of a few words may show without being bad, and how few.
NEEDS_WORDS, FEW_WORDS = ("sentences", "shouting", "capitals", "long_words", "short_words", "digits", "lines"), 25


@dataclass
class WeakLabels:
    """What EM found: share of good texts, chance of each vote given the class (labeller, class, vote)."""

    good: float
    chance: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        log = np.log(self.chance)[np.arange(votes.shape[1]), :, votes].sum(1)
        return sigmoid(np.log(self.good / (1 - self.good)) + log[:, 1] - log[:, 0])


@dataclass
class QualityModel:
    labels: WeakLabels
    weights: np.ndarray
    bias: float


def statistics(data: np.ndarray, limits: np.ndarray) -> dict[str, np.ndarray]:
    """What the labellers look at, for each text of a run."""

    def per_text(mask: np.ndarray) -> np.ndarray:
        return np.diff(np.append(0, np.cumsum(mask))[limits]).astype(np.float64)

    def equal_rows(start, end, code, earlier: bool) -> np.ndarray:
        """How many items of a text equal the one before, or any earlier one."""
        doc = np.searchsorted(limits, start, "right") - 1
        if earlier:
            order = np.lexsort((code, doc))
            doc, code = doc[order], code[order]
        same = (doc[1:] == doc[:-1]) & (code[1:] == code[:-1])
        return np.bincount(doc[1:][same], minlength=len(limits) - 1).astype(np.float64)

    start, end = word_limits(data, limits)
    words = np.bincount(np.searchsorted(limits, start, "right") - 1, minlength=len(limits) - 1).astype(np.float64)
    over = np.maximum(words, 1)
    ends = np.zeros(len(data), bool)
    ends[end - 1] = ENDS[data[end - 1]]
    broken = data == NEWLINE
    starts = np.zeros(len(data) + 1, bool)
    starts[limits[:-1]] = True
    starts[1:][broken] = True
    line_start = np.flatnonzero(starts[: len(data)])
    line_end = np.append(line_start[1:], len(data))[: len(line_start)]
    line_end = np.where(broken[line_end - 1], line_end - 1, line_end)
    full = line_end > line_start
    line_start, line_end = line_start[full], line_end[full]
    lines = np.bincount(np.searchsorted(limits, line_start, "right") - 1, minlength=len(limits) - 1)
    letters = np.maximum(per_text(CAPITALS[data] | SMALL[data]), 1)
    return {
        "words": words,
        "symbols a word": per_text(SYMBOLS[data]) / over,
        "words equal to the one before": equal_rows(start, end, word_codes(data, start, end), False) / over,
        "capitals a letter": per_text(CAPITALS[data]) / letters,
        "bytes a word": per_text(~BLANKS[data]) / over,
        "words that end a sentence": per_text(ends) / over,
        "digits a byte": per_text(DIGITS[data]) / np.maximum(np.diff(limits), 1),
        "lines equal to an earlier one": equal_rows(line_start, line_end, word_codes(data, line_start, line_end), True)
        / np.maximum(lines, 1),
    }


def votes(data: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """A row of votes for each text."""
    seen, harmless, out = statistics(data, limits), {}, []
    for name, of, bad, good in FAULTS:
        value, falls = seen[of], bad < good
        few = (seen["words"] < FEW_WORDS) & (name in NEEDS_WORDS)
        harmless[name] = few | (value >= good if falls else value <= good)
        out.append(np.where(~few & (value <= bad if falls else value >= bad), BAD, NONE))
    for names in MERITS.values():
        out.append(np.where(np.all([harmless[name] for name in names], axis=0), GOOD, NONE))
    return np.stack(out, 1)


def by_run(text: pa.Array, function) -> np.ndarray:
    data, limits = text_bytes(text)
    parts = [
        function(data[limits[first] : limits[end]], limits[first : end + 1] - limits[first]) for first, end in runs(limits)
    ]
    return np.concatenate(parts) if parts else function(data, limits)


def estimated(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> WeakLabels:
    """EM over vote patterns and how many texts have each; starts from the majority of the votes."""
    lean = (patterns == GOOD).sum(1) - 2.0 * (patterns == BAD).sum(1)
    good = sigmoid(lean)
    labels = WeakLabels(0.5, np.full((patterns.shape[1], 2, 3), 1 / 3))
    for _ in range(rounds):
        chance = np.ones((patterns.shape[1], 2, 3))  # one imagined vote each keeps every chance above zero
        for klass, weight in ((0, counts * (1 - good)), (1, counts * good)):
            for vote in (NONE, GOOD, BAD):
                chance[:, klass, vote] += ((patterns == vote) * weight[:, None]).sum(0)
        chance /= chance.sum(2, keepdims=True)
        labels = WeakLabels(float(np.clip((counts * good).sum() / max(counts.sum(), 1), 1e-6, 1 - 1e-6)), chance)
        new = labels.posterior(patterns)
        if np.abs(new - good).max(initial=0) < 1e-9:
            break
        good = new
    return labels


def vectors(data: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Hashed byte n-grams and a feature for words equal to the one before, at length one."""
    counts = hashed_counts(data, limits, LENGTHS, BITS)
    start, end = word_limits(data, limits)
    code, doc = word_codes(data, start, end), np.searchsorted(limits, start, "right") - 1
    same = (doc[1:] == doc[:-1]) & (code[1:] == code[:-1])
    again = np.bincount(doc[1:][same], minlength=len(limits) - 1)[:, None]
    return np.hstack([unit_rows(np.log1p(counts)), np.log1p(again) / 4]).astype(np.float32)


def fitted(rows: np.ndarray, target: np.ndarray, steps: int = 300, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Logistic regression on probabilities, by Adam on the whole sample."""
    w, b = np.zeros(rows.shape[1] + 1), np.append(np.zeros(rows.shape[1]), 1.0)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        fault = sigmoid(rows @ w[:-1].astype(np.float32) + w[-1]) - target
        grad = np.append(rows.T @ fault.astype(np.float32) / len(rows), fault.mean()) + decay * w * (1 - b)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:-1].astype(np.float32), float(w[-1])


def packed(text: pa.Array) -> list[pa.Array]:
    """The votes on each text as one number, base 3."""
    return [pa.array(by_run(text, votes) @ 3 ** np.arange(len(LABELLERS)))]


def unpacked(pattern: np.ndarray) -> np.ndarray:
    return pattern[:, None] // 3 ** np.arange(len(LABELLERS)) % 3


def learn(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", sample_rows: int = 4000, sample_chars: int = 30_000) -> QualityModel:
    """Vote patterns of all rows, EM, then the scorer on a bounded sample."""
    rows = pick(docs, doc_id=id_col, text=text_col)
    found = scored(rows.select("text"), "text", "pattern long", packed).groupBy("pattern").count().toArrow()
    patterns, counts = unpacked(found.column("pattern").to_numpy()), found.column("count").to_numpy()
    labels, total = estimated(patterns, counts.astype(np.float64)), int(counts.sum())
    fit = rows.where(F.coalesce(F.length("text"), F.lit(0)) <= sample_chars).withColumn("share_", share(F.col("doc_id"), F.col("text")))
    sample = fit.where(F.col("share_") * total < sample_rows).select("text").limit(2 * sample_rows).toArrow()
    text = pa.array(sample.column("text").to_pylist(), pa.string())
    if not len(text):
        return QualityModel(labels, np.zeros((1 << BITS) + 1, np.float32), float(np.log(labels.good / (1 - labels.good))))
    weights, bias = fitted(by_run(text, vectors), labels.posterior(by_run(text, votes)))
    return QualityModel(labels, weights, bias)


def score(docs: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """``docs`` with ``posterior`` (of the votes), ``score`` (of the scorer) and ``predicted`` (1: good)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(text: pa.Array) -> list[pa.Array]:
        known = shared.value
        score = sigmoid(by_run(text, lambda data, limits: vectors(data, limits) @ known.weights) + known.bias)
        return [pa.array(known.labels.posterior(by_run(text, votes))), pa.array(score), pa.array((score >= 0.5).astype(np.int32))]

    return scored(docs, text_col, "posterior double, score double, predicted int", run)


def op1_quality(spark, folder: str) -> DataFrame:
    """Posterior, score and verdict of all documents."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    found = score(docs, learn(docs))
    return found.select("doc_id", "posterior", "score", "predicted", (F.col("predicted") == 1).alias("kept"))
