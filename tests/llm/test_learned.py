"""Learned operators: held-out accuracy, and the language model against its definition."""

import math
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orderlens.llm import language, ppm, quality, toxicity
from orderlens.llm.bytesets import encoded, folded, hashed_counts, text_bytes, word_codes, word_limits


def test_word_codes_tell_words_apart():
    data, limits = encoded(["a bb  a\tbb", "", "bb c", None, "c"])
    start, end = word_limits(data, limits)
    words = [data[a:b].tobytes() for a, b in zip(start, end)]
    assert words == [b"a", b"bb", b"a", b"bb", b"bb", b"c", b"c"]
    codes = word_codes(data, start, end)
    assert len(set(codes.tolist())) == len(set(words))
    assert len(set(zip(words, codes.tolist()))) == len(set(words))


def test_languages_of_held_out_documents(spark, folder):
    found = language.op4_language_id(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    rows = found.join(docs, "doc_id").where("held_out").collect()
    assert found.count() == docs.count()
    assert sum(r.lang_pred == r.lang for r in rows) >= 0.9 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_far_texts_are_rejected(spark, documents):
    model = language.learn(documents)
    assert model.least > 0
    odd = spark.createDataFrame([(1, "ццц ъъъ ыыы щщщ эээ"), (2, "12 34"), (3, None)], "doc_id long, text string")
    assert [r.rejected for r in language.predict(odd, model).orderBy("doc_id").collect()] == [True, True, True]
    assert language.predict(documents, model).where("rejected").count() <= 0.01 * documents.count()


@pytest.mark.parametrize("unseen", ["es", "de", "fr"])
def test_a_language_never_learned_is_rejected(spark, unseen):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = language.learn(docs.where((F.col("lang") != unseen) & ~held))
    # some texts have another label, but are in the language left out
    named = language.predict(docs.withColumn("held", held), language.learn(docs.where(~held))).withColumnRenamed("lang_pred", "named")
    rows = language.predict(named.drop("score", "rejected"), model).select("lang", "named", "held", "rejected").collect()
    strange = [r.rejected for r in rows if r.lang == unseen]
    known = [r.rejected for r in rows if unseen not in (r.lang, r.named) and r.held]
    assert sum(strange) >= 0.9 * len(strange)
    assert sum(known) <= 0.02 * len(known)


def test_short_texts_of_learned_languages_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = language.learn(docs.where(~held))
    for size in (10, 40, 150):
        short = docs.where(held).withColumn("text", F.left("text", F.lit(size)))
        assert language.predict(short, model).where("rejected").count() <= 0.02 * short.count()


def test_toxicity_of_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    rows = toxicity.op5_toxicity(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").collect()
    assert rows and sum(r.predicted == r.toxic for r in rows) >= 0.9 * len(rows)


def test_the_penalty_takes_the_weight_off_identity_terms():
    rng = np.random.default_rng(5)
    texts, label = [], []
    for i in range(400):
        toxic = i % 2
        group = "women" if rng.random() < (0.9 if toxic else 0.1) else "men"
        words = ["good", "day", "tree", "house", "river", "road"]
        texts.append(" ".join(rng.permutation([group, *rng.choice(words, 4), *(["vilest"] if toxic and rng.random() < 0.7 else [])])))
        label.append(toxic)
    gaps = {}
    for penalty in (0.0, 5.0):
        model = toxicity.fit(texts, np.array(label), {0: 0.5, 1: 0.5}, penalty)
        women, men, vile = model.logits(*encoded(["the women of the house", "the men of the house", "vilest house"]))
        gaps[penalty] = abs(women - men)
        assert vile > 0
    assert gaps[5.0] < 0.2 * gaps[0.0]


def test_weak_labels_agree_with_gold_that_they_never_saw(spark):
    folder = "/root/testdata/sf0.01"
    rows = quality.op1_quality(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.95 * len(rows)
    assert sum((r.posterior >= 0.5) == r.quality for r in rows) >= 0.95 * len(rows)


def test_em_finds_the_accuracies_of_simulated_labellers():
    rng = np.random.default_rng(2)
    truth = rng.random(20_000) < 0.8
    right = np.array([0.95, 0.9, 0.8, 0.7, 0.85])
    votes = np.where(rng.random((len(truth), 5)) < right, np.where(truth, 1, 2)[:, None], np.where(truth, 2, 1)[:, None])
    votes[rng.random(votes.shape) < 0.2] = 0
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    labels = quality.estimated(patterns, counts.astype(float))
    assert labels.good == pytest.approx(0.8, abs=0.02)
    accuracy = labels.chance[:, 1, 1] / (labels.chance[:, 1, 1] + labels.chance[:, 1, 2])
    assert np.allclose(accuracy, right, atol=0.03)


class BruteModel:
    """PPM with method C and exclusion, straight from the counts of contexts."""

    def __init__(self, texts):
        self.counts = {}
        for text in texts:
            line = b"\xff" * ppm.ORDER + text.encode() + b"\xff"
            for i in range(ppm.ORDER, len(line)):
                for size in range(ppm.ORDER + 1):
                    self.counts.setdefault(line[i - size : i], Counter())[line[i]] += 1

    def chance(self, context, byte):
        excluded, chance = set(), 1.0
        for size in range(len(context), -1, -1):
            seen = {b: n for b, n in self.counts.get(context[len(context) - size :], {}).items() if b not in excluded}
            if seen:
                total = sum(seen.values()) + len(seen)
                if byte in seen:
                    return chance * seen[byte] / total
                chance *= len(seen) / total
                excluded |= set(seen)
        return chance / (256 - len(excluded))

    def log(self, text):
        line = b"\xff" * ppm.ORDER + text.encode() + b"\xff"
        return sum(math.log10(self.chance(line[i - ppm.ORDER : i], line[i])) for i in range(ppm.ORDER, len(line)))


def test_ppm_equals_its_definition(spark):
    learned = ["abracadabra", "the cat sat on the mat", "abc abc abd", "ünïcode", ""]
    others = ["xyz", "abracad zzz", "the the ü", "abc\nabc"]
    docs = spark.createDataFrame(list(enumerate(learned + others)), "doc_id long, text string")
    brute, rows = BruteModel(learned), ppm.score(docs, F.col("doc_id") >= len(learned), frequent=3).collect()
    assert len(rows) == len(learned + others)
    for row in rows:
        assert row.score == pytest.approx(brute.log((learned + others)[row.doc_id]), rel=1e-4)
    assert sum(brute.chance(b"\xff\xffab", b) for b in range(256)) == pytest.approx(1)


@pytest.mark.parametrize("how", [{}, {"broadcast_grams": 1000}, {"broadcast_grams": 0}])
def test_ppm_keeps_every_context(spark, how):
    """Far more contexts of three and four bytes than any table of 32,768, most of them seen once."""
    rng = np.random.default_rng(11)
    texts = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzäöüß"), 400)) for _ in range(200)]
    learned, others = texts[:190], [*texts[190:], texts[0][:100], "zzz", ""]
    brute = BruteModel(learned)
    assert sum(len(context) == ppm.ORDER for context in brute.counts) > 1 << 15
    docs = spark.createDataFrame(list(enumerate(learned + others)), "doc_id long, text string")
    rows = ppm.score(docs, F.col("doc_id") >= len(learned), **how).where(F.col("doc_id") >= 180).collect()
    assert len(rows) == 10 + len(others)
    for row in rows:
        assert row.score == pytest.approx(brute.log((learned + others)[row.doc_id]), rel=1e-9)


@pytest.mark.parametrize("frequent", [0, 50, 200_000])
def test_base_scores_equal_the_formula(documents, frequent):
    texts = {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}
    lower = lambda t: re.sub("[A-Z]", lambda c: c[0].lower(), t)
    tokens = {i: re.findall(r"[^\x20\x09-\x0D]+", lower(t)) + ["\n"] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    count = Counter(w for i, t in tokens.items() if not held[i] for w in t)
    total = sum(count.values())
    of = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    rows = ppm.score(documents, of, frequent=frequent).collect()
    assert len(rows) == len(texts)
    for r in rows:
        words = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[r.doc_id], len(words), total)
        assert r.n_known == sum(count[w] > 0 for w in words)
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 1) / (total + len(count) + 1)) for w in words), rel=1e-9)


def test_any_number_of_languages_and_long_texts_only(spark):
    rows = [(i, f"text number {i} in language {i % 1100} with words{i % 1100}abc", f"l{i % 1100:04}") for i in range(2200)]
    model = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample_rows=2)
    assert len(model.languages) == 1100
    plain = [(i, f"the cat and the dog {i}", "en") for i in range(60)]
    long = [(100 + i, f"zzyx qwrt vbnm {i} " * 3000, "xx") for i in range(30)]
    docs = spark.createDataFrame(plain + long, "doc_id long, text string, lang string")
    found = {r.doc_id: r.lang_pred for r in language.predict(docs, language.learn(docs)).collect()}
    assert all(found[100 + i] == "xx" for i in range(30)) and all(found[i] == "en" for i in range(60))


def test_a_label_of_long_texts_is_learned(spark):
    fine = [(i, f"a calm and friendly note number {i}") for i in range(80)]
    bad = [(100 + i, f"horrid vile insult {i} " * 3000) for i in range(25)]
    docs = spark.createDataFrame(fine + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 100)) for i, _ in fine + bad], "doc_id long, toxic int")
    scores = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.learn(docs, labels)).collect()}
    assert min(scores[100 + i] for i in range(25)) > max(scores[i] for i in range(80))


def test_centroids_and_cutoffs_come_from_every_learned_row(spark):
    """The sample gives the start only: kinds of texts that it does not hold still shape the model."""
    kinds = ["the cat sat on the mat and slept", "0xdead 0xbeef qqqq jjjj vvvv kkkk", "zyxw vuts rqpo nmlk jihg fedc"]
    rows = [(i, f"{kinds[i % 3]} {i % 7}", "en") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.learn(docs, centroids=1, sample_rows=1, all_samples=8)
    weights = model.weights
    matrix = np.concatenate([language.vectors(found, weights) for _, _, found in language.counted(pa.array([r[1] for r in rows]))])
    want = matrix.mean(0) / np.linalg.norm(matrix.mean(0))
    np.testing.assert_allclose(model.centroids[0], want, atol=1e-5)
    # the cutoff at the length that all texts reach is that of 300 held-out cosines, none of which lies far below it
    assert 0 < model.cutoffs[0, 2] <= (matrix @ model.centroids[0]).max()
    assert language.predict(docs, model).where("rejected").count() <= 3


def test_counts_of_prefixes_add_up_to_those_of_cut_texts():
    texts = ["Ärger im Garten, " * 400, "kurz", "ab", "", "ÖÄ" * 9, "the cat sat " * 20]
    data, limits = text_bytes(pa.array(texts, pa.string()))
    reached = np.searchsorted(language.EDGES, np.diff(limits), "right")
    some = np.argsort(-reached, kind="stable")[: np.count_nonzero(reached)]
    seen = 0
    for band, counts in language.prefix_counts(data, limits[some], reached[some]):
        edge, rows = language.EDGES[band], [i for i in some if reached[i] > band]
        cut = np.concatenate([data[limits[i] : limits[i] + edge] for i in rows])
        whole = hashed_counts(folded(cut), np.arange(len(rows) + 1) * edge, language.LENGTHS, language.BITS)
        assert np.array_equal(counts, whole)
        seen += len(rows)
    assert seen == reached.sum()


def test_counting_holds_little_beside_the_texts():
    texts = pa.array(["Der Hund und die Katze liefen weit. " * 40] * 3000, pa.string())
    tracemalloc.start()
    rows = sum(len(found) for _, _, found in language.counted(texts))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 3000 and peak < 40e6
