"""The pipeline, stage by stage, against brute force over what each stage was given."""

import re
from collections import Counter

import numpy as np
import pytest
from test_native import brute_spans
from test_pairs import brute_groups, fingerprint

import corpus_pipeline
from orderlens.llm import decontaminate, language, mixing, pii
from orderlens.llm.bytesets import bucket, encoded, folded


@pytest.fixture(scope="module")
def steps(spark, folder, tmp_path_factory):
    """Documents before the first stage and after each, as the pipeline hands them on."""
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    base = tmp_path_factory.mktemp("stages")
    out.append(docs)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        out.append(docs)
    return out


def rows_of(docs):
    return {row.doc_id: row for row in docs.collect()}


def test_names_and_columns(steps):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_dedup", "decontaminate", "pii", "mixing"]
    for docs in steps[1:5]:
        assert docs.columns == steps[0].columns
    assert set(corpus_pipeline.COLUMNS) <= set(steps[5].columns)


def brute_vector(text, weights):
    """Hashed n-grams counted one by one."""
    data = folded(encoded([text])[0])
    counts = Counter()
    for size in language.LENGTHS:
        for i in range(len(data) - size + 1):
            code = int.from_bytes(data[i : i + size].tobytes(), "big")
            counts[int(bucket(np.array([code], np.uint64), language.BITS, size)[0])] += 1
    vector = np.zeros(1 << language.BITS)
    for feature, n in counts.items():
        vector[feature] = np.log1p(n) * weights[feature]
    return vector / (np.linalg.norm(vector) or 1)


def test_languages(steps):
    model = language.learn(steps[0])
    found = {r.doc_id: r for r in language.predict(steps[0], model).collect()}
    for doc_id in sorted(found)[::10]:
        row = found[doc_id]
        cosine = model.centroids @ brute_vector(row.text, model.weights)
        assert row.score == pytest.approx(float(np.clip(cosine.max(), 0, 1)), abs=1e-4)
        assert row.lang_pred == model.languages[model.of[int(cosine.argmax())]]
    assert set(rows_of(steps[1])) == {i for i, r in found.items() if not r.rejected}


def test_one_document_of_each_group(steps):
    before = {i: fingerprint(r.text) for i, r in rows_of(steps[1]).items()}
    assert set(rows_of(steps[2])) == set(brute_groups(before, 2).values())


def test_no_copy_of_a_test_item_is_left(spark, folder, steps):
    """Alignment of every whole document with every item, without seeds."""
    def normal(text):
        return decontaminate.WORD[encoded([text])[0]].tobytes()

    items = [normal(r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    before, after = rows_of(steps[2]), rows_of(steps[3])
    leaked = {i for i, r in before.items() if any(decontaminate.aligned(normal(r.text), item)[0] >= decontaminate.LEAST for item in items)}
    assert set(after) == set(before) - leaked


def test_personal_data_is_replaced(steps):
    before, after = rows_of(steps[3]), rows_of(steps[4])
    assert set(before) == set(after)
    terms = {r.doc_id for r in pii.found(steps[3]).where("size(spans) > size(base)").collect()}
    for i, row in before.items():
        out, at = [], 0
        for kind, start, end in (s.split(":") for s in brute_spans(row.text)):
            if int(start) >= at:
                out += [row.text[at : int(start)], f"[{kind}]"]
            at = max(at, int(end))
        if i not in terms:
            assert after[i].text == "".join(out) + row.text[at:]
        assert after[i].n_chars == len(after[i].text)
        assert not re.search(r"[\w.+-]+@[\w-]+\.\w", after[i].text)


def test_mixture_is_drawn_by_plain_raking(steps):
    described = steps[4].select("doc_id", *mixing.described(steps[4], "source", "lang", None, "text", "doc_id")).collect()
    total, cells = sum(r.tokens for r in described), Counter()
    for r in described:
        cells[r.source, r.lang, r.topic] += r.tokens
    own = {c: n / total for c, n in cells.items() if n}
    goals = []
    for place, name in enumerate(mixing.DIMENSIONS):
        sums = Counter()
        for c, n in cells.items():
            sums[c[place]] += n
        raw = {k: n ** mixing.POWERS[name] for k, n in sums.items() if n}
        goals.append({k: v / sum(raw.values()) for k, v in raw.items()})
    q, before = dict(own), float("inf")
    for _ in range(mixing.SWEEPS):
        for place, goal in enumerate(goals):
            sums = Counter()
            for c, v in q.items():
                sums[c[place]] += v
            q = {c: min(v * goal[c[place]] / sums[c[place]], own[c] / mixing.BUDGET) for c, v in q.items()}
        error = max(abs(sum(v for c, v in q.items() if c[p] == k) - t) for p, goal in enumerate(goals) for k, t in goal.items())
        if error <= mixing.TOLERANCE or error > 0.999 * before:
            break
        before = error
    chance = {c: min(1.0, mixing.BUDGET * q[c] / own[c]) for c in q}
    want = {r.doc_id for r in described if r.draw_ < chance[r.source, r.lang, r.topic]}
    assert set(rows_of(steps[5])) == want


def test_run_gives_the_last_stage(spark, folder, steps):
    assert set(rows_of(corpus_pipeline.run(spark, folder))) == set(rows_of(steps[5]))
