"""SimHash groups, decontamination and the pipeline against brute force."""

import re

import numpy as np
import pytest
import xxhash

from orderlens.llm import decontaminate, simhash


def fingerprint(text: str, size: int = 3) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda c: c[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] if len(words) >= size else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(h >> bit & 1 for h in hashes) > len(hashes)) << bit for bit in range(64))


def brute_groups(prints: dict[int, int], most: int) -> dict[int, int]:
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= most:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_fingerprints_and_groups_equal_brute_force(documents):
    texts = {row.doc_id: row.text for row in documents.select("doc_id", "text").collect()}
    prints = {i: fingerprint(t) for i, t in texts.items()}
    want = brute_groups(prints, 2)
    for row in simhash.grouped(documents).collect():
        assert row.fingerprint % (1 << 64) == prints[row.doc_id]
        assert row.component_id == want[row.doc_id]


@pytest.mark.parametrize("cell_rows", [4096, 20])
def test_links_of_crowded_cells(spark, cell_rows):
    """A dense cluster, chains and far fingerprints; with a small limit the cells are dealt again."""
    rng = np.random.default_rng(3)
    centre = int(rng.integers(0, 1 << 62))
    prints = {centre ^ (1 << a) ^ (1 << b) for a in range(0, 30, 3) for b in range(1, 30, 4)}
    chain = int(rng.integers(0, 1 << 62))
    for bit in range(0, 60, 2):
        chain ^= 3 << bit
        prints.add(chain)
    prints |= {int(x) for x in rng.integers(0, 1 << 62, 300)}
    rows = spark.createDataFrame([(p,) for p in prints], "fp long")
    found = {r.node: r.root for r in simhash.components(simhash.links(rows, 2, cell_rows)).collect()}
    want = brute_groups({p: p for p in prints}, 2)
    groups = lambda of: {frozenset(p for p in prints if of(p) == root) for root in {of(p) for p in prints}}
    assert groups(lambda p: found.get(p, p)) == groups(lambda p: want[p])


def test_one_row_of_each_group_stays(documents):
    groups = simhash.grouped(documents).select("component_id").distinct().count()
    kept = simhash.deduplicated(documents)
    assert kept.columns == documents.columns
    assert kept.count() == groups
    twice = documents.union(documents)
    assert simhash.deduplicated(twice).count() == groups


def brute_alignment(passage: list[str], item: list[str]) -> float:
    best, row = 0, [0] * (len(passage) + 1)
    for word in item:
        new = [0]
        for j, other in enumerate(passage, 1):
            new.append(max(0, row[j - 1] + (2 if word == other else -1), row[j] - 1, new[j - 1] - 1))
        row, best = new, max(best, *new)
    return best / (2 * len(item))


def test_alignment_equals_the_textbook_recurrence():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = (list(map(str, rng.integers(0, 6, rng.integers(1, 15)))) for _ in range(2))
        score, _ = decontaminate.aligned(" ".join(b).encode(), " ".join(a).encode())
        assert score == pytest.approx(brute_alignment(b, a))


def test_copies_edited_copies_and_clean_texts(spark, documents):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    words = item.split()
    edited = " ".join(w if i % 7 != 3 else "other" for i, w in enumerate(words))
    shorter = " ".join(w for i, w in enumerate(words) if i % 6 != 2)
    rows = [
        (1, f"before it {item} after it"),
        (2, f"some words {edited.upper()} more words"),
        (3, f"x y z {shorter} x y z"),
        (4, "alpha beta gamma and nothing else of it"),
        (5, "nothing at all"),
        *[(100 + i, f"{i} common words {item} end") for i in range(300)],
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, item), (2, "common words that every document has at times")], "item_id long, text string")
    found = {r.doc_id: r for r in decontaminate.leaks(docs, items).collect() if r.item_id == 1}
    assert set(found) == {1, 2, 3} | {100 + i for i in range(300)}
    assert found[1].score == 1.0 and 0.6 <= found[2].score < 1 and 0.6 <= found[3].score < 1
    assert {r.doc_id for r in decontaminate.clean(docs, items).collect()} == {4, 5}


@pytest.mark.parametrize("same", [True, False])
def test_many_edited_copies_beside_one_verbatim(spark, same):
    """A word inserted after every third: the seeds that survive are in 61 documents, all others in one."""
    words = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]
    edited = " ".join(w + " inserted" * (i % 3 == 2) for i, w in enumerate(words))
    rows = [(1, " ".join(words)), (2, f"{words[0]} {words[1]} {words[2]} is no copy")]
    rows += [(100 + i, edited if same else f"text number {i} {edited} end {i}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    found = {r.doc_id: r.score for r in decontaminate.leaks(docs, items).collect()}
    assert set(found) == {1, *range(100, 160)}
    assert found[1] == 1.0 and all(0.8 < found[100 + i] < 0.9 for i in range(60))


def test_no_alignment_scores_more_than_the_shared_words():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a, b = (" ".join(map(str, rng.integers(0, 6, rng.integers(1, 15)))).encode() for _ in range(2))
        assert decontaminate.aligned(b, a)[0] <= decontaminate.reachable(b, a) + 1e-12


def test_verbatim_items_in_the_tables(spark, documents, folder):
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    normal = lambda t: " " + " ".join(re.sub(r"[^a-z0-9\x80-\U0010ffff]", " ", re.sub("[A-Z]", lambda c: c[0].lower(), t)).split()) + " "
    texts = {r.doc_id: normal(r.text) for r in documents.collect()}
    want = {(d, r.item_id) for r in items.collect() for d, t in texts.items() if normal(r.text) in t}
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.leaks(documents, items).collect()}
    assert want <= set(got)
    assert all(got[pair] == 1.0 for pair in want)


def test_a_common_word_run_joins_nothing_alone(spark, monkeypatch):
    """Every document and every item has "one of the", and nothing else in common."""
    rows = [(i, f"{' '.join(f'd{i}w{k}' for k in range(30))} one of the {' '.join(f'e{i}w{k}' for k in range(30))}") for i in range(300)]
    items = [(i, f"{' '.join(f'q{i}w{k}' for k in range(20))} one of the {' '.join(f'r{i}w{k}' for k in range(20))}") for i in range(40)]
    items.append((99, "one of the"))  # an item of nothing else is really in all of them
    seen = []
    whole = decontaminate.alignments

    def counted(pairs, least):
        seen.append(pairs.count())
        return whole(pairs, least)

    monkeypatch.setattr(decontaminate, "alignments", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = decontaminate.leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(i, 99) for i in range(300)}
    assert seen[0] <= 300 + 40
