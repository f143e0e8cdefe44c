"""Hard negatives, fill-in-the-middle and secrets against brute force."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from compare import difference, duck
from pyspark.sql import functions as F

from orderlens.llm import catalog, infill, negatives, secrets

# ---- hard negatives


def brute_force(rows, is_anchor, positives=5, negatives_=10):
    """rows: (id, label, vector); every pair scored with Python's whole numbers."""
    ok = [
        (i, lab, [int(np.floor(256.0 * x)) for x in v])
        for i, lab, v in rows
        if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    out = []
    for i, lab, v in ok:
        if not is_anchor(i):
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), j, other == lab) for j, other, w in ok]
        best = sorted((s, j) for s, j, same in scored if same and j != i)[:positives]
        for s, j in best:
            p = -s
            fits = sorted((t, k) for t, k, same in scored if not same and 30 * p <= -100 * t <= 90 * p)[:negatives_]
            out += [(i, j, rank + 1, k, p, -t) for rank, (t, k) in enumerate(fits)]
    return sorted(out)


def mined(spark, rows, every=10, **how):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = negatives.mined(df.repartition(3), F.col("id") % every == 0, **how)
    return sorted(map(tuple, got.collect()))


def test_negatives_equal_brute_force_in_blocks(spark):
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(6, 24)) * 0.2
    rows = [(i, int(i % 7), (centre[i % 6] + rng.normal(size=24) * 0.15).tolist()) for i in range(600)]
    rows += [(600 + i, i % 3, rows[20][2]) for i in range(150)]  # a very common vector: ties by id
    want = brute_force(rows, lambda i: i % 10 == 0)
    assert len(want) > 500
    assert mined(spark, rows) == want
    assert mined(spark, rows, block=40) == want


def test_thresholds_are_lowered_until_windows_fill(spark, monkeypatch):
    rng = np.random.default_rng(2)
    # two scales: far more spread than a normal distribution expects, so first thresholds are off
    rows = [(i, int(rng.integers(3)), (rng.normal(size=8) * (3.0 if i % 40 == 0 else 0.05)).tolist()) for i in range(800)]
    monkeypatch.setattr(negatives, "FIRST", 1)
    assert mined(spark, rows, every=20) == brute_force(rows, lambda i: i % 20 == 0)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, 1, [0.5, 0.25]), (10, 1, None), (20, None, [1.0, 1.0]), (30, 1, [nan, 1.0]), (40, 1, [1.0, inf]), (50, 1, [None, 1.0]),
        (None, 1, [1.0, 1.0]), (1, 1, [0.5, 0.5]), (2, 2, [0.25, 0.25]), (3, 2, [0.25, 0.25]), (3, 2, [0.25, 0.25]), (4, 2, [0.3]),
        (5, 2, []), (60, 9, [0.1, 0.1]), (70, 2, [-1.0, -1.0]),
    ]
    assert mined(spark, rows) == brute_force(rows, lambda i: i % 10 == 0)
    assert mined(spark, []) == []
    assert mined(spark, [(1, 1, [1.0]), (2, 2, [1.0])]) == []  # no anchor
    large = [(0, 1, [1e30, 1.0]), (1, 1, [9e9, 2.0]), (2, 2, [8000.0, 1.0])]
    top = mined(spark, large)
    assert [(r[0], r[1], r[3]) for r in top] == [(0, 1, 2)] and top[0][4] == (1 << 44) + 256 * 512


def test_survivors_are_all_pairs_above_the_threshold():
    rng = np.random.default_rng(3)
    for scale in (40, 1 << 21):
        x, q = (rng.integers(-scale, scale, (n, 13)) for n in (90, 30))
        x[:20, 4:] = 0  # covered by the bound early
        for quantile in (0.2, 0.7, 0.99, 1):
            whole = x @ q.T
            threshold = np.quantile(whole, quantile, axis=0)
            row, anchor, score = negatives.survivors(x, q, threshold)
            want = np.argwhere(whole >= threshold)
            assert sorted(zip(row.tolist(), anchor.tolist())) == [tuple(p) for p in want.tolist()]
            assert (score == whole[row, anchor]).all()


# ---- fill in the middle


@pytest.mark.parametrize("unit", ["char", "word"])
def test_skip_list_reaches_every_rank(unit):
    rng = np.random.default_rng(4)
    alphabet = list("ab \n\tßé漢😀")
    for size in (1, 31, 32, 33, 1024, 1100):
        text = "".join(rng.choice(alphabet, size))
        data = np.frombuffer(text.encode(), np.uint8)
        units = infill.skip_list(data, unit)
        parts = list(text) if unit == "char" else [p for p in re.findall(r"^[ \t\n]+|[^ \t\n]+[ \t\n]*", text) if p]
        assert units.lanes[0].shape[1] == len(parts)
        for rank in range(len(parts) + 1):
            before = "".join(parts[:rank])
            assert units.place(rank) == (len(before), len(before.encode()))


def test_outputs_give_the_texts_back(spark):
    texts = ["", None, "x", "<P> stays plain", "a<", "äöü" * 5000, "two words", "a\x00b", "漢字かな交じり文 " * 99]
    rows = [(i, t) for i in range(60) for t in texts] + [(None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("form", F.lit("clash"))
    out = infill.restored(infill.transformed(docs))
    for r in out.collect():
        text = r.text or ""
        assert r.restored == text and r.n == len(text)
        if r.form == "plain":
            assert r.output == text and r.prefix_chars is None and r.middle_chars is None
            continue
        h = hashlib.sha256(f"1:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
        a, b = sorted((h1 % (len(text) + 1), h2 % (len(text) + 1)))
        assert (r.prefix_chars, r.middle_chars) == (a, b - a) and h3 % 100 < 90
        want = f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}" if h4 % 100 < 20 else f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"
        assert r.output == want
    assert {r.form for r in out.collect()} == {"plain", "psm", "spm"}
    assert infill.transformed(docs.limit(0)).collect() == []


# ---- secrets

BASE = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[1]) >= 8),
    "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16),
    "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 32),
}


def token(body, start="ghp_"):
    code, end = zlib.crc32(body.encode()), ""
    for _ in range(6):
        code, digit = divmod(code, 62)
        end = secrets.BASE62[digit] + end
    return start + body + end


def base_spans(text):
    found = []
    for order, (kind, (pattern, good)) in enumerate(BASE.items()):
        found += [(m.start(), order, m.end(), kind) for m in re.finditer(pattern, text, re.A) if good(m)]
    return sorted(found)


def test_base_secrets_equal_regular_expressions():
    rng = np.random.default_rng(5)
    pieces = ["password", "PassWd", "secret", "token", "api_key", "ApiKey", "AKIA", "akia", "=", ":", " ", "'", '"', "abcdef0123456789", "ABCD1234",
              "é", "漢", "x", "\n", "=abcdefgh", "K", "ſecret", "secrettoken:", "0123456789abcdef" * 2]
    for _ in range(3000):
        text = "".join(rng.choice(pieces, rng.integers(1, 12)))
        got = [s for s in secrets.spans(text.encode()) if s[1] < len(secrets.BASE)]
        assert got == base_spans(text), text


def test_checksums_decide():
    body = "a1B2c3D4e5F6g7H8i9J0k1L2m3N4o5"
    good = token(body)
    bad = good[:-1] + ("A" if good[-1] != "A" else "B")
    kinds = lambda text: [s[3] for s in secrets.spans(text.encode())]
    assert kinds(f"use {good} here") == ["host_token"]
    assert kinds(f"use {bad} here") == [] and kinds(f"use {good}x here") == []
    assert kinds(token(body, "npm_")) == ["package_token"]
    assert kinds(f"token = {bad}") == ["assign"]
    # the published first test vector of hierarchical wallets
    key = "xprv9s21ZrQH143K3QTDL4LXw2F7HEK3wJUD2nW2nRk4stbPy6cq3jPPqjiChkVvvNKmPGJxWUtg6LnF5kejMRNNU3TGtRBeJgk33yuGBxrMPHi"
    assert kinds(f"key {key}") == ["wallet_key"] and kinds(f"key {key[:-1]}j") == []


def test_many_matches_in_one_text_take_linear_time():
    text = "token=abcdefgh1 é " * 50_000
    found = secrets.spans(text.encode())
    assert len(found) == 50_000 and found[-1][0] == 18 * 49_999


# ---- the registered queries


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_fill_in_middle"])
def test_registered_queries_equal_sql(spark, folder, name):
    got, want = catalog.QUERIES[name](spark, folder).toPandas(), duck(folder).execute(catalog.SQL[name]).df()
    for column in {"prefix_chars", "middle_chars"} & set(got.columns):  # whole numbers with gaps have two types in pandas
        got[column], want[column] = got[column].astype("Int64"), want[column].astype("Int64")
    assert difference(got, want) is None and len(got)


def test_registered_secrets_equal_brute_force(spark, folder):
    folder = folder.replace("sf0.001", "sf0.01")  # the smallest tables hold no secret
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in documents.collect()}
    rows = catalog.QUERIES["op13_secrets"](spark, folder).collect()
    assert len(rows) == documents.count()
    for r in rows:
        base = base_spans(texts[r.doc_id])
        joined = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[3] == kind for s in base) for kind in BASE)
    assert sum(r.n_assign + r.n_access + r.n_hex for r in rows) > 0
