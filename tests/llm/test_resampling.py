"""Mixing, importance resampling and whitening against plain versions on the driver."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from kindred.llm import importance, mixing, whitening
from kindred.operators import order

from .conftest import SCHEMA, prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_features(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def plain_resample(docs, target, percent=5, least=20, seed=42):
    """(doc_id, n_words, n_features, weight, score, rank) as the rule states them."""
    own = [(i, *plain_features(t)) for i, t in docs]
    s, t = Counter(b for *_, f in own for b in f), Counter(b for x in target for b in plain_features(x)[1])
    S, T = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000))))
    rows = []
    for i, n, f in own:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(map(gain, f))
        rows.append([i, n, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    enough = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, -r[3], r[2], r[1]))
    for k, r in enumerate(enough[: percent * len(enough) // 100], 1):
        r[5] = k
    return rows


def same(a, b):
    key = lambda row: tuple((x is None, x or 0) for x in row)
    assert sorted(map(tuple, a), key=key) == sorted(map(tuple, b), key=key)


def strings(r, n):
    return ["".join(r.choices("abcXYZ 09é.,日\n", k=r.randint(0, 200))) for _ in range(n)]


@pytest.mark.parametrize("step, piece", [(1 << 18, 1 << 20), (7, 50), (1, 1)])
def test_features_equal_plain_hashing(monkeypatch, step, piece):
    """Runs across pieces and batches, words longer than the tables, texts without words."""
    monkeypatch.setattr(importance, "STEP", step)
    monkeypatch.setattr(importance, "PIECE", piece)
    texts = [*strings(random.Random(1), 40), None, "", "x" * 1000 + " a b " + "y" * 254 + " " + "z" * 255 + " " + "w" * 256 + " c", "a " * 30]
    got, n = [[] for _ in texts], [0] * len(texts)
    for doc, bucket, single in importance.features(texts):
        for d, b in zip(doc, bucket):
            got[d].append(b)
        for d in doc[:single]:
            n[d] += 1
    for text, have, words in zip(texts, got, n):
        want = plain_features(text)
        assert (words, sorted(have)) == (want[0], sorted(want[1]))


def test_resampling_equals_the_rule(spark, edge_docs, clashing_docs, empty_docs):
    r = random.Random(4)
    rows = [(i, prose(i, r.randint(0, 60))) for i in range(300)] + [(7, prose(900, 40)), (7, prose(900, 40)), (None, prose(901, 30)), (400, None), (401, "")]
    target = [prose(i, 50) for i in range(0, 60, 3)] + [None, ""]
    bench = spark.createDataFrame([(x,) for x in target], "text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    same(importance.resample(docs, bench, percent=20).collect(), plain_resample(rows, target, percent=20))
    rows = [(x.doc_id, x.text) for x in edge_docs.select("doc_id", "text").collect()]
    for docs in (edge_docs, clashing_docs):
        same(importance.resample(docs, bench, percent=50, least=2).collect(), plain_resample(rows, target, percent=50, least=2))
    nothing = spark.createDataFrame([], "text string")
    same(importance.resample(edge_docs, nothing).collect(), plain_resample(rows, []))
    assert importance.resample(empty_docs, bench).count() == 0


def test_ties_go_to_the_smaller_id(spark):
    n = 64
    rows = spark.range(n).selectExpr("id as doc_id", "id % 2 as score")
    got = {x.doc_id: x.rank for x in order.numbered(rows.repartition(7), "rank", rows.score.desc(), rows.doc_id.asc()).collect()}
    assert got == {i: k for k, i in enumerate([*range(1, n, 2), *range(0, n, 2)], 1)}


def plain_targets(sizes, weights, cap):
    """Shares by weight; what a full source cannot take is shared anew."""
    full, out, left = set(), {}, sum(sizes.values())
    while len(full) < len(sizes):
        open_ = sum(weights[s] for s in sizes if s not in full)
        out |= {s: left * weights[s] / open_ for s in sizes if s not in full}
        over = {s for s in sizes if s not in full and cap * sizes[s] <= out[s]}
        if not over:
            break
        full |= over
        out |= {s: float(cap * sizes[s]) for s in over}
        left = sum(sizes.values()) - sum(cap * sizes[s] for s in full)
    return out


def corpus(seed, shape):
    r = random.Random(seed)
    return [(i, " ".join("w" * (k % 3 + 1) for k in range(int(r.paretovariate(1.5)) + 3)), None, src, None) for src, n in shape.items() for i in range(n)]


@pytest.mark.parametrize("shape", [{"a": 40, "b": 300, "c": 60, "d": 2, None: 50}, {"a": 1}, {None: 30}, {"b": 3, "a": 500}], ids=str)
def test_mix_meets_targets(spark, shape):
    rows = corpus(len(shape), shape)
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(docs.repartition(6)).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += size(t)
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    want = plain_targets(sizes, {s: k % 3 + 1 for k, s in enumerate(names)}, 3)
    assert len(got) == len(rows)
    same([(r.doc_id, r.source, r.size, r.source_size) for r in got], [(i, s, size(t), sizes[s]) for i, t, _, s, _ in rows])
    for s in names:
        own = [r for r in got if r.source == s]
        assert {r.target for r in own} == {want[s]}
        assert all(0 <= r.copies <= 3 and r.taken == r.copies * r.size for r in own)
        # Whole documents come as near as the smaller of those that could be added or left out.
        assert abs(sum(r.taken for r in own) - want[s]) <= max(r.size for r in own) / 2
        if len(own) >= 40:
            assert abs(sum(r.taken for r in own) - want[s]) <= 0.02 * want[s] + 5
    if len(shape) == 5:  # reruns agree
        same(map(tuple, mixing.mix(docs.repartition(3)).collect()), map(tuple, got))


def test_expected_copies_of_the_mix(spark):
    """Over seeds a document's mean number of copies is what its measure asks for."""
    rows = [(i, "w " * (4 + (i % 5) ** 3), None, "ab"[i % 2], None) for i in range(40)]
    docs = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    total, seeds = Counter(), 4
    for seed in range(seeds):
        for r in mixing.mix(docs, seed=seed).collect():
            total[r.source, r.size] += r.copies
    for s, k in (("a", 0), ("b", 1)):
        sizes = [4 + (i % 5) ** 3 for i in range(k, 40, 2)]
        target = plain_targets({"a": sum(4 + (i % 5) ** 3 for i in range(0, 40, 2)), "b": sum(4 + (i % 5) ** 3 for i in range(1, 40, 2))}, {"a": 1, "b": 2}, 3)[s]
        low, high = 0.0, 100.0
        for _ in range(80):
            mid = (low + high) / 2
            low, high = (mid, high) if sum(min(3, mid * math.isqrt(x)) * x for x in sizes) < target else (low, mid)
        for x in set(sizes):
            want = min(3, low * math.isqrt(x)) * sizes.count(x)
            assert abs(total[s, x] / seeds - want) <= 2.1, (s, x, total[s, x] / seeds, want)


def test_mix_of_odd_rows(spark, edge_docs, clashing_docs, empty_docs):
    a, b = (mixing.mix(d).collect() for d in (edge_docs, clashing_docs))
    same(a, b)
    assert len(a) == edge_docs.count() and all(r.taken == 0 for r in a if r.size == 0)
    assert mixing.mix(empty_docs).count() == 0
    nothing = mixing.mix(spark.createDataFrame([(1, None, "e", "s", 0), (2, "", "e", None, 0)], SCHEMA)).collect()
    assert [(r.size, r.target, r.taken) for r in nothing] == [(0, 0.0, 0)] * 2


def plain_whitening(vectors):
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1000000
    n, s = len(x), x.sum(axis=0)
    values, axes = np.linalg.eigh(np.cov(x.T.astype(float), bias=True))
    values, axes = values[::-1], axes[:, ::-1]
    m = min(32, x.shape[1])
    return ((n * x - s) ** 2).sum(axis=1), (x - s / n) @ axes[:, :m] / np.sqrt(values[:m]), values[:m] / values.sum()


VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("size", [5, 40])
def test_whitening_equals_numpy(spark, size):
    rng = np.random.default_rng(size)
    x = (rng.normal(size=(300, size)) @ rng.normal(size=(size, size)) + 5).astype(np.float32)
    odd = [(900, None, 0), (901, [None] + [1.0] * (size - 1), 0), (902, [float("nan")] * size, 0), (903, [float("inf")] * size, 0), (904, [], 0), (905, [1.0], 0)]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + odd + [(None, x[0].tolist(), 1), (3, x[3].tolist(), 1)]
    x = np.concatenate([x, x[[0, 3]]])
    dev, z, explained = plain_whitening(x)
    got = whitening.whiten(spark.createDataFrame(rows, VECTORS).repartition(5)).toPandas()
    m = min(32, size)
    assert len(got) == len(x) * m and (got.n == len(x)).all() and got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9
    one = got[got.vec_id == 7].sort_values("component")
    sign = np.sign(one.whitened.to_numpy()) * np.sign(z[7])
    for i in (7, 11, 200):
        own = got[got.vec_id == i].sort_values("component")
        assert (own.deviation == dev[i]).all()
        np.testing.assert_allclose(own.whitened, z[i] * sign, rtol=1e-6, atol=1e-8)
        np.testing.assert_allclose(own.explained, explained, rtol=1e-8)
    assert (got.vec_id == 3).sum() == 2 * m and got.vec_id.isna().sum() == m


def test_whitening_of_odd_tables(spark):
    none = spark.createDataFrame([], VECTORS)
    assert whitening.whiten(none).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None, 0), (2, [], 0)], VECTORS)).count() == 0
    one = whitening.whiten(spark.createDataFrame([(1, [0.5, 0.25], 0)], VECTORS)).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 0, None, None, None)] * 2
    # One dimension follows another: one axis has no variance.
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), float(i)], 0) for i in range(9)], VECTORS)).collect()
    assert all((r.whitened is None) == (r.component == 2) for r in line) and line[0].identity_error < 1e-9
    # Entries beyond the range of exact numbers are held at its edge; nothing overflows.
    far = [(i, [1e30 if i == 0 else -1e30 if i == 1 else 0.1 * i, 0.3 * (i % 4)], 0) for i in range(50)]
    far = whitening.whiten(spark.createDataFrame(far, VECTORS)).collect()
    assert len(far) == 100 and all((r.deviation is None) == (r.vec_id < 2) and r.n == 50 for r in far)
    clash = spark.createDataFrame([(i, [float(i), float(i * i)], 0, 1, 2.0, 3) for i in range(9)], VECTORS + ", x int, z double, n int")
    assert whitening.whiten(clash).count() == 18
