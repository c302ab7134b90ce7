import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from kindred.llm import mih, quality, toxicity
from kindred.llm.shingles import mix
from kindred.llm.crf import Chain, train

from .conftest import SCHEMA, prose


def brute(chain, odds):
    """Marginals, pair and start expectations of one sequence over all labellings."""
    n, z = len(odds), 0.0
    p, pair, start = np.zeros(n), np.zeros((2, 2)), np.zeros(2)
    for y in itertools.product((0, 1), repeat=n):
        w = math.exp(chain.start[y[0]] + sum(o * v for o, v in zip(odds, y)) + sum(chain.trans[a, b] for a, b in zip(y, y[1:])))
        z += w
        p += w * np.array(y)
        start[y[0]] += w
        for a, b in zip(y, y[1:]):
            pair[a, b] += w
    return p / z, pair / z, start / z


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(3)
    chain = Chain(rng.normal(size=(2, 2)), rng.normal(size=2))
    for lens in ([1], [1, 1, 1], [5, 1, 8], [3] * 11, [9, 2, 7, 7, 1]):
        odds = rng.normal(size=sum(lens)) * 2
        first = np.zeros(sum(lens), bool)
        first[np.cumsum([0, *lens[:-1]])] = True
        post, pair, start = chain.marginals(odds, first, pairs=True)
        want = [brute(chain, x) for x in np.split(odds, np.cumsum(lens)[:-1])]
        assert np.allclose(post, np.concatenate([w[0] for w in want]))
        assert np.allclose(pair, sum(w[1] for w in want)) and np.allclose(start, sum(w[2] for w in want))
    assert len(chain.marginals(np.zeros(0), np.zeros(0, bool))) == 0


def test_training_separates_features():
    types = np.array([0, 1, 2, 0, 1, 0] * 50)
    w, chain = train(types, np.arange(300) % 6 == 0, (types == 2).astype(int), [np.array([0, 3]), np.array([1, 3]), np.array([2, 3])], 4)
    assert w[2] > w[0] and w[2] > w[1]
    post = chain.marginals(np.array([w[0] + w[3], w[2] + w[3]]), np.array([True, False]))
    assert post[1] > 0.5 > post[0]


def toxic_table(spark, n=900):
    r = random.Random(1)
    rows, labels = [], []
    for i in range(n):
        words = prose(i, r.randint(20, 120)).split()
        bad = i % 6 == 0
        for _ in range(r.randint(2, 5) if bad else 0):
            words.insert(r.randrange(len(words)), r.choice(["Zorgo", "zorgoes", "blarnix", "blarnixed"]))
        rows.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, 1, int(bad)))
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_documents(spark):
    docs, labels = toxic_table(spark)
    model = toxicity.fit(*toxicity.training_sample(docs, labels))
    rows = toxicity.tag(docs, model).withColumn("h", toxicity.held_out()).where("h").join(labels, "doc_id").join(docs.select("doc_id", "text"), "doc_id").collect()
    assert len(rows) > 100 and np.mean([(r.score >= 0.5) == r.toxic for r in rows]) > 0.98
    for r in rows:
        found = [r.text[s.start : s.end].lower() for s in r.spans]
        assert all(w.startswith(("zorgo", "blarnix")) for w in found) and (len(found) >= 2) == bool(r.toxic)


def test_toxicity_of_odd_rows(spark, edge_docs, clashing_docs, empty_docs):
    docs, labels = toxic_table(spark, 300)
    model = toxicity.fit(*toxicity.training_sample(docs, labels, 50))
    for d in (edge_docs, clashing_docs):
        rows = toxicity.tag(d, model).collect()
        assert len(rows) == d.count() and all(0 <= r.score <= 1 for r in rows)
        by = {r.doc_id: r.score for r in rows}
        assert by[3] == by[4] == by[5] < 0.5
    assert toxicity.tag(empty_docs, model).count() == 0
    none = toxicity.fit([], [])
    assert toxicity.tag(edge_docs, none).agg(F.max("score")).first()[0] < 1e-6
    nulls = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    assert toxicity.training_sample(docs, nulls) == ([], [])


def quality_table(spark, n=400):
    rows = [(i, " ".join(f"{w}!!" if i % 5 == 0 else w for w in (prose(i, 60).upper() if i % 5 == 0 else prose(i, 60)).split()), "en", "s", 0) for i in range(n)]
    labels = [(i, int(i % 5 != 0), 0) for i in range(0, n, 2)]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_rejects_junk_and_samples_k(spark):
    docs, labels = quality_table(spark)
    rows = quality.classify(docs, labels).collect()
    assert len(rows) == 400
    assert all(r.kept == (r.doc_id % 5 != 0) for r in rows)
    good = sum(r.per_gram > 0 for r in rows)
    assert sum(r.kept for r in rows) == good
    assert {r.doc_id for r in rows if r.kept} == {r.doc_id for r in sorted(rows, key=lambda r: (-r.key, r.doc_id))[:good]}


def test_quality_of_odd_rows(spark, edge_docs, clashing_docs, empty_docs):
    _, labels = quality_table(spark, 30)
    for d in (edge_docs, clashing_docs):
        assert quality.classify(d, labels).count() == d.count()
    assert quality.classify(edge_docs, labels.where("false")).where("not kept").count() == 0
    assert quality.classify(empty_docs, labels).count() == 0


def test_top_k_equals_sorting(spark):
    r = random.Random(2)
    rows = [(i, r.choice([1.5, 2.0, r.random(), -r.random() * 1e6])) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, key double")
    order = sorted(rows, key=lambda x: (-x[1], x[0]))
    for k in (1, 2, 77, 300, 599, 600):
        key, tie = quality.top_k(df, "key", "id", k)
        assert (tie, key) == order[k - 1]


def vectors(n, dim=16, seed=1):
    x = np.random.default_rng(seed).normal(size=(n, dim))
    x[n // 2 : n // 2 + 40] = x[5]  # one very common vector
    return x.astype(np.float32)


def neighbours(x, ids, q, k):
    s = (x.astype(float) * x[ids.index(q)].astype(float)).sum(axis=1)
    return [j for _, j in sorted((-v, j) for v, j in zip(s, ids) if j != q)][:k]


def test_nearest_recall_and_order(spark):
    x = vectors(3000)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for r in mih.nearest(df, F.col("vec_id") % 20 == 0, 20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r)
    assert set(got) == set(range(0, 3000, 20))
    hits = 0
    for q, rows in got.items():
        assert [r.rank for r in rows] == list(range(1, 21))
        assert [(r.score, -r.vec_id) for r in rows] == sorted([(r.score, -r.vec_id) for r in rows], reverse=True)
        assert all(abs(r.score - float(x[r.vec_id].astype(float) @ x[q].astype(float))) < 1e-9 for r in rows)
        hits += len({r.vec_id for r in rows} & set(neighbours(x, list(range(3000)), q, 20)))
    assert hits >= 0.9 * 20 * len(got)


def test_index_finds_every_code_in_the_radius():
    rng = np.random.default_rng(4)
    codes = rng.integers(0, 1 << 63, 500, dtype=np.int64).astype(np.uint64)
    codes[:50] = codes[0] ^ (np.uint64(1) << np.arange(50, dtype=np.uint64))
    index = mih.Index(codes, 64)
    for radius in (0, 1, 7, 8, 20, 30):
        assert index.within(codes[3], radius).tolist() == np.flatnonzero(np.bitwise_count(codes ^ codes[3]) <= radius).tolist()


def test_nearest_of_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [float("inf"), 1.0]), (None, [1.0, 1.0]), (20, [2.0, 0.1]), (20, [2.0, 0.1]), (7, [0.5, 0.5])]
    df = spark.createDataFrame([(*r, k, k) for k, r in enumerate(rows)], "vec_id long, embedding array<double>, rank int, block int")
    got = mih.nearest(df, F.col("vec_id") % 20 == 0, 20).orderBy("query_id", "rank").collect()
    assert [r.vec_id for r in got if r.query_id == 0] == [20, 20, 1, 7]
    assert [r.vec_id for r in got if r.query_id == 20] == [0, 1, 7]
    assert mih.nearest(df.where("false"), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("token,want", [("THE", "THE"), ("hello", "xx"), ("Hello", "Xx"), ("HELLO", "XX"), ("123456", "9999"), ("!!!!!!", "!!!!"), ("heLLo", "xX")])
def test_shapes(token, want):
    assert quality.shape(token) == want


def test_an_over_long_text_does_not_end_the_sample(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    texts, toxic = toxicity.training_sample(docs, labels)
    assert len(texts) > 30
    monkeypatch.setattr(toxicity, "TEXT_LIMIT", 1000)
    for k in (0, 3):
        longer = docs.withColumn("text", F.when(F.col("text") == texts[k], F.repeat(F.lit("x"), 1001)).otherwise(F.col("text")))
        assert toxicity.training_sample(longer, labels) == (texts[:k] + texts[k + 1 :], toxic[:k] + toxic[k + 1 :])


def test_nearest_among_vectors_of_several_lengths(spark):
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(60)]
    rows += [(i, rng.normal(size=5).tolist()) for i in range(60, 75)] + [(100, rng.normal(size=40).tolist()), (40, [1.0] * 5), (7, [0.5] * 5)]
    got = {}
    for r in mih.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, 70).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = {}
    for q in (0, 20, 40, 60):
        v = min(x for i, x in rows if i == q)
        want[q] = [i for _, i in sorted((-float(np.dot(x, v)), i) for i, x in rows if i != q and len(x) == len(v))]
    assert got == want


def test_probing_touches_few_rows_where_neighbours_are_near():
    """Clusters, as embeddings of texts have: at a recall of 0.9 or more under a tenth of the rows is probed."""
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(200, 1, 64)) + 0.12 * rng.normal(size=(200, 30, 64))).reshape(-1, 64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    codes = mih.Codes(x, 20, 1.0)
    index, probed, hits = mih.Index(codes.of(x), codes.bits), 0, 0
    asked = range(0, len(x), 20)
    for q, code in zip(asked, codes.of_queries(x[list(asked)])):
        s = x @ x[q]
        s[q] = -9
        hits += len(np.intersect1d(np.argsort(-s)[:20], index.within(code, codes.radius)))
        probed += len(index.probed(code, codes.radius))
    assert hits >= 0.9 * 20 * len(asked)
    assert probed < 0.1 * len(x) * len(asked)


def test_thresholds_hold_every_code_of_the_radius():
    for bits in (1, 5, 16, 21, 64):
        for radius in range(bits + 1):
            t = mih.thresholds(bits, radius)
            assert sum(x + 1 for x in t) == min(radius, bits) + 1 and all(x <= min(16, bits - 16 * s) for s, x in enumerate(t))


def test_quality_equals_a_naive_version(spark):
    """Counts, ratios, boundary and the k largest keys, written out plainly."""
    docs, labels = quality_table(spark, 120)
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}

    def grams(text):
        h = [int.from_bytes(xxhash.xxh3_64_digest(quality.shape(t)), "big") for w in text.split() for t in quality.TOKEN.findall(w)]
        both = [(a * 0x9E3779B97F4A7C15 + b) % 2**64 for a, b in zip(h, h[1:])]
        return [x % quality.BUCKETS for x in h] + [int(mix(np.array([x], np.uint64))[0]) % quality.BUCKETS for x in both]

    own = {r.doc_id: grams(r.text) for r in docs.collect()}
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    bad = {r.doc_id for r in labels.where("quality = 0").collect()}
    raw, target = Counter(x for g in own.values() for x in g), Counter(x for i in good for x in own[i])
    n_raw, n_target = sum(raw.values()) + 0.1 * quality.BUCKETS, sum(target.values())
    p = lambda x: (raw[x] + 0.1) / n_raw
    ratio = lambda x: math.log((target[x] + 1000 * p(x)) / (n_target + 1000)) - math.log(p(x))
    per = {i: sum(map(ratio, g)) / max(len(g), 1) for i, g in own.items()}
    assert all(abs(got[i].per_gram - per[i]) < 1e-9 for i in own)
    tried = sorted(per[i] for i in good | bad)
    cuts = [tried[0] - 1, *((a + b) / 2 for a, b in zip(tried, tried[1:])), tried[-1] + 1]
    lost = lambda c: sum(per[i] < c for i in good) / len(good) + sum(per[i] >= c for i in bad) / len(bad)
    assert abs(lost(quality.boundary(np.array([per[i] for i in good]), np.array([per[i] for i in bad]))) - min(map(lost, cuts))) < 1e-9
    k = sum(r.kept for r in got.values())
    assert {i for i, r in got.items() if r.kept} == {r.doc_id for r in sorted(got.values(), key=lambda r: (-r.key, r.doc_id))[:k]}


def test_a_vector_of_extreme_length_changes_nothing(spark):
    """The other vectors keep codes, radius and recall; the long ones are found where they are nearest."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(2000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    kinds = "vec_id long, embedding array<double>"
    plain = {(r.query_id, r.vec_id) for r in mih.nearest(spark.createDataFrame(rows, kinds), F.col("vec_id") % 100 == 0, 20).collect()}
    far = [(5001, (1e20 * x[7]).tolist()), (5002, (1e-20 * x[8]).tolist()), (5003, (-1e120 * x[9]).tolist())]
    got = mih.nearest(spark.createDataFrame(rows + far, kinds), F.col("vec_id") % 100 == 0, 20).collect()
    found = {(r.query_id, r.vec_id) for r in got}
    every = np.concatenate([x, [v for _, v in far]])
    ids = np.array([*range(len(x)), 5001, 5002, 5003])
    hits = 0
    for q in range(0, 2000, 100):
        s = (every * every[q]).sum(axis=1)
        best = [int(ids[i]) for i in np.lexsort((ids, -s)) if ids[i] != q][:20]
        hits += sum((q, i) in found for i in best)
        for i in (5001, 5003):
            assert ((q, i) in found) == (i in best)
    assert hits >= 0.9 * 20 * 20
    assert len({(q, i) for q, i in plain if i < 5000} - found) <= 3 * 20  # those that the far ones push out
