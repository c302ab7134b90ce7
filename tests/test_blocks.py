"""Comparisons in blocks against columns, brute force, and a bound of their cost."""

import time
from collections import Counter

import numpy as np
import pytest

from kindred.functions import columns as C
from kindred.operators import blocks, metrics, search
from pyspark.sql import functions as F

CODES = "gid long, code long, emb array<float>"


def table(spark, n, dim=16, seed=1, odd=()):
    x = np.random.default_rng(seed).normal(size=(n, dim)).astype(np.float32).tolist()
    code = lambda v: sum((y > 0) << i for i, y in enumerate(v[:12]))
    return spark.createDataFrame([(i, code(v), v) for i, v in enumerate(x)] + list(odd), CODES)


ODD = [(900, None, None), (950, 3, [None] * 16), (901, 3, [1e30] + [0.0] * 15), (902, 1, [0.5] * 3), (1000, 5, [2e8] * 16)]


@pytest.mark.parametrize("odd", [(), ODD])
def test_counts_equal_those_of_columns(spark, odd):
    c = table(spark, 700, odd=odd).repartition(3)
    q = c.where("gid % 50 = 0")
    pairs = search.all_pairs(q, c, 12)
    want = {tuple(r): r["n"] for r in pairs.groupBy(F.floor(F.col("sq_l2") * 4).alias("step"), F.col("h").cast("long").alias("h")).agg(F.count("*").alias("n")).collect()}
    got = Counter()
    for r in blocks.histogram(q, c, 12, 4).collect():
        got[r.step, r.h] += r.n
    assert {(*k, n) for k, n in got.items()} == set(want)
    e = pairs.where("qid not in (901, 1000) and gid not in (901, 1000)").select(F.col("sq_l2").alias("t"), (F.col("h") / 4.0).alias("est"))
    few = c.where("gid not in (901, 1000)")
    s = blocks.squared_error(few.where("gid % 50 = 0"), few, 12, 0.25, 2.5).agg(F.sum("total").alias("t"), F.sum("k").alias("k"), F.sum("n").alias("n")).first()
    m = metrics.mean_squared_error(e, 2.5).first()
    assert s.n == m.n and abs(s.t / s.k - m.mse) < 1e-9 * m.mse


@pytest.mark.parametrize("odd", [(), ODD])
def test_kernels_equal_those_of_columns(spark, odd):
    c = table(spark, 300, odd=odd)
    q = c.where("gid % 50 = 0")
    want = search.all_pairs(q, c, 12).select("qid", "gid", *(F.round(C.similarity(F.col("sq_l2"), k), 6).alias(f"k{k}") for k in range(5)))
    key = lambda r: str(tuple(r))
    assert sorted(map(key, blocks.kernels(q, c, 6, C.similarity).collect())) == sorted(map(key, want.collect()))


def test_rounding_equals_sparks(spark):
    x = [0.0, -0.0, 0.5e-6, -0.5e-6, 1.0000005, 2.0000015, 0.1234565, -7.1234565, 123456.7890125, 0.15, 0.25, 0.35, 1e17, 1e300, -1e-9]
    rows = spark.createDataFrame([(v,) for v in x], "v double").select("v", F.round("v", 6).alias("six"), F.round("v", 1).alias("one")).collect()
    for digits, name in ((6, "six"), (1, "one")):
        assert list(map(repr, blocks.rounded(np.array([r.v for r in rows]), digits).tolist())) == [repr(r[name]) for r in rows]


@pytest.mark.parametrize("others", [False, True])
def test_nearest_with_ties_and_slices(spark, others, monkeypatch):
    monkeypatch.setattr(blocks, "TILE", (4, 64))
    x = np.random.default_rng(2).integers(0, 3, size=(900, 4)).astype(np.float32)  # many equal distances
    c = spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(x)], CODES).repartition(5)
    got = search.top_k(c.where("gid % 50 = 0"), c, 7, others).collect()
    d = lambda i, j: float(((x[i].astype(float) - x[j]) ** 2).sum())
    want = [(i, r, j) for i in range(0, 900, 50) for r, (_, j) in enumerate(sorted((d(i, j), j) for j in range(900) if not (others and i == j))[:7], 1)]
    assert sorted((r.qid, r.rank, r.gid) for r in got) == want
    q = list(blocks.slices(c.where("gid % 50 = 0"), 4, rows=5))
    assert len(q) > 1 and sorted(i for s in q for i in s.ids) == list(range(0, 900, 50))


def test_nulls_come_last(spark):
    c = spark.createDataFrame([(0, 0, [0.0]), (1, 0, None), (2, 0, [2.0])], CODES)
    assert [(r.rank, r.gid) for r in search.top_k(c.where("gid = 0"), c, 3).orderBy("rank").collect()] == [(1, 0), (2, 2), (3, 1)]


def test_first_by_code_and_ranks(spark):
    c = table(spark, 600)
    q = c.where("gid % 50 = 0")
    rows = [(r.gid, r.code, np.array(r.emb, float)) for r in c.collect()]
    near = search.first_by_code(q, c, 10, 5, 12)
    want = {(i, rank, j) for i, a, _ in rows if i % 50 == 0 for rank, (_, j) in enumerate(sorted((bin(a ^ b).count("1"), j) for j, b, _ in rows if bin(a ^ b).count("1") <= 5)[:10], 1)}
    assert {(r.qid, r.rank, r.gid) for r in near.collect()} == want
    near = near.select("qid", "gid", "rank", F.round("sq_l2", 1).alias("d"))
    slow = search.competition_ranks(q, c, near, lambda a, b: F.round(C.sq_l2(a, b), 1))
    assert sorted(search.competition_ranks(q, c, near).collect()) == sorted(slow.collect())


def test_a_pair_costs_less_than_a_microsecond():
    """Columns took some four microseconds a pair and core."""
    rng = np.random.default_rng(3)
    q = blocks.Stated(np.arange(64), np.zeros(64, np.int64), rng.normal(size=(64, 64)), [])
    x = rng.normal(size=(64, 8192))
    start = time.process_time()
    n = sum(sq.size for _, _, sq, _ in blocks.tiles(q, np.arange(8192), np.zeros(8192, np.int64), x, 12))
    assert n == 64 * 8192 and (time.process_time() - start) / n < 1e-6
