import numpy as np
import pytest

from kindred.operators import pivots, search

CODES = "gid long, code long, emb array<float>"


def table(spark, x, first=0):
    return spark.createDataFrame([(first + i, 0, [float(c) for c in v]) for i, v in enumerate(x)], CODES)


def clusters(seed, n, dim=8, centres=12, spread=0.05):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(centres, dim))[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, dim))).astype(np.float32)


def brute(q, x, k, others):
    out = []
    for i, v in q:
        d = [(float(((v.astype(float) - y.astype(float)) ** 2).sum()), j) for j, y in x if not (others and i == j)]
        out += [(i, r, j) for r, (_, j) in enumerate(sorted(d)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("others", [False, True])
@pytest.mark.parametrize("number, k, slices", [(None, 5, 100_000), (1, 3, 100_000), (40, 7, 10), (30, 400, 25)])
def test_neighbours_equal_brute_force(spark, number, k, slices, others):
    x = list(enumerate(np.concatenate([clusters(1, 260), np.tile(clusters(2, 1), (90, 1))])))  # a third are copies of one vector
    q = [p for p in x if p[0] % 23 == 0]
    index = pivots.build(table(spark, [v for _, v in x]).repartition(3), number, slices)
    got = pivots.nearest(table(spark, [v for _, v in x]).where("gid % 23 = 0"), index, k, others).collect()
    assert sorted((r.qid, r.rank, r.gid) for r in got) == brute(q, x, k, others)


def test_clusters_are_ruled_out(spark):
    """On clustered vectors few pairs are compared; results are those of comparing all."""
    x = clusters(3, 1500, centres=30)
    c = table(spark, x)
    q, counted = c.where("gid % 50 = 0"), []
    got = pivots.nearest(q, pivots.build(c), 10, counted=counted)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, search.top_k(q, c, 10, strategy="scan").collect()))
    assert counted[0].first().compared < 0.2 * len(x) * q.count()


def test_odd_vectors_take_no_part(spark):
    good = [(i, 0, [float(i), 1.0]) for i in range(6)]
    odd = [(10, 0, None), (11, 0, [None, 1.0]), (12, 0, [float("nan"), 0.0]), (13, 0, []), (14, 0, [1.0]), (15, 0, [float("inf"), 0.0])]
    c = spark.createDataFrame(good * 2 + odd, CODES)
    index = pivots.build(c.where("gid < 14"))
    got = pivots.nearest(c, index, 2).collect()
    assert {r.qid for r in got} == set(range(6)) and all(r.gid == r.qid and r.sq_l2 == 0 for r in got)
    none = c.where("gid < 0")
    assert pivots.nearest(c, pivots.build(none), 2).count() == 0 and pivots.nearest(none, index, 2).count() == 0
    assert {r.gid for r in search.top_k(c.where("gid = 3").dropDuplicates(["gid"]), c.where("gid < 10"), 3, others=True, index=index).collect()} == {2, 4}
