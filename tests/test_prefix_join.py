import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kindred.operators import ged, graphs, prefix_join

from .test_ged import molecule, random_graph


def graph_rows(seed, n, hot=0):
    r = random.Random(seed)
    made = [random_graph(r, 6) for _ in range(n)] + [molecule(r, r.randint(6, 12)) for _ in range(n // 3)] + [([], []), ([1], []), ([1, 1, 1, 1], [])]
    made += [([7, 7, i % 3], [(0, 1, 1)]) for i in range(hot)]
    return [(k, len(x), len(e), x, [tuple(y) for y in e]) for k, (x, e) in enumerate(made)]


def bound_of(a, b):
    common = lambda x, y: (Counter(x) & Counter(y)).total()
    labels = lambda g: [y[2] for y in g[4]]
    return max(a[1], b[1]) - common(a[3], b[3]) + max(a[2], b[2]) - common(labels(a), labels(b))


@pytest.mark.parametrize("bound", [0, 1, 3, 7])
def test_join_has_every_pair_within_the_label_bound(spark, bound):
    rows = graph_rows(bound, 60, 30)
    g = spark.createDataFrame(rows, graphs.GRAPH).withColumnRenamed("gid", "sid")
    got = prefix_join.label_join(g.where("sid % 3 = 0"), g, bound).collect()
    want = {(a[0], b[0], bound_of(a, b)) for a in rows if a[0] % 3 == 0 for b in rows if bound_of(a, b) <= bound}
    assert len(got) == len(want) and {(r.s1, r.s2, r.lb) for r in got} == want
    t = prefix_join.tokenized(g)
    c = prefix_join.candidates(t.where("sid % 3 = 0"), t, bound).collect()
    assert len(c) == len(set(c)) and {(r.s1, r.s2) for r in c} >= {w[:2] for w in want}
    if bound < 3:
        assert len(c) < 0.5 * len(rows) * len(rows) / 3
    none = g.where("sid < 0")
    assert prefix_join.label_join(none, g, bound).count() == prefix_join.label_join(g, none, bound).count() == 0


def test_star_bounds_never_exceed_the_distance(spark):
    rows = graph_rows(9, 40)
    g = spark.createDataFrame(rows, graphs.GRAPH)
    side = lambda k: g.select(F.col("gid").alias(f"g{k}"), F.col("v").alias(f"v{k}"), prefix_join.star_tokens().alias(f"s{k}"), F.coalesce(F.array_max(graphs.degree_array()), F.lit(0)).alias(f"d{k}"))
    c = F.col
    pairs = side(1).where("g1 % 4 = 0").join(side(2)).select("g1", "g2", prefix_join.star_bound(c("v1"), c("s1"), c("d1"), c("v2"), c("s2"), c("d2")).alias("lb")).collect()
    seen = Counter()
    for r in pairs:
        if r.lb > 0 and max(rows[r.g1][1], rows[r.g2][1]) <= 6:
            assert r.lb <= ged.edit_distance(*rows[r.g1][3:], *rows[r.g2][3:])
            seen[r.lb] += 1
    assert len(seen) > 1
    assert all(r.lb == 0 for r in pairs if r.g1 == r.g2)


@pytest.mark.parametrize("few", [0, 10**6])
def test_bounded_pairs_lose_none(spark, monkeypatch, few):
    monkeypatch.setattr(ged, "FEW", few)
    rows = [r for r in graph_rows(10, 40) if r[1] <= 6]
    g = spark.createDataFrame(rows, graphs.GRAPH)
    want = {(a[0], b[0], d) for a in rows if a[0] % 5 == 0 for b in rows if (d := ged.edit_distance(*a[3:], *b[3:], 3)) >= 0}
    assert {tuple(x) for x in ged.ged_pairs(g.where("gid % 5 = 0"), g, 3).collect()} == want
