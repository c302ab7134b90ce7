"""Operators whose state stays small however large a table, or a single graph, is."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from kindred.operators import graphs, large_graphs, search

from .test_ged import random_graph


@pytest.mark.parametrize("bins", [2, 64])
def test_medians_equal_sorting(spark, monkeypatch, bins):
    monkeypatch.setattr(search, "BINS", bins)
    r = random.Random(4)
    data = {
        0: [r.gauss(0, 1) for _ in range(101)], 1: [r.choice([1.0, 2.0]) for _ in range(60)], 2: [5.0] * 40, 3: [-1e308, 1e308, 3.0, 4.0], 4: [7.0],
        5: [r.expovariate(1) ** 9 for _ in range(200)], 6: [0.0, -0.0, 1e-300, 2e-300],
    }
    rows = [(p, x) for p, xs in data.items() for x in xs] + [(0, None), (1, float("nan")), (2, float("inf")), (9, None)]
    r.shuffle(rows)
    got = {x.pos: x.threshold for x in search.medians(spark.createDataFrame(rows, "pos int, x double")).collect()}
    assert got == {p: statistics.median(xs) for p, xs in data.items()}
    assert search.medians(spark.createDataFrame([], "pos int, x double")).count() == 0


def plain_twins(n, nodes, edges):
    around = {i: sorted({(d if s == i else s, x) for s, d, x in edges if i in (s, d) and s != d}) for i in range(n)}
    return [min(j for j in range(n) if nodes[j] == nodes[i] and around[j] == around[i]) for i in range(n)]


def test_twins_on_tables(spark):
    r = random.Random(6)
    made = [random_graph(r, 6) for _ in range(40)] + [([1] * 30, [(0, i, 1 + (i % 2)) for i in range(1, 30)]), ([3], [(0, 0, 1)]), ([], [])]
    rows = [(k, len(n), len(e), n, [tuple(x) for x in e]) for k, (n, e) in enumerate(made)]
    g = spark.createDataFrame(rows, graphs.GRAPH)
    got = {(x.gid, x.vid): x.twin for x in graphs.twins(graphs.vertices(g), graphs.edges(g)).collect()}
    assert got == {(k, i): t for k, v, _, n, e in rows for i, t in enumerate(plain_twins(v, n, e))}
    sizes = {x.gid: x.n_classes for x in graphs.twin_classes(g).collect()}
    assert sizes == {k: len(set(plain_twins(v, n, e))) for k, v, _, n, e in rows if v}


def test_equal_sums_of_other_neighbours_are_told_apart(spark, monkeypatch):
    """With one hash for all, only the comparison of edges decides."""
    monkeypatch.setattr(F, "xxhash64", lambda *c: F.lit(1).cast("long"))
    vertices = spark.createDataFrame([(1, i, 0) for i in range(6)], "gid long, vid int, label int")
    edges = spark.createDataFrame([(1, 0, 4, 1), (1, 1, 5, 1), (1, 2, 4, 1), (1, 3, 5, 1)], "gid long, src int, dst int, label int")
    got = {x.vid: x.twin for x in graphs.twins(vertices, edges).collect()}
    assert got == {0: 0, 1: 1, 2: 0, 3: 1, 4: 4, 5: 5}


def score_tables(spark):
    r = random.Random(8)
    made = [random_graph(r, 6) for _ in range(25)] + [([1] * 40, [(0, i, 1) for i in range(1, 40)]), ([3], [(0, 0, 1)]), ([], []), ([1] * 12, [(i, i + 1, 1) for i in range(11)])]
    g = spark.createDataFrame([(k, len(n), len(e), n, [tuple(x) for x in e]) for k, (n, e) in enumerate(made)], graphs.GRAPH)
    return g, graphs.vertices(g), graphs.edges(g)


def near(a, b):
    assert a.keys() == b.keys()
    for k, x in a.items():
        assert all((p is None) == (q is None) and (p is None or abs(p - q) < 1e-9) for p, q in zip(x, b[k])), (k, x, b[k])


def test_scores_on_tables_equal_those_of_rows(spark):
    g, v, e = score_tables(spark)
    rows = {(x.gid, x.vid): x for x in graphs.centralities(g, 3).collect()}
    near({(x.gid, x.vid): (x.rank,) for x in large_graphs.pagerank(v, e, rounds=3).collect()}, {(x.gid, x.vid): (x.rank,) for x in graphs.pagerank(g, rounds=3).collect()})
    near({(x.gid, x.vid): (x.closeness, x.barycenter) for x in large_graphs.closeness(v, e).collect()}, {k: (x.closeness, x.barycenter) for k, x in rows.items()})
    near({(x.gid, x.vid): (x.hub, x.authority) for x in large_graphs.hits(v, e, 3).collect()}, {k: (x.hub, x.authority) for k, x in rows.items()})
    assert large_graphs.waves(v.where("gid < 0"), e).count() == 0


def test_twins_compare_edges_of_vertices_that_meet(spark, monkeypatch):
    """The ends of a path of three meet, and so do two leaves of a star; edges of other vertices are dealt once and not read into a comparison."""
    stored, real = {}, graphs.written
    monkeypatch.setattr(graphs, "written", lambda df, name: stored.setdefault(name, real(df, name)))
    path = [(i, i + 1, 1) for i in range(50)]
    made = [([0] * 51, path), ([0] * 3, path[:2]), ([0, 1, 1, 2], [(0, 1, 1), (0, 2, 1), (0, 3, 1), (1, 0, 1)])]  # an edge that repeats
    g = spark.createDataFrame([(k, len(n), len(e), n, e) for k, (n, e) in enumerate(made)], graphs.GRAPH)
    got = {(x.gid, x.vid): x.twin for x in graphs.twins(graphs.vertices(g), graphs.edges(g)).collect()}
    assert got == {(k, i): t for k, (n, e) in enumerate(made) for i, t in enumerate(plain_twins(len(n), n, e))}
    assert sorted((x.gid, x.vid, x.nb) for x in stored["near"].collect()) == [(1, 0, 1), (1, 2, 1), (2, 1, 0), (2, 2, 0)]
