"""Pair scoring, centralities and the beam bound, by hand and by naive loops."""

import math
import random

import numpy as np
import pytest

from kindred.operators import encode, ged, graphs, scoring
from kindred.operators.graphs import GRAPH


def frame(spark, gs):
    return spark.createDataFrame([(i, len(n), len(e), n, e) for i, (n, e) in enumerate(gs)], GRAPH)


def test_score_equals_its_definition():
    rng = np.random.default_rng(1)
    w = scoring.make_scorer(3, (4,), dim=5, seed=2)
    w["bias"], w["bias0"] = rng.normal(size=3), rng.normal(size=4)
    x, ys = rng.normal(size=5), rng.normal(size=(6, 5))
    for y, got in zip(ys, scoring.score(x, ys, w)):
        h = [max(0.0, float(x @ w["bilinear"][k] @ y + w["linear"][k] @ np.concatenate([x, y]) + w["bias"][k])) for k in range(3)]
        h = np.maximum(np.array(h) @ w["dense0"] + w["bias0"], 0)
        assert got == pytest.approx(float((h @ w["dense1"] + w["bias1"])[0]))


def test_scored_pairs_cover_all_and_depend_on_structure(spark):
    gs = [([0, 1], [(0, 1, 1)]), ([2], []), ([0, 1], [(0, 1, 1)]), ([], []), ([1, 1, 0], [(0, 1, 1), (1, 2, 1)])]
    g = frame(spark, gs)
    w, scorer = encode.make_weights(3), scoring.make_scorer(2, (3,))
    got = {(r.qid, r.gid): r.score for r in scoring.score_pairs(g.where("gid < 2"), g, w, scorer).collect()}
    assert set(got) == {(q, d) for q in (0, 1) for d in (0, 1, 2, 4)} and got[0, 0] == got[0, 2]
    vec = [encode.forward(n, e, w)["dense"][0] for n, e in gs if n]
    assert got[0, 4] == pytest.approx(float(scoring.score(vec[0], vec[3][None, :], scorer)[0]))
    assert scoring.score_pairs(g.limit(0), g, w, scorer).collect() == []


def test_ranges_and_top_k(spark):
    s = spark.createDataFrame([(1, 10, 2, 2, -0.5), (1, 11, 2, 2, 0.2), (1, 12, 2, 4, 9.0), (1, 13, 2, 4, 12.0), (2, 10, 3, 3, 1.0)], "qid long, gid long, size1 int, size2 int, score double")
    assert [(r.qid, r.gid) for r in scoring.range_by_distance(s, 5, 5).orderBy("qid", "gid").collect()] == [(1, 10), (1, 11), (1, 12), (1, 13), (2, 10)]
    assert {r.gid for r in scoring.range_by_distance(s, 0, 5).collect()} == {10}
    top = scoring.top_k_by_distance(s.where("qid = 1"), 3, 5).orderBy("rank").collect()
    assert [(r.rank, r.gid, r.d) for r in top] == [(1, 10, 0.0), (2, 11, 0.2), (3, 12, 5.0)]
    assert [r.score for r in scoring.range_by_similarity(s, 1).orderBy("score").collect()] == [1.0, 9.0, 12.0] and math.exp(-0.75) > 0.2


def test_centralities_by_hand(spark):
    # a path 0-1-2 with a loop, and an isolated vertex; a triangle; a single vertex; an empty graph
    g = frame(spark, [([0] * 4, [(0, 1, 1), (1, 2, 1), (2, 2, 1)]), ([0] * 3, [(0, 1, 1), (0, 2, 1), (1, 2, 1)]), ([0], []), ([], [])])
    got = {(r.gid, r.vid): tuple(r)[2:] for r in graphs.centralities(g).collect()}
    assert len(got) == 8
    assert got[0, 0][:5] == (1, 2 / 3, 1 / 3, 0.0, 3 / 16) and got[0, 1][:5] == (2, 1.0, 1 / 2, 1.0, 3 / 8)
    assert got[0, 3] == (0, None, None, 0.0, 1 / 4, 0.0, 0.0)
    assert got[0, 1][5] == pytest.approx(2 ** -0.5, abs=0.3) and got[0, 0][5] == pytest.approx(got[0, 2][5])
    assert got[1, 2][:5] == (2, 1.0, 1 / 2, 0.0, pytest.approx(1 / 3)) and got[1, 0][5:] == (pytest.approx(3**-0.5), pytest.approx(3**-0.5))
    assert got[2, 0] == (0, None, None, 0.0, 1.0, 0.0, 0.0)


def test_beam_distance_is_a_bound_and_exact_when_wide():
    r = random.Random(5)

    def one(n):
        return [r.randrange(2) for _ in range(n)], [(i, j, r.randrange(2)) for i in range(n) for j in range(i + 1, n) if r.random() < 0.5]

    narrow = 0
    for _ in range(60):
        a, b = one(r.randrange(6)), one(r.randrange(6))
        exact = ged.edit_distance(*a, *b)
        assert ged.beam_distance(*a, *b, width=100_000) == exact
        d = ged.beam_distance(*a, *b, width=2)
        assert d >= exact
        narrow += d > exact
    assert narrow  # cutting costs something


def test_star_matrix_pads_with_sizes():
    a, b = [(1, [2, 2]), (2, [1])], [(1, [2])]
    assert ged.star_matrix(a, b) == [[ged.star_distance(1, [2, 2], 1, [2]), 3], [ged.star_distance(2, [1], 1, [2]), 2]]
    assert ged.star_matrix(b, a) == [[ged.star_distance(1, [2], 1, [2, 2]), ged.star_distance(1, [2], 2, [1])], [3, 2]] and ged.star_matrix([], []) == []


def test_positions_and_lookups(spark):
    g = spark.createDataFrame([(i * 7 % 101,) for i in range(50)], "gid long")
    got = {r.gid: r.pos for r in graphs.positions(g, ranges=4).collect()}
    assert got == {x: k for k, x in enumerate(sorted(got))} and len(got) == 50
    assert graphs.positions(g.limit(0)).collect() == []
    assert {r.gid for r in graphs.lookup(g, [0, 7, 2]).collect()} == {0, 7} | ({2} & set(got))
    assert graphs.lookup(g, g.where("gid = 7").union(g.where("gid = 7"))).count() == 1


def test_kernel_and_latencies(spark):
    from kindred.operators.assignment import Attribute, CostModel, with_attributed_distance
    from kindred.plans.lifecycle import stage_latencies

    node, edge = "array<map<string,string>>", "array<struct<src: int, dst: int, attrs: map<string,string>>>"
    p = spark.createDataFrame([([{"l": "1"}], [], [{"l": "2"}, {"l": "1"}], [])], f"nodes1 {node}, edges1 {edge}, nodes2 {node}, edges2 {edge}")
    model = CostModel(2, 2, 0.5, [Attribute("l", "discrete", 1, 0, 2)], kernel=4)
    row = with_attributed_distance(p, model, kernel=True).first()
    assert row.d == 1 and row.s == pytest.approx(math.exp(-1))
    g = frame(spark, [([i % 2, 1], [(0, 1, 1)]) for i in range(6)])
    out = stage_latencies(g, g.where("gid = 0"), lambda x: encode.encode(x, encode.make_weights(2)), [0, 1]).collect()
    assert [r.ub for r in out] == [0, 1] and all(r.total > 0 and r.total == pytest.approx(r.encode + r.search + r.verify) for r in out)
    assert all(r.encoded == 7 and r.candidates >= r.results >= 3 for r in out)  # three equal graphs are always found
    assert out[0].results == 3 and out[1].results <= 6
    none = stage_latencies(g.limit(0), g.limit(0), lambda x: encode.encode(x, encode.make_weights(2)), [1]).first()
    assert (none.encoded, none.candidates, none.results) == (0, 0, 0)
