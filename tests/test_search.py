import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.functions import columns as C
from kindred.operators import encode, metrics, search
from kindred.plans import planner
from kindred.plans.lifecycle import range_query, top_k_query
from kindred.plans.planner import ball_size, ball_strategy


@pytest.fixture(scope="module")
def codes(spark):
    rng = np.random.default_rng(3)
    rows = [(i, int(c), [float(x) for x in rng.normal(size=4)]) for i, c in enumerate(rng.integers(0, 256, 120))]
    rows += [(500, 1 << 31, [0.0] * 4), (501, 0, [0.0] * 4)]
    return spark.createDataFrame(rows, "gid long, code long, emb array<double>")


def test_strategies_agree_also_on_bit_31(spark, codes):
    q = spark.createDataFrame([(1000, 5, [0.0] * 4), (1001, 0, [0.0] * 4), (1002, 5, [1.0] * 4)], codes.schema)
    all_ = {(r.gid, r.code) for r in codes.collect()}
    for radius in (0, 1, 2):
        want = {(x.gid, g, (x.code ^ c).bit_count()) for x in q.collect() for g, c in all_ if (x.code ^ c).bit_count() <= radius}
        for s in ("scan", "probe", "bands", None):
            assert {(r.qid, r.gid, r.h) for r in search.range_candidates(q, codes, radius, 32, strategy=s).collect()} == want
        assert radius == 0 or (1001, 500, 1) in want


def test_planner(codes):
    assert ball_size(2, 12) == 1 + 12 + math.comb(12, 2)
    assert ball_strategy(codes, 1, 32) == "probe" and ball_strategy(codes, 3, 32) == "index"


def test_offsets_and_index(codes):
    rows = search.index_offsets(codes).orderBy("code").collect()
    at = 0
    for r in rows:
        assert r.pos == at
        at += r.n
    assert at == codes.count() and search.build_index(codes).agg(F.sum("n")).first()[0] == at


def test_top_k_with_fewer_candidates_and_ties(spark):
    d = spark.createDataFrame([(1, 0, [1.0]), (2, 0, [1.0]), (3, 1, [5.0])], "gid long, code long, emb array<double>")
    q = spark.createDataFrame([(9, 0, [0.0])], d.schema)
    assert [(r.rank, r.gid) for r in search.top_k(q, d, 10).orderBy("rank").collect()] == [(1, 1), (2, 2), (3, 3)]
    assert [r.gid for r in top_k_query(d, q, 2, 8).orderBy("rank").collect()] == [1, 2]


def test_metrics_of_empty_sides(spark):
    q = spark.createDataFrame([(1,), (2,), (3,), (4,)], "qid long")
    truth = spark.createDataFrame([(1, 10), (1, 11), (2, 10)], "qid long, gid long")
    res = spark.createDataFrame([(1, 10), (3, 10)], "qid long, gid long")
    got = {r.qid: (r.p, r.r, round(r.f1, 6)) for r in metrics.per_query(q, truth, res).collect()}
    assert got == {1: (1.0, 0.5, 0.666667), 2: (0.0, 0.0, 0.0), 3: (0.0, 0.0, 0.0), 4: (1.0, 1.0, 1.0)}
    assert metrics.macro(metrics.per_query(q, truth, res), True).first().n_queries == 2


def test_rank_metrics(spark):
    codes = spark.createDataFrame([(g, 0, [d]) for g, d in ((10, 1.0), (11, 1.0), (12, 2.0), (13, 3.0))], "gid long, code long, emb array<double>")
    q = spark.createDataFrame([(1, 0, [0.0])], codes.schema)
    res = spark.createDataFrame([(1, 11, 1, 1.0), (1, 13, 2, 9.0), (1, 10, 3, 1.0)], "qid long, gid long, rank int, d double")
    ranked = search.competition_ranks(q, codes, res, C.sq_l2)
    assert sorted((r.gid, r.rk) for r in ranked.collect()) == [(10, 1), (11, 1), (13, 4)]
    adj = metrics.tie_adjusted(ranked)
    assert sorted((r.pos, r.arank) for r in adj.collect()) == [(1, 1), (2, 4), (3, 2)]
    assert metrics.spearman(adj).first().rho == 0.5 and abs(metrics.kendall(adj).first().tau - 1 / 3) < 1e-9
    assert metrics.precision_at_k(res, ranked, 1).first().p_at_k == 1.0


def test_multi_probe_falls_back_to_all_embeddings(spark):
    d = spark.createDataFrame([(g, c, [float(g)]) for g, c in ((1, 0), (2, 0), (3, 7), (4, 0xFFFF))], "gid long, code long, emb array<double>")
    q = spark.createDataFrame([(9, 0, [2.4]), (8, 0xFF0, [4.0])], d.schema)
    got = {}
    for r in search.multi_probe(q, d, 1, 16, limit=2, factor=1, fall_back=True).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.gid)
    assert got == {9: [2], 8: [4]}  # the second has no hit at all
    assert {r.qid for r in search.multi_probe(q, d, 1, 16, limit=2, factor=1).collect()} == {9}


def test_multi_probe_probes_near_rings_first(spark, codes, monkeypatch):
    """With many codes the near rings are probed and only queries that they leave short are compared with all codes."""
    q = spark.createDataFrame([(1000, 5, [0.0] * 4), (1001, 255, [0.5] * 4), (1002, 1 << 20, [0.1] * 4)], codes.schema)
    run = lambda: sorted(tuple(r) for r in search.multi_probe(q, codes, 3, 32, 11, 5).collect())
    want = run()
    monkeypatch.setattr(planner, "PROBES", 40)
    assert run() == want and len(want) >= 6


def test_attention_pools_by_weight_times_mean():
    x, w = np.array([[1.0, 0.0], [0.0, 2.0]]), np.array([[1.0, 2.0], [0.0, -1.0]])
    h = np.array([0.5 + 2.0, 0.0])  # relu(w . mean)
    want = (1 / (1 + np.exp(-(x @ h)))) @ x
    assert np.allclose(encode.attention_pool(x, w), want)


def test_column_functions(spark):
    row = spark.range(1).select(
        C.set_bits(F.lit(5).cast("long")).alias("bits"), C.weighted_hamming(F.lit(3).cast("long"), F.lit(0).cast("long"), [1.0, 2.5]).alias("w"),
        C.angular_difference(F.lit(0.1), F.lit(6.2)).alias("a"), C.parse_csv_doubles(F.lit("[1.0,2.5]")).alias("p"), C.dense_relabel(F.array(*map(F.lit, "bab")), F.array(F.lit("c"))).alias("d"),
        C.isolated(F.lit(3), F.array(F.lit(1))).alias("i"), C.degree_edit_distance(F.array(F.lit(3), F.lit(1)), F.array(F.lit(1))).alias("e"), C.out_degree_distance(F.array(F.lit(3), F.lit(1)), F.array(F.lit(1))).alias("o"),
        C.multiset_common(F.array(F.lit(1), F.lit(1), F.lit(2)), F.array(F.lit(1), F.lit(2), F.lit(2))).alias("m"), C.pack_code(C.binarize(F.array(F.lit(1.0), F.lit(-1.0), F.lit(2.0)))).alias("c"),
    ).first()
    assert row.bits == [0, 2] and row.w == 3.5 and abs(row.a - (2 * math.pi - 6.1)) < 1e-9 and row.p == [1.0, 2.5]
    assert row.d == [0, 1, 0] and row.i == [0, 2] and row.e == 2 and row.o == 3 and row.m == 2 and row.c == 5


def test_encoder_depends_on_structure_alone(spark):
    w = encode.load_weights(encode.save_weights(encode.make_weights(4)))
    a = encode.encode_graph([0, 1, 2], [(0, 1), (1, 2)], w)
    b = encode.encode_graph([2, 1, 0], [(0, 1), (1, 2)], w)
    assert np.allclose(a[0], b[0]) and a[0].shape == (256,) and a[1].shape == (32,) and np.abs(a[1]).max() <= 0.5
    assert set(encode.pair_loss(np.eye(3), np.full((3, 2), 0.5), np.ones((3, 3)), 5)) == {"emb", "code", "binary", "total"}


def test_range_query_is_a_subset_of_the_full_scan(spark):
    from kindred.operators.ged import ged_pairs
    from kindred.operators.graphs import GRAPH

    rows = [(i, 3, 2, [i % 2, 1, i % 3], [(0, 1, 1), (1, 2, 1)]) for i in range(20)] + [(20, 0, 0, [], [])]
    g = spark.createDataFrame(rows, GRAPH)
    c = encode.encode(g, encode.make_weights(3))
    q, qc = g.where("gid < 3"), c.where("gid < 3")
    got = {(r.qid, r.gid, r.ged) for r in range_query(g, q, c, qc, 1).collect()}
    full = {(r.qid, r.gid, r.ged) for r in ged_pairs(q, g, 1).collect()}
    assert got <= full and {x for x in full if x[2] == 0} <= got
    with pytest.raises(ValueError):
        range_query(g, q, c, qc, 10)


def test_blocks_of_graphs_equal_graphs_one_by_one(spark):
    import random

    import pyarrow as pa
    from kindred.operators.graphs import GRAPH

    r, graphs = random.Random(4), []
    for i in range(60):
        n = r.choice([0, 1, 2, 7, 40, 70, 80])
        # loops, repeated and reversed edges, labels beyond the width or null
        edges = [(r.randrange(n), r.randrange(n), r.randrange(3)) for _ in range(r.randrange(2 * n))] if n else []
        graphs.append(([r.choice([0, 1, 2, 9, -1, None]) for _ in range(n)], edges + edges[:1]))
    w = encode.make_weights(3)
    rows = [{"nodes": n, "edges": [{"src": s, "dst": d} for s, d, _ in e] if e or i % 2 else None} for i, (n, e) in enumerate(graphs)]
    b = pa.RecordBatch.from_pylist(rows, pa.schema([("nodes", pa.list_(pa.int32())), ("edges", pa.list_(pa.struct([("src", pa.int32()), ("dst", pa.int32())])))]))
    for vertices in (1, 50, 90, 10_000):
        seen = []
        for first in (0, 23):
            for at, block in encode.blocks(b.slice(first, 23 if first == 0 else None), vertices):
                emb, act = encode.encode_block(block, w)
                for i, e, a in zip(at, emb, act):
                    nodes, edges = graphs[first + i]
                    want = encode.encode_graph([-1 if x is None else x for x in nodes], edges, w)
                    assert np.allclose(e, want[0]) and np.allclose(a, want[1])
                    seen.append(i)
        assert len(seen) == sum(1 for n, _ in graphs if n)
    g = spark.createDataFrame([(i, len(n), len(e), n, e) for i, (n, e) in enumerate(graphs)], GRAPH)
    got = {x.gid: x for x in encode.encode(g, w).collect()}
    for i, (nodes, edges) in enumerate(graphs):
        if not nodes:
            assert got[i].code is None and got[i].emb is None
            continue
        e, a = encode.encode_graph([-1 if x is None else x for x in nodes], edges, w)
        assert np.allclose(got[i].emb, e) and all((got[i].code >> k & 1) == (a[k] > 0) for k in range(32) if abs(a[k]) > 1e-9)
    with pytest.raises(Exception, match="does not have"):
        encode.encode(spark.createDataFrame([(1, 1, 1, [0], [(0, 1, 1)])], GRAPH), w).collect()
    assert encode.encode(g.limit(0), w).collect() == []
