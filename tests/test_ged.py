import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.functions import columns as C
from kindred.operators import assignment, augment, ged, graphs
from kindred.operators.assignment import Attribute, Attributed, CostModel


def random_graph(r, most=5):
    n = r.randint(0, most)
    edges = [(i, j, r.randint(1, 2)) for i in range(n) for j in range(i + 1, n) if r.random() < 0.5]
    return [r.randint(0, 2) for _ in range(n)], edges


def brute(g1, g2):
    """Least cost over all mappings with deletions."""
    (n1, e1), (n2, e2) = g1, g2
    a1, a2 = ({(s, d): x for s, d, x in e} for e in (e1, e2))
    get = lambda a, i, j: a.get((min(i, j), max(i, j)))
    best = 10**9
    for image in itertools.product([-1, *range(len(n2))], repeat=len(n1)):
        used = [j for j in image if j >= 0]
        if len(set(used)) < len(used):
            continue
        cost = sum(1 if j < 0 else n1[i] != n2[j] for i, j in enumerate(image)) + len(n2) - len(used)
        met = 0
        for i in range(len(n1)):
            for k in range(i):
                x = get(a1, i, k)
                y = get(a2, image[i], image[k]) if image[i] >= 0 and image[k] >= 0 else None
                met += y is not None
                cost += x != y
        best = min(best, cost + len(a2) - met)
    return best


def test_distance_equals_brute_force_and_bounds_hold(spark):
    r = random.Random(1)
    pairs = [(random_graph(r), random_graph(r, 4)) for _ in range(150)]
    truth = [brute(a, b) for a, b in pairs]
    rows = []
    for k, ((a, b), d) in enumerate(zip(pairs, truth)):
        assert ged.edit_distance(*a, *b) == ged.edit_distance(*b, *a) == d
        assert ged.edit_distance(*a, *b, d) == d and (d == 0 or ged.edit_distance(*a, *b, d - 1) == -1)
        rows.append((k, *(x for n, e in (a, b) for x in (len(n), len(e), n, [tuple(y) for y in e]))))
    kind = "array<struct<src:int,dst:int,label:int>>"
    df = spark.createDataFrame(rows, f"k int, v1 int, e1 int, nodes1 array<int>, edges1 {kind}, v2 int, e2 int, nodes2 array<int>, edges2 {kind}")
    deg = lambda n, e: F.when(F.size(n) > 0, F.transform(F.sequence(F.lit(0), F.size(n) - 1), lambda i: F.size(F.filter(F.flatten(F.transform(e, lambda x: F.array(x["src"], x["dst"]))), lambda x: x == i)))).otherwise(F.array().cast("array<int>"))
    lab = lambda e: F.transform(e, lambda x: x["label"])
    c = F.col
    df = ged.with_distance(df).withColumn("lb", C.label_bound(c("v1"), c("nodes1"), lab("edges1"), c("v2"), c("nodes2"), lab("edges2")))
    df = df.withColumn("db", C.degree_bound(c("v1"), c("nodes1"), deg("nodes1", "edges1"), lab("edges1"), c("v2"), c("nodes2"), deg("nodes2", "edges2"), lab("edges2")))
    for x in df.collect():
        assert x.ged == truth[x.k] and x.lb <= x.ged and x.db <= x.ged


@pytest.mark.parametrize(
    "a,b,want",
    [
        (([0, 1, 2], [(0, 1, 1), (1, 2, 1)]), ([0, 1, 3], [(0, 1, 1), (1, 2, 1)]), 1),
        (([0, 0, 0], [(0, 1, 1), (1, 2, 1), (0, 2, 1)]), ([0, 0, 0], [(0, 1, 1), (1, 2, 1)]), 1),
        (([0], []), ([0, 1], []), 1),
        (([0], []), ([0, 1], [(0, 1, 1)]), 2),
        (([0, 1, 2], [(0, 1, 1), (1, 2, 1)]), ([2, 1, 0], [(0, 1, 1), (1, 2, 1)]), 0),
        (([0, 1], [(0, 1, 1)]), ([0, 1], [(0, 1, 2)]), 1),
        (([], []), ([], []), 0),
    ],
)
def test_known_distances(a, b, want):
    assert ged.edit_distance(*a, *b) == want


def test_large_graphs_with_large_labels_and_undecided():
    n = 128
    path = ([300 + i % 7 for i in range(n)], [(i, i + 1, 1) for i in range(n - 1)])
    other = ([*path[0][:-1], 999], path[1])
    assert ged.edit_distance(*path, *other, 3) == 1
    with pytest.raises(ged.Undecided):
        ged.edit_distance([0] * 12, [(i, (i * 5 + 1) % 12, 1) for i in range(12) if i < (i * 5 + 1) % 12], [0] * 13, [(i, i + 1, 1) for i in range(12)], None, 50)


def test_edits_bound_the_distance(spark):
    r = random.Random(2)
    rows = [(k, len(n), len(e), n, [tuple(x) for x in e]) for k, (n, e) in enumerate(random_graph(r) for _ in range(40))]
    g = spark.createDataFrame(rows, graphs.GRAPH)
    out = augment.similar(g, 2, 3, 3).join(g.select("gid", F.col("nodes").alias("nodes1"), F.col("edges").alias("edges1")), "gid").withColumnsRenamed({"nodes": "nodes2", "edges": "edges2"})
    for x in ged.with_distance(out).collect():
        assert x.ged <= x.ops and x.v == len(x.nodes2) and all(e.dst < x.v for e in x.edges2)
    made = augment.preferential_graphs(spark, 50).collect()
    assert all(7 <= x.v <= 15 and x.e == len(x.edges) == len({(e.src, e.dst) for e in x.edges}) for x in made)


def test_pairs_listed(spark):
    r = random.Random(3)
    rows = [(k, len(n), len(e), n, [tuple(x) for x in e]) for k, (n, e) in enumerate(random_graph(r, 4) for _ in range(40))]
    g = spark.createDataFrame(rows, graphs.GRAPH)
    want = {(a[0], b[0], brute(a[3:], b[3:])) for a in rows if a[0] % 10 == 0 for b in rows}
    assert {(x.qid, x.gid, x.ged) for x in ged.ged_pairs(g.where("gid % 10 = 0"), g, 2).collect()} == {w for w in want if w[2] <= 2}
    assert {(x.qid, x.gid, x.ged) for x in ged.ged_pairs(g.where("gid % 10 = 0"), g).collect()} == want


def test_assignment_equals_permutations():
    rng = np.random.default_rng(1)
    for n in (1, 2, 4, 6):
        for _ in range(15):
            c = rng.integers(0, 9, (n, n)).astype(float)
            best = min(sum(c[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
            columns, total = assignment.solve(c)
            assert total == best and sorted(columns) == list(range(n))
            for m in (assignment.greedy(c), assignment.greedy_sorted(c), assignment.improve_by_swaps(c, assignment.greedy(c))):
                assert sorted(m) == list(range(n)) and c[np.arange(n), m].sum() >= best
    big = rng.random((40, 40))
    assert abs(assignment.solve(big)[1] - assignment.solve_small(big.tolist())[1]) < 1e-9


def unit_model():
    return CostModel(2, 2, 0.5, [Attribute("l", "discrete", 1, 0, 2)], [Attribute("l", "discrete", 1, 0, 2)])


def test_attributed_distances_bound_each_other():
    r = random.Random(4)
    m = unit_model()
    for _ in range(60):
        a, b = random_graph(r, 4), random_graph(r, 4)
        g = [Attributed.of([{"l": str(x)} for x in n], [(s, d, {"l": str(x)}) for s, d, x in e]) for n, e in (a, b)]
        exact = assignment.tree_distance(*g, m)
        assert exact == brute(a, b)
        assert assignment.tree_distance(*g, m, beam=3) >= exact
        for how in ("Hungarian", "Greedy", "GreedySort", "Swap"):
            assert assignment.assignment_distance(*g, m, how) >= exact - 1e-9
        if exact > 0:
            assert assignment.tree_distance(*g, m, bound=exact - 0.5) in (-1.0, 0.0)


def test_attribute_costs_and_properties():
    assert Attribute("x", "squared").cost("1", "4") == 9 and Attribute("x", "absolute", 2).cost("1", "4") == 6
    assert Attribute("x", "sed").cost("abc", "axc") == 2 and Attribute("x", "csvDouble").cost("[0,3]", "[4,0]") == 5
    assert abs(Attribute("x", "fingerprint").cost("0.1", "6.2") - (2 * np.pi - 6.1)) < 1e-9 and Attribute("x", "dummy").cost("1", "2") == 0
    m = CostModel.from_properties("node=3\nedge=3\nalpha=0.8\nnumOfNodeAttr=1\nnodeAttr0=chem\nnodeCostType0=discrete\nnodeCostMu0=0\nnodeCostNu0=2\nmatching=Beam\ns=10\nsimKernel=4\n# note\nundirected=1")
    assert m.beam == 10 and m.kernel == 4 and m.node_attributes[0].nu == 2 and abs(m.substitute_node({"chem": "C"}, {"chem": "N"}) - 1.6) < 1e-12
    assert CostModel(p_node=2, alpha=1, node_attributes=[Attribute("x"), Attribute("y")]).substitute_node({"x": "0", "y": "0"}, {"x": "3", "y": "4"}) == 5


def test_small_functions():
    assert ged.lcs_distance("kitten", "sitting") == 5
    assert ged.star_distance(1, [1, 2], 2, [2, 3]) == 2 and ged.star_distance(1, [], 1, [2, 3]) == 2
    assert ged.mapping_cost([0, 1], [(0, 1, 1)], [0, 2], [(0, 1, 2)], [0, 1]) == 2 and ged.mapping_cost([0, 1], [(0, 1, 1)], [0], [], [0, -1]) == 2
    nodes, edges = ged.reorder([5, 6, 7, 8], [(0, 1, 1), (1, 2, 1), (1, 3, 1)])
    assert sorted(nodes) == [5, 6, 7, 8] and nodes[0] == 5 and len(edges) == 3
    assert ged.edit_distance(nodes, edges, [5, 6, 7, 8], [(0, 1, 1), (1, 2, 1), (1, 3, 1)]) == 0


def test_verification_decides_every_pair(spark):
    schema = "gid long, nodes array<int>, edges array<struct<src: int, dst: int, label: int>>"
    graph = lambda gid, label: (gid, [0] * 6, [(i, i + 1, label) for i in range(5)] + [(0, 3, 2)])
    g = spark.createDataFrame([graph(1, 1), (2, [0] * 6, [(i, j, 1) for i in range(6) for j in range(i + 1, 6) if (i + j) % 2])], schema)
    pairs = spark.createDataFrame([(1, 2)], "qid long, gid long")
    want = [tuple(r) for r in ged.verify(pairs, g, g, 9).collect()]
    assert [tuple(r) for r in ged.verify(pairs, g, g, 9, steps=1).collect()] == want and want[0][2] >= 0


def molecule(r, n):
    """A tree with a few rings, few labels: many mappings are nearly as good as the best."""
    nodes = [r.choice([0, 0, 0, 0, 1, 2]) for _ in range(n)]
    edges = {(r.randint(max(0, i - 3), i - 1), i): r.choice([1, 1, 2]) for i in range(1, n)}
    for _ in range(n // 5):
        edges.setdefault(tuple(sorted(r.sample(range(n), 2))), 1)
    return nodes, [(*e, x) for e, x in edges.items()]


EDGES = "array<struct<src:int,dst:int,label:int>>"
PAIRS = f"k int, nodes1 array<int>, edges1 {EDGES}, nodes2 array<int>, edges2 {EDGES}"


def test_branches_of_a_search_cover_it():
    """Whatever is left open when the steps run out, searched on, gives the same distance."""
    r = random.Random(11)
    for k in range(120):
        a, b = random_graph(r), random_graph(r)
        s, want = ged.Search(*a, *b), brute(a, b)
        best, open_ = s.most + 1, [(0, [])]
        while open_:
            branches, open_ = open_, []
            for _, image in branches:
                best, left = s.run(best, 1 + k % 9, image)
                open_ += left
        assert best == want


def test_hard_pairs_are_split_until_decided(spark):
    r = random.Random(12)
    pairs = [(*molecule(r, n), *molecule(r, n + r.randint(0, 2))) for n in [r.randint(9, 14) for _ in range(16)]]
    rows = [(k, n1, e1, n2, e2) for k, (n1, e1, n2, e2) in enumerate(pairs)] + [(100, None, None, [1], []), (101, [], [], [], None), (102, *pairs[0])]
    df = spark.createDataFrame(rows, PAIRS).repartition(3)
    whole = {k: ged.edit_distance(n1 or [], e1 or [], n2 or [], e2 or [], 9, None) for k, n1, e1, n2, e2 in rows}
    got = {x.k: x.ged for x in ged.decided(df, 9, steps=400).collect()}
    assert got == whole and None not in got.values()
    first = ged._searched(df.where("k < 16").selectExpr("cast(k as long) as pid", "nodes1", "edges1", "nodes2", "edges2", "10 as best", "cast(array() as array<int>) as image"), 400)
    assert first.where("image is not null").count() > 16  # there was something to split
    assert ged.decided(df.where("k < 0"), 9).count() == 0


def test_degree_gaps():
    assert ged._degree_gap([2, 2, 2], [2, 1, 1]) == 1 and ged._degree_gap([3, 1, 1, 1], [2, 2, 1, 1]) == 2 and ged._degree_gap([], [1, 1]) == 1 and ged._degree_gap([], []) == 0


def test_edited_copies_need_no_search(monkeypatch):
    """A copy with few edits is decided by the bound from below and the mapping in place; every such pair was searched before."""
    seen, real = [], ged._order
    monkeypatch.setattr(ged, "_order", lambda *a: seen.append(1) or real(*a))
    r = random.Random(21)
    for k in range(40):
        nodes, edges = molecule(r, 24)
        other = [8, *nodes[1:], 9]
        assert ged.edit_distance(nodes, edges, other, edges, 6) == ged.edit_distance(other, edges, nodes, edges, 3) == 2
        assert ged.edit_distance(nodes, edges, nodes, edges) == 0 and ged.edit_distance(nodes, edges, [*nodes, 0, 0], edges, 1) == -1
    assert not seen
    for k in range(60):  # the mapping in place is an upper bound, whatever the graphs
        a, b = random_graph(r), random_graph(r)
        s = ged.Search(*a, *b)
        assert s.start()[0] <= brute(a, b) <= s.in_place() and ged.edit_distance(*a, *b) == brute(a, b)


def test_graphs_of_a_batch():
    import pyarrow as pa

    edge = pa.list_(pa.struct([(x, pa.int32()) for x in ("src", "dst", "label")]))
    rows = [([1, 2], [{"src": 0, "dst": 1, "label": 7}]), (None, None), ([], []), ([3], [{"src": 0, "dst": 0, "label": None}]), ([4, 5], [])]
    nodes, edges = pa.array([n for n, _ in rows], pa.list_(pa.int32())), pa.array([e for _, e in rows], edge)
    b = pa.record_batch([nodes, edges, nodes.take(pa.array([4, 3, 2, 1, 0])), edges.take(pa.array([4, 3, 2, 1, 0]))], ["nodes1", "edges1", "nodes2", "edges2"])
    want = [((1, 2), ((0, 1, 7),)), ((), ()), ((), ()), ((3,), ((0, 0, None),)), ((4, 5), ())]
    assert list(ged._graphs(b)) == [(*x, *y) for x, y in zip(want, want[::-1])]
    assert list(ged._graphs(b.slice(1, 3))) == [(*x, *y) for x, y in zip(want[1:4], want[3:0:-1])]


def test_copies_bring_their_origin(spark):
    g = augment.preferential_graphs(spark, 30).repartition(3)
    c = augment.similar(g, 2, 3, 5, origin=True)
    old = {(x.gid, x.copy): x for x in augment.similar(g, 2, 3, 5).collect()}
    own = {x.gid: x for x in g.collect()}
    rows = c.collect()
    assert len(rows) == len(old) == 60 and not augment.similar(g.where("gid < 0"), 2, 3, 5, origin=True).count()
    assert all((x.nodes1, x.edges1) == (own[x.gid].nodes, own[x.gid].edges) and (x.ops, x.nodes, x.edges) == (y.ops, y.nodes, y.edges) for x in rows for y in [old[x.gid, x.copy]])
