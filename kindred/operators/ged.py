"""Graph edit distance with unit costs, exact within a bound.

The distance is the least number of vertex and edge insertions, deletions and relabellings.
An optimal mapping never needs to delete a vertex of the smaller graph, so the search assigns
its vertices, one by one, to vertices of the larger graph: depth first on a stack of its own,
the most promising branch first. A branch is cut by what labels and degrees say of the rest: labels of
the vertices not yet mapped, labels of the edges among them, their degrees there, and, for every mapped pair,
their edges to them. Twins of the larger graph (vertices that can be exchanged) are tried once.

A search that weighs more than `steps` assignments stops and hands back its open branches, each a
partial mapping with its bound. decided() writes those as rows and goes on in rounds: the least distance found
for a pair so far is shared by all its branches, branches that cannot beat it go, and the rest are
searched in parallel, each for `steps` assignments, so that a hard pair is spread over all tasks. It
ends when no branch is open: every pair is decided, whatever `steps` is.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import chain, zip_longest

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import degree_bound, label_bound
from ..plans.planner import small_enough
from ..sources.scratch import written
from . import prefix_join
from .graphs import GRAPH, degree_array

STEPS = 100_000  # assignments that a task weighs at once for a pair or a branch; it decides nothing


class Undecided(Exception):
    pass


def _adjacency(n: int, edges: list) -> list[dict[int, int]]:
    adj: list[dict[int, int]] = [{} for _ in range(n)]
    for s, d, label in edges:
        if s != d:
            adj[s][d] = adj[d][s] = label
    return adj


def _order(adj: list[dict[int, int]], nodes: list, other: Counter) -> list[int]:
    """Vertices so that each has many edges to those before it; labels that the other graph has seldom, and high degrees, first."""
    n, rest, out, links = len(nodes), set(range(len(nodes))), [], [0] * len(nodes)
    while len(out) < n:
        i = max(rest, key=lambda i: (links[i], -other[nodes[i]], len(adj[i]), -i))
        rest.remove(i)
        out.append(i)
        for j in adj[i]:
            links[j] += 1
    return out


def _apart(gap: dict) -> int:
    """Least edits between two multisets of labels from their counts' differences: the larger of what either has more."""
    more = less = 0
    for x in gap.values():
        if x > 0:
            more += x
        else:
            less -= x
    return more if more > less else less


def _gaps(c1: Counter, c2: Counter) -> dict:
    return {x: c1[x] - c2[x] for x in c1.keys() | c2.keys()}


def _degree_gap(d1: list[int], d2: list[int]) -> int:
    """Least edges inserted and deleted between two graphs of such degrees: both in falling order, missing vertices have none."""
    d1, d2 = sorted(d1, reverse=True), sorted(d2, reverse=True)
    more = less = 0
    for x, y in zip_longest(d1, d2, fillvalue=0):
        if x > y:
            more += x - y
        else:
            less += y - x
    return (more + 1) // 2 + (less + 1) // 2


class Search:
    """The distance of two graphs, in as many parts as one likes. edges: (src, dst, label) with 0-based ends."""

    def __init__(self, nodes1: list, edges1: list, nodes2: list, edges2: list):
        if len(nodes1) > len(nodes2):
            nodes1, edges1, nodes2, edges2 = nodes2, edges2, nodes1, edges1
        self.nodes1, self.nodes2, self.n1, self.n2 = nodes1, nodes2, len(nodes1), len(nodes2)
        self.a1, self.a2 = _adjacency(self.n1, edges1), _adjacency(self.n2, edges2)
        self.most = self.n2 + sum(map(len, self.a1)) + sum(map(len, self.a2))  # at least the distance
        self.ready = False

    def prepare(self) -> None:
        """What only a search needs: many pairs are decided by the bounds of start() and in_place()."""
        self.order = _order(self.a1, self.nodes1, Counter(self.nodes2))
        place = {v: k for k, v in enumerate(self.order)}
        self.back = [[(place[x], label) for x, label in self.a1[u].items() if place[x] < k] for k, u in enumerate(self.order)]
        self.ahead = [Counter(label for x, label in self.a1[u].items() if place[x] > k) for k, u in enumerate(self.order)]
        # Degrees among the vertices of graph 1 that are not yet mapped, after each step.
        self.rest1, left = [], [len(self.a1[u]) for u in self.order]
        for k, u in enumerate(self.order):
            for x in self.a1[u]:
                left[place[x]] -= 1
            self.rest1.append(left[k + 1 :])
        # Vertices of graph 2 with one label and the same neighbours can be exchanged.
        self.twin = [(self.nodes2[j], tuple(sorted(self.a2[j].items()))) for j in range(self.n2)]
        self.ready = True

    def in_place(self) -> int:
        """The cost of mapping each vertex to that of its number: small where one graph is an edited copy of the other."""
        cost = self.n2 - self.n1 + sum(x != y for x, y in zip(self.nodes1, self.nodes2))
        ends = 0
        for j, y in enumerate(self.a2):
            x = self.a1[j] if j < self.n1 else {}
            if x != y:
                ends += sum(x.get(i) != y.get(i) for i in x.keys() | y.keys())
        return cost + ends // 2

    def start(self) -> tuple[int, dict, dict]:
        """The bound of the whole, the gaps of edge labels and of vertex labels."""
        labels = _gaps(Counter(self.nodes1), Counter(self.nodes2))
        ends = _gaps(*(Counter(chain.from_iterable(map(dict.values, a))) for a in (self.a1, self.a2)))  # an edge has two
        inner = {label: x // 2 for label, x in ends.items()}
        edges = max(_apart(inner), _degree_gap([len(x) for x in self.a1], [len(x) for x in self.a2]))
        return edges + _apart(labels), inner, labels

    def run(self, best: int, steps: int | None = None, image: Sequence[int] = ()) -> tuple[int, list[tuple[int, list[int]]]]:
        """(best, open): the least distance under best of mappings that begin with image, or best; what `steps` left open as (bound, image).

        Equal arguments walk the same way, so that an image that was handed back is found again."""
        nodes1, nodes2, n1, n2 = self.nodes1, self.nodes2, self.n1, self.n2
        low, inner, labels = self.start()
        if n1 == 0:
            return min(best, low), []
        if not image:
            best = min(best, self.in_place())
            if low >= best:
                return best, []
        if not self.ready:
            self.prepare()
        order = self.order
        at = [-1] * n2  # the step that took a vertex of graph 2
        count = 0

        def options(k: int, cost: int, cross: list[dict], inner: dict, labels: dict, only: int = -1) -> list[tuple]:
            """(bound, vertex of graph 2, cost, changed gaps, gaps of the new pair), the worst first; cross: gaps of mapped pairs' edges to the unmapped."""
            u, out, tried = order[k], [], set()
            base = sum(map(_apart, cross))
            for w in range(n2) if only < 0 else (only,):
                if at[w] >= 0 or self.twin[w] in tried:
                    continue
                tried.add(self.twin[w])
                c = cost + (nodes1[u] != nodes2[w])
                if c + base >= best:  # an edit takes no more from the gaps than it costs
                    continue
                new, met = dict(self.ahead[k]), {}
                for x, label in self.a2[w].items():
                    if at[x] >= 0:
                        met[at[x]] = label
                    else:
                        new[label] = new.get(label, 0) - 1
                changed, part = {}, base
                for p, label in self.back[k]:
                    other = met.pop(p, None)
                    if other == label:
                        continue
                    c += 1
                    gap = dict(cross[p])
                    gap[label] = gap.get(label, 0) - 1
                    if other is not None:
                        gap[other] = gap.get(other, 0) + 1
                    changed[p] = gap
                for p, label in met.items():
                    c += 1
                    gap = dict(cross[p])
                    gap[label] = gap.get(label, 0) + 1
                    changed[p] = gap
                if c >= best:
                    continue
                for p, gap in changed.items():
                    part += _apart(gap) - _apart(cross[p])
                rest = dict(inner)
                for label, x in new.items():
                    rest[label] = rest.get(label, 0) - x
                names = labels
                if nodes1[u] != nodes2[w]:
                    names = dict(labels)
                    names[nodes1[u]] -= 1
                    names[nodes2[w]] += 1
                sure, own = c + part + _apart(new) + _apart(names), _apart(rest)
                if sure + own < best:
                    out.append((sure + own, w, c, changed, new, rest, names, sure))
            out.sort(key=lambda o: (-o[0], -o[2], o[1]))
            return out

        cross: list[dict] = []
        cost = 0
        for k, w in enumerate(image):  # the way to the branch
            step = options(k, cost, cross, inner, labels, w)
            if not step:
                return best, []
            low, _, cost, changed, new, inner, labels, _ = step[0]
            if k + 1 == n1:
                return min(best, low), []
            at[w] = k
            cross = [*(changed.get(p, gap) for p, gap in enumerate(cross)), new]
        if low >= best:
            return best, []
        first = len(image)
        taken: list[int] = []
        stack = [(first, cross, options(first, cost, cross, inner, labels))]
        while stack:
            k, cross, left = stack[-1]
            if len(taken) > k - first:
                at[taken.pop()] = -1
            if not left or left[-1][0] >= best:
                stack.pop()
                continue
            low, w, c, changed, new, rest, names, sure = left.pop()
            if k + 1 == n1:  # nothing of graph 1 is left, so the bound is the cost
                best = low
                continue
            at[w] = k
            taken.append(w)
            if n1 - k > 3 and sure + _degree_gap(self.rest1[k], [sum(at[x] < 0 for x in self.a2[j]) for j in range(n2) if at[j] < 0]) >= best:
                continue
            count += n2 - k
            if steps is not None and count > steps:
                at[taken.pop()] = -1
                left.append((low, w))
                way = [*image, *taken]
                return best, [(o[0], [*way[:j], o[1]]) for j, _, rows in stack for o in reversed(rows) if o[0] < best]
            below = [changed.get(p, gap) for p, gap in enumerate(cross)]
            below.append(new)
            stack.append((k + 1, below, options(k + 1, c, below, rest, names)))
        return best, []


def edit_distance(nodes1: list, edges1: list, nodes2: list, edges2: list, bound: int | None = None, steps: int | None = None) -> int:
    """The distance if it is at most bound (no bound: always), else -1; raises Undecided beyond steps.

    edges: (src, dst, label) with 0-based ends."""
    s = Search(nodes1, edges1, nodes2, edges2)
    best, left = s.run(s.most + 1 if bound is None else bound + 1, steps)
    if left:
        raise Undecided
    return best if bound is None or best <= bound else -1


def _plain(values: pa.Array) -> list:
    """The values of an array of numbers, by numpy where none is null."""
    return values.to_pylist() if values.null_count else values.to_numpy(zero_copy_only=False).tolist()


def _cut(column: pa.Array, items: list) -> list[tuple]:
    """The items of each row of a column of lists; none of a null."""
    at = column.offsets.to_pylist()
    rows = [tuple(items[i:j]) for i, j in zip(at, at[1:])]
    return [x if ok else () for x, ok in zip(rows, column.is_valid().to_pylist())] if column.null_count else rows


def _graphs(b: pa.RecordBatch) -> Iterator[tuple]:
    """(nodes1, edges1, nodes2, edges2) of the rows of a batch, as tuples."""
    col = lambda c: b.column(b.schema.get_field_index(c))
    n1, n2 = (_cut(col(c), _plain(col(c).values)) for c in ("nodes1", "nodes2"))
    e1, e2 = (_cut(col(c), list(zip(*(_plain(col(c).values.field(x)) for x in ("src", "dst", "label"))))) for c in ("edges1", "edges2"))
    yield from zip(n1, e1, n2, e2)


def with_distance(pairs: DataFrame, bound: int | None = None, steps: int | None = STEPS) -> DataFrame:
    """pairs with nodes1, edges1, nodes2, edges2 and a column ged: the distance, -1 beyond bound, null if undecided after `steps`."""
    names = pairs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for b in batches:
            out = []
            for key in _graphs(b):
                if key not in known:
                    if len(known) > 50_000:
                        known.clear()
                    try:
                        known[key] = edit_distance(*map(list, key), bound, steps)
                    except Undecided:
                        known[key] = None
                out.append(known[key])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int32())], names=[*names, "ged"])

    kinds = dict(pairs.dtypes)
    return pairs.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", ged int")


FEW = 20_000  # structures that are compared by size alone
CHUNK = 4096  # ids of equal graphs in a row
ASKED = 256  # ids of equal query graphs in a row
OPEN = pa.schema([("pid", pa.int64()), ("best", pa.int32()), ("low", pa.int32()), ("image", pa.list_(pa.int32()))])


def _searched(branches: DataFrame, steps: int) -> DataFrame:
    """(pid, best, low, image) of branches (pid, best, image, graphs): for each a row with what was found (image null), and its open branches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for pid, best, image, graphs in zip(b["pid"].to_pylist(), b["best"].to_pylist(), b["image"].to_pylist(), _graphs(b)):
                s = Search(*map(list, graphs))
                found, left = s.run(s.most + 1 if best is None else best, steps, image)
                rows += [(pid, found, None, None), *((pid, found, low, way) for low, way in left)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 4, OPEN)], schema=OPEN)

    return branches.select("pid", "best", "image", "nodes1", "edges1", "nodes2", "edges2").mapInArrow(run, "pid long, best int, low int, image array<int>")


def decided(pairs: DataFrame, bound: int | None = None, steps: int = STEPS) -> DataFrame:
    """pairs with nodes1, edges1, nodes2, edges2 and a column ged: the distance, or -1 beyond bound; no pair is left undecided.

    Pairs are searched once for `steps` assignments each; open branches of the others are rows of a stored table, and
    each round searches every branch that can still beat its pair's best for `steps` assignments more. Joins are by sorting: a
    table of a row a pair is small as a file, which would have it sent whole through the driver."""
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number that is given is not made smaller for small rows
    rows = written(pairs.withColumn("pid", F.monotonically_increasing_id()), "pairs")
    graphs = rows.select("pid", "nodes1", "edges1", "nodes2", "edges2")
    least = F.lit(None if bound is None else bound + 1).cast("int")
    state = written(_searched(graphs.withColumns({"best": least, "image": F.array().cast("array<int>")}).repartition(tasks, "pid"), steps), "searched")
    found, rounds = state.where("image is null").select("pid", "best"), 0
    while True:
        best = state.groupBy("pid").agg(F.min("best").alias("least"), F.count("image").alias("open"))
        hard = best.where("open > 0").select("pid", "least")
        left = state.where("image is not null").join(hard.hint("merge"), "pid").where(F.col("low") < F.col("least"))
        if left.isEmpty():
            break
        branches = left.select("pid", F.col("least").alias("best"), "image").join(graphs.hint("merge"), "pid").repartition(tasks, F.hash("pid", "image"))
        state = written(_searched(branches, steps), "searched")
        found = found.union(state.where("image is null").select("pid", "best"))
        rounds += 1
        if rounds % 8 == 0:
            found = written(found.groupBy("pid").agg(F.min("best").alias("best")), "found")
    best = found.groupBy("pid").agg(F.min("best").alias("ged"))
    ged = F.col("ged") if bound is None else F.when(F.col("ged") <= bound, F.col("ged")).otherwise(-1)
    return rows.join(best.hint("merge"), "pid").withColumn("ged", ged).select(*pairs.columns, "ged")


def structures(graphs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(distinct graphs with sid, as a stored table; gid to sid): equal graphs are compared once."""
    s = written(graphs.groupBy("nodes", "edges").agg(F.min("gid").alias("sid")).withColumns({"v": F.size("nodes"), "e": F.size("edges")}), "structures")
    return s, graphs.select("gid", "nodes", "edges").join(s.select("sid", "nodes", "edges"), ["nodes", "edges"]).select("gid", "sid")


def chunks(of: DataFrame, key: str, name: str, most: int | None = None) -> DataFrame:
    """(key, name): the gids of (gid, sid) by sid, about `most` (CHUNK unless given) in an array."""
    parts = of.groupBy("sid").agg(F.ceil(F.count("*") / (most or CHUNK)).alias("parts"))
    dealt = of.join(parts, "sid").groupBy("sid", F.pmod(F.xxhash64("gid"), F.col("parts")).alias("part"))
    return dealt.agg(F.collect_list("gid").alias(name)).select(F.col("sid").alias(key), name)


def expanded(found: DataFrame, queries: DataFrame, graphs: DataFrame) -> DataFrame:
    """(qid, gid, ged) of structure pairs (s1, s2, ged) and what structures (gid, sid) have. What moves and is stored are arrays of ids; pairs
    are made last, in the task that returns them.

    Code generated for both explodes in one stage would hold all pairs of two arrays before it hands on the first. The coalesce
    makes no partitions fewer; it ends the first one's stage, so that a task holds the pairs of one query with one array."""
    spark = found.sparkSession
    tasks = max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = found.join(chunks(queries, "s1", "qids", ASKED), "s1").join(chunks(graphs, "s2", "gids"), "s2")
    rows = rows.repartition(tasks, F.xxhash64("qids", "gids")).select("ged", "gids", F.explode("qids").alias("qid"))
    return rows.coalesce(tasks).select("qid", F.explode("gids").alias("gid"), "ged")


def bounded_pairs(queries: DataFrame, graphs: DataFrame, bound: int | None) -> DataFrame:
    """Distinct structures of the stated queries against all distinct structures that the cheap bounds let pass.

    (s1, s2, nodes1, edges1, nodes2, edges2, lb), and for either k what the bounds see: vk, elk (edge labels), dk (degrees).
    With a bound, pairs come from the prefix-filter join on labels, or, where so few structures are there that comparing
    all of about one size costs less, from a join on the number of vertices; without a bound all are compared.
    Both sides should be stored tables: they are read more than once."""
    c, seen = F.col, [f"{x}{k}" for k in (1, 2) for x in ("v", "el", "d")]

    def side(g: DataFrame, k: int, stars: bool) -> DataFrame:
        own = {"s": c("sid"), "v": c("v"), "nodes": c("nodes"), "edges": c("edges"), "el": F.transform("edges", lambda e: e["label"]), "d": degree_array()}
        return g.select(*(x.alias(f"{n}{k}") for n, x in (own | ({"st": prefix_join.star_tokens()} if stars else {})).items()))

    q, g = side(queries, 1, bound is not None), side(graphs, 2, bound is not None)
    few = bound is None or small_enough(graphs, FEW)
    if few:
        q = F.broadcast(q) if small_enough(q, FEW) else q
    if bound is None:
        pairs = g.join(q)
    elif few:
        pairs = g.join(q.withColumn("v2", F.explode(F.sequence(c("v1") - bound, c("v1") + bound))), "v2")
    else:
        pairs = prefix_join.label_join(queries, graphs, bound).select("s1", "s2").join(q, "s1").join(g, "s2")
    bounds = [
        label_bound(c("v1"), c("nodes1"), c("el1"), c("v2"), c("nodes2"), c("el2")),
        degree_bound(c("v1"), c("nodes1"), c("d1"), c("el1"), c("v2"), c("nodes2"), c("d2"), c("el2")),
    ]
    if bound is not None:
        top = lambda d: F.coalesce(F.array_max(d), F.lit(0))
        bounds.append(prefix_join.star_bound(c("v1"), c("st1"), top("d1"), c("v2"), c("st2"), top("d2")))
    pairs = pairs.withColumn("lb", F.greatest(*bounds))
    return (pairs if bound is None else pairs.where(c("lb") <= bound)).select("s1", "s2", "nodes1", "edges1", "nodes2", "edges2", "lb", *seen)


def ged_pairs(queries: DataFrame, graphs: DataFrame, bound: int | None = None, steps: int = STEPS) -> DataFrame:
    """(qid, gid, ged) of all pairs, or of those within bound; the same id has distance 0 without a search."""
    qs, qmap = structures(queries)
    gs, gmap = structures(graphs)
    d = decided(bounded_pairs(qs, gs, bound).select("s1", "s2", "nodes1", "edges1", "nodes2", "edges2"), bound, steps).where("ged >= 0").select("s1", "s2", "ged")
    return expanded(d, qmap, gmap).select("qid", "gid", F.when(F.col("qid") == F.col("gid"), 0).otherwise(F.col("ged")).alias("ged"))


def verify(candidates: DataFrame, queries: DataFrame, graphs: DataFrame, bound: int, steps: int = STEPS) -> DataFrame:
    """(qid, gid, ged) of the candidates (qid, gid) within bound.

    Pairs of equal structures are searched once; pairs that the cheap bounds exclude not at all."""
    qs, qmap = structures(queries)
    gs, gmap = structures(graphs)
    rows = written(candidates.select("qid", "gid").join(qmap.select(F.col("gid").alias("qid"), F.col("sid").alias("s1")), "qid").join(gmap.select("gid", F.col("sid").alias("s2")), "gid"), "candidates")
    side = lambda g, k: g.select(F.col("sid").alias(f"s{k}"), F.col("nodes").alias(f"nodes{k}"), F.col("edges").alias(f"edges{k}"))
    pairs = rows.select("s1", "s2").distinct().join(side(qs, 1), "s1").join(side(gs, 2), "s2")
    c, lab = F.col, lambda e: F.transform(e, lambda x: x["label"])
    low = label_bound(F.size("nodes1"), c("nodes1"), lab("edges1"), F.size("nodes2"), c("nodes2"), lab("edges2"))
    d = decided(pairs.where(low <= bound), bound, steps).where("ged >= 0").select("s1", "s2", "ged")
    return rows.join(d, ["s1", "s2"]).select("qid", "gid", "ged")


def mapping_cost(nodes1: list, edges1: list, nodes2: list, edges2: list, mapping: list[int]) -> int:
    """Cost of a given vertex mapping (-1: deleted): deletions, relabellings, edge insertions, deletions, relabellings.

    Vertices of graph 2 without an origin are not counted, nor are edges at them."""
    a1, a2 = _adjacency(len(nodes1), edges1), _adjacency(len(nodes2), edges2)
    cost = sum(1 if m < 0 else nodes1[i] != nodes2[m] for i, m in enumerate(mapping))
    for i in range(len(nodes1)):
        for j in range(i):
            x = a1[i].get(j)
            y = a2[mapping[i]].get(mapping[j]) if mapping[i] >= 0 and mapping[j] >= 0 else None
            cost += x != y
    return cost


def lcs_distance(a: str, b: str) -> int:
    """Insertions and deletions only: a substitution costs 2."""
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], diagonal + 1 if x == y else max(row[j], row[j - 1])
    return len(a) + len(b) - 2 * row[-1]


def star_distance(label1, neighbours1: list, label2, neighbours2: list) -> int:
    """Distance of two stars: root labels, and neighbour labels as multisets; an empty first star costs the second's size."""
    if not neighbours1:
        return len(neighbours2) + (label1 != label2) if neighbours2 else int(label1 != label2)
    common = sum((Counter(neighbours1) & Counter(neighbours2)).values())
    n1, n2 = len(neighbours1), len(neighbours2)
    return int(label1 != label2) + abs(n1 - n2) + max(n1, n2) - common


def star_matrix(stars1: list[tuple], stars2: list[tuple]) -> list[list[int]]:
    """Square matrix of star distances of two graphs' (label, neighbour labels); a star without a partner costs its own size."""
    n = max(len(stars1), len(stars2))
    size = lambda star: 1 + len(star[1])
    at = lambda i, j: star_distance(*stars1[i], *stars2[j]) if i < len(stars1) and j < len(stars2) else size(stars1[i]) if i < len(stars1) else size(stars2[j])
    return [[at(i, j) for j in range(n)] for i in range(n)]


def dfs_order(n: int, edges: list) -> list[int]:
    """Depth-first order from the vertex of least (degree, id), to unvisited neighbours by (degree, id), component by component."""
    adj = _adjacency(n, edges)
    rank = lambda i: (len(adj[i]), i)
    seen, out = [False] * n, []
    for root in sorted(range(n), key=rank):
        stack = [root]
        while stack:
            i = stack.pop()
            if seen[i]:
                continue
            seen[i] = True
            out.append(i)
            stack += sorted((j for j in adj[i] if not seen[j]), key=rank, reverse=True)
    return out


def reorder(nodes: list, edges: list) -> tuple[list, list]:
    """The graph with vertices renumbered by dfs_order(), edge ends ascending."""
    order = dfs_order(len(nodes), edges)
    new = {v: k for k, v in enumerate(order)}
    return [nodes[v] for v in order], sorted((min(new[s], new[d]), max(new[s], new[d]), label) for s, d, label in edges)


def reordered(graphs: DataFrame) -> DataFrame:
    """graphs (gid, v, e, nodes, edges) with vertices renumbered depth first, as reorder() does."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = [reorder(n or [], [(e["src"], e["dst"], e["label"]) for e in x or ()]) for n, x in zip(b["nodes"].to_pylist(), b["edges"].to_pylist())]
            edges = [[{"src": s, "dst": d, "label": x} for s, d, x in e] for _, e in new]
            yield pa.record_batch([b["gid"], b["v"], b["e"], pa.array([n for n, _ in new], b.schema.field("nodes").type), pa.array(edges, b.schema.field("edges").type)], ["gid", "v", "e", "nodes", "edges"])

    return graphs.select("gid", "v", "e", "nodes", "edges").mapInArrow(run, GRAPH)


def beam_distance(nodes1: list, edges1: list, nodes2: list, edges2: list, width: int = 15) -> int:
    """An upper bound of the distance: vertices are mapped in order, layer by layer, and of each layer only the `width` least
    (cost so far and label bound of what is left, then cost) go on. Exact where no layer is cut."""
    if len(nodes1) > len(nodes2):
        nodes1, edges1, nodes2, edges2 = nodes2, edges2, nodes1, edges1
    a1, a2, n2 = _adjacency(len(nodes1), edges1), _adjacency(len(nodes2), edges2), len(nodes2)
    order = _order(a1, nodes1, Counter(nodes2))
    layer: list[tuple[int, int, tuple[int, ...]]] = [(0, 0, ())]
    for k, i in enumerate(order):
        left = Counter(nodes1[x] for x in order[k + 1 :])
        grown = []
        for _, cost, image in layer:
            for j in (*(x for x in range(n2) if x not in image), -1):
                c = cost + (1 if j < 0 else nodes1[i] != nodes2[j])
                for p, q in zip(order, image):
                    c += a1[i].get(p) != (a2[j].get(q) if j >= 0 and q >= 0 else None)
                gap = Counter(left)
                gap.subtract(Counter(nodes2[x] for x in range(n2) if x not in image and x != j))
                grown.append((c + _apart(gap), c, (*image, j)))
        layer = heapq.nsmallest(width, grown)

    def whole(cost: int, image: tuple[int, ...]) -> int:
        met = {j: i for i, j in zip(order, image) if j >= 0}
        return cost + sum(j not in met for j in range(n2)) + sum(1 for x in range(n2) for y in a2[x] if x < y and not (x in met and y in met))

    return min(whole(cost, image) for _, cost, image in layer)
