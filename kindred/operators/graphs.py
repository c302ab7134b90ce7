"""Graphs from tables, and their relational features.

A graph is a row (gid long, v int, e int, nodes array<int>, edges array<struct<src, dst, label>>):
vertex labels by position, undirected edges with src <= dst and 0-based ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import written, written_in_buckets

LITERALS = 1000  # event types that are numbered by a literal list
GRAPH = "gid long, v int, e int, nodes array<int>, edges array<struct<src:int,dst:int,label:int>>"


def from_parts(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Graphs of vertices (gid, vid, label) and edges (gid, src, dst, label); edges repeat once."""
    n = vertices.groupBy("gid").agg(F.sort_array(F.collect_list(F.struct("vid", "label"))).alias("x")).select("gid", F.transform("x", lambda s: s["label"].cast("int")).alias("nodes"))
    e = (
        edges.select("gid", F.least("src", "dst").cast("int").alias("src"), F.greatest("src", "dst").cast("int").alias("dst"), F.col("label").cast("int").alias("label"))
        .distinct()
        .groupBy("gid")
        .agg(F.sort_array(F.collect_list(F.struct("src", "dst", "label"))).alias("edges"))
    )
    none = F.array().cast("array<struct<src:int,dst:int,label:int>>")
    return n.join(e, "gid", "left").select("gid", F.size("nodes").alias("v"), F.size(F.coalesce("edges", none)).alias("e"), "nodes", F.coalesce("edges", none).alias("edges"))


def transition_graphs(events: DataFrame) -> DataFrame:
    """A graph for each user and day: vertices are the event types in order of name, edges join types that follow each other.

    gid = user_id * 100000 + days since 1970-01-01. One shuffle by gid: a window that can spill finds the steps, and
    what is collected is bounded by the number of types."""
    ev = events.where("user_id is not null and ts is not null and event_type is not null").select(
        (F.col("user_id") * 100000 + F.unix_date(F.to_date("ts"))).alias("gid"), "ts", "event_id", F.col("event_type").alias("t")
    )
    types = ev.select("t").distinct()
    names = sorted(r["t"] for r in types.limit(LITERALS + 1).collect())  # bounded, and then part of the plan
    if len(names) <= LITERALS:
        ev = ev.withColumn("label", (F.array_position(F.array(*map(F.lit, names)), F.col("t")) - 1).cast("int"))
    else:
        from .order import numbered

        ev = ev.join(numbered(types, "label", F.asc("t")), "t").withColumn("label", (F.col("label") - 1).cast("int"))
    seq = ev.select("gid", "label", F.lag("label").over(W.partitionBy("gid").orderBy("ts", "event_id")).alias("before"))
    step = F.when(F.col("before") != F.col("label"), F.struct(F.least("label", "before").alias("a"), F.greatest("label", "before").alias("b")))
    g = seq.groupBy("gid").agg(F.sort_array(F.collect_set("label")).alias("nodes"), F.sort_array(F.collect_set(step)).alias("steps"))
    at = lambda x: (F.array_position("nodes", x) - 1).cast("int")
    edges = F.transform("steps", lambda s: F.struct(at(s["a"]).alias("src"), at(s["b"]).alias("dst"), F.lit(1).alias("label")))
    return g.select("gid", F.size("nodes").alias("v"), F.size("steps").alias("e"), "nodes", edges.alias("edges"))


def order_graphs(lineitem: DataFrame) -> DataFrame:
    """A path for each order: vertices are its lines in order of (line number, part, supplier), labelled by return flag and status."""
    labels = F.array(*[F.lit(x) for x in ("AF", "NF", "NO", "RF", "AO", "RO")])
    label = (F.array_position(labels, F.concat("l_returnflag", "l_linestatus")) - 1).cast("int")
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", label.alias("label"))
    g = lineitem.groupBy(F.col("l_orderkey").alias("gid")).agg(F.sort_array(F.collect_list(line)).alias("x"))
    n = F.size("x")
    return g.select("gid", n.alias("v"), (n - 1).alias("e"), F.transform("x", lambda s: s["label"]).alias("nodes"), path_edges(n).alias("edges"))


def path_edges(n: F.Column) -> F.Column:
    """The edges of a path of n vertices."""
    step = lambda i: F.struct((i - 1).alias("src"), i.alias("dst"), F.lit(1).alias("label"))
    return F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), step)).otherwise(F.array().cast("array<struct<src:int,dst:int,label:int>>"))


def vertices(graphs: DataFrame) -> DataFrame:
    return graphs.select("gid", F.posexplode("nodes").alias("vid", "label"))


def edges(graphs: DataFrame) -> DataFrame:
    return graphs.select("gid", F.inline("edges"))


def label_histogram(graphs: DataFrame) -> DataFrame:
    """(gid, label, n) of vertex labels."""
    return vertices(graphs).groupBy("gid", "label").agg(F.count("*").alias("n"))


def degrees(graphs: DataFrame) -> DataFrame:
    """(gid, vid, degree) of every vertex, self-loops not counted; an expression of the row, without a shuffle."""
    return graphs.select("gid", F.posexplode(degree_array()).alias("vid", "degree")).withColumn("degree", F.col("degree").cast("long"))


def edge_label_histogram(graphs: DataFrame) -> DataFrame:
    """(gid, label, n) of edge labels."""
    return edges(graphs).groupBy("gid", "label").agg(F.count("*").alias("n"))


def degree_array() -> F.Column:
    """Degrees by vertex position, as an expression over a graph row."""
    inner = F.filter("edges", lambda e: e["src"] != e["dst"])
    ends = F.concat(F.transform(inner, lambda e: e["src"]), F.transform(inner, lambda e: e["dst"]))
    return F.when(F.col("v") > 0, F.transform(F.sequence(F.lit(0), F.col("v") - 1), lambda i: F.size(F.filter(ends, lambda x: x == i)))).otherwise(F.array().cast("array<int>"))


def isolated_vertices(graphs: DataFrame) -> DataFrame:
    """(gid, isolated array): vertices without an edge."""
    ends = F.concat(F.transform("edges", lambda e: e["src"]), F.transform("edges", lambda e: e["dst"]))
    from ..functions.columns import isolated

    return graphs.select("gid", isolated(F.col("v"), ends).alias("isolated"))


def twin_classes(graphs: DataFrame) -> DataFrame:
    """(gid, n_classes, product): classes of vertices with one label and the same neighbours by the same edge labels, and the product of their sizes."""
    nbs = lambda i: F.concat(
        F.transform(F.filter("edges", lambda e: e["src"] == i), lambda e: F.struct(e["dst"].alias("nb"), e["label"].alias("el"))),
        F.transform(F.filter("edges", lambda e: e["dst"] == i), lambda e: F.struct(e["src"].alias("nb"), e["label"].alias("el"))),
    )
    kind = F.transform(F.sequence(F.lit(0), F.col("v") - 1), lambda i: F.struct(F.get("nodes", i).alias("label"), F.array_sort(F.array_distinct(nbs(i))).alias("nbs")))
    g = graphs.where("v > 0").select("gid", kind.alias("kinds")).select("gid", "kinds", F.array_distinct("kinds").alias("classes"))
    sizes = F.transform("classes", lambda c: F.size(F.filter("kinds", lambda k: k == c)).cast("long"))
    return g.select("gid", F.size("classes").cast("long").alias("n_classes"), F.aggregate(sizes, F.lit(1).cast("long"), lambda a, x: a * x).alias("product"))


def twins(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(gid, vid, twin): for each vertex (gid, vid, label) the smallest vertex with its label and its neighbours by the same edge labels.

    For graphs of any size, as tables: edges (gid, src, dst, label), loops left out. Vertices and edges are dealt once by vertex. Vertices
    meet by label, degree and sums of a hash of their neighbours; where two or more meet, their edges are compared with those of the
    smallest of the group, and a vertex that differs (equal sums of other neighbours) meets the rest of its group again. What moves is
    a row an edge; none holds a vertex's neighbours."""
    buckets = int(vertices.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    end = lambda a, b: edges.where("src <> dst").select("gid", F.col(a).cast("long").alias("vid"), F.col(b).cast("long").alias("nb"), F.col("label").alias("el"), F.lit(None).cast("long").alias("own"))
    own = vertices.select("gid", F.col("vid").cast("long").alias("vid"), F.lit(None).cast("long").alias("nb"), F.lit(None).cast(edges.schema["label"].dataType).alias("el"), F.coalesce(F.col("label").cast("long"), F.lit(-(1 << 40))).alias("own"))
    dealt = written_in_buckets(own.union(end("src", "dst")).union(end("dst", "src")), "around", ["gid", "vid"], buckets)
    h = F.when(F.col("nb").isNotNull(), F.xxhash64("nb", "el"))
    sums = F.max("own").alias("label"), F.count("nb").alias("degree"), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))).alias("h1"), F.sum(F.shiftrightunsigned(h, 32)).alias("h2")
    v = dealt.distinct().groupBy("gid", "vid").agg(*sums).where("label is not null")
    left, out = v.select("gid", "vid", "label", "degree", F.xxhash64("label", "degree", "h1", "h2").alias("kind")), None
    while True:
        w = W.partitionBy("gid", "kind", "label", "degree")
        groups = written(left.withColumns({"twin": F.min("vid").over(w), "n": F.count("*").over(w)}), "groups")
        first = groups.where("vid = twin").select("gid", "vid", "twin")
        out = first if out is None else out.union(first)
        pairs = groups.where("n > 1").drop("n")
        if pairs.isEmpty():
            return out
        near = written(dealt.where("nb is not null").join(pairs.select("gid", "vid", "twin").hint("merge"), ["gid", "vid"]).select("gid", "vid", "twin", "nb", "el").distinct(), "near")
        met = near.where("vid <> twin").join(near.where("vid = twin").drop("vid").hint("merge"), ["gid", "twin", "nb", "el"]).groupBy("gid", "vid").agg(F.count("*").alias("met"))
        seen = written(pairs.where("vid <> twin").join(met.hint("merge"), ["gid", "vid"], "left").withColumn("same", F.coalesce("met", F.lit(0)) == F.col("degree")), "seen")
        out = out.union(seen.where("same").select("gid", "vid", "twin"))
        left = seen.where("not same").select("gid", "vid", "label", "degree", "kind")
        if left.isEmpty():
            return out


def laplacian(graphs: DataFrame) -> DataFrame:
    """(gid, row, col, val) of D^-1/2 (A + I) D^-1/2, the entries that are not zero; expressions of the row, without a shuffle."""
    pairs = F.array_distinct(F.transform(F.filter("edges", lambda e: e["src"] != e["dst"]), lambda e: F.struct(e["src"].alias("row"), e["dst"].alias("col"))))
    g = graphs.where("v > 0").select("gid", "v", degree_array().alias("d"), pairs.alias("p"))
    scale = lambda i: 1 / F.sqrt(F.get("d", i) + 1)
    entry = lambda i, j: F.struct(i.alias("row"), j.alias("col"), (scale(i) * scale(j)).alias("val"))
    own = F.transform(F.sequence(F.lit(0), F.col("v") - 1), lambda i: entry(i, i))
    return g.select("gid", F.inline(F.concat(own, F.transform("p", lambda x: entry(x["row"], x["col"])), F.transform("p", lambda x: entry(x["col"], x["row"])))))


def row_normalized(features: F.Column) -> F.Column:
    """A vertex's features over their sum; all 0 where the sum is 0."""
    x = F.transform(features, lambda y: y.cast("double"))
    total = F.aggregate(x, F.lit(0.0), lambda a, y: a + y)
    return F.transform(x, lambda y: F.when(total != 0, y / total).otherwise(F.lit(0.0)))


def constant_features(width: int) -> F.Column:
    """Features of vertices without labels: width times 2.0."""
    return F.array_repeat(F.lit(2.0), width)


def positions(rows: DataFrame, order: str = "gid", ranges: int = 4096) -> DataFrame:
    """rows with pos: 0-based places by an integer column that has no repeats, without a global sort in one task.

    Places are counted inside equal ranges of the column; only the ranges' totals are summed in one task."""
    low, high = rows.agg(F.min(order), F.max(order)).first()
    if low is None:
        return rows.withColumn("pos", F.lit(0).cast("long"))
    r = F.floor((F.col(order) - low) / ((high - low) // ranges + 1))
    local = rows.withColumn("_range", r).withColumn("_r", F.row_number().over(W.partitionBy("_range").orderBy(order)))
    sizes = rows.groupBy(r.alias("_range")).agg(F.count("*").alias("_n"))
    before = sizes.select("_range", F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    return local.join(F.broadcast(before), "_range").withColumn("pos", F.col("_b") + F.col("_r") - 1).drop("_range", "_r", "_b")


def subsample_every_second(graphs: DataFrame, order: str = "gid", ranges: int = 4096) -> DataFrame:
    """The first, third, fifth ... by an integer column."""
    return positions(graphs, order, ranges).where("pos % 2 = 0").drop("pos")


def lookup(graphs: DataFrame, ids: list[int] | DataFrame) -> DataFrame:
    """The graphs of given ids: a filter that reaches the scan for a list, a semi-join for a table with gid."""
    return graphs.where(F.col("gid").isin(ids)) if isinstance(ids, list) else graphs.join(ids.select("gid"), "gid", "left_semi")


def pagerank(graphs: DataFrame, alpha: float = 0.1, rounds: int = 20) -> DataFrame:
    """(gid, vid, rank) inside each graph: alpha is the chance of a jump; ranks of isolated vertices spread evenly. Equal structures are scored once."""
    import pyarrow as pa

    from .ged import structures

    own, of = structures(graphs)

    def run(batches):
        import numpy as np

        for b in batches:
            out = []
            for sid, v, es in zip(b["sid"].to_pylist(), b["v"].to_pylist(), b["edges"].to_pylist()):
                if not v:
                    continue
                a = np.zeros((v, v))
                for e in es:
                    if e["src"] != e["dst"]:
                        a[e["src"], e["dst"]] = a[e["dst"], e["src"]] = 1
                d = a.sum(axis=1)
                p = np.where(d[:, None] > 0, a / np.maximum(d, 1)[:, None], 1 / v)
                r = np.full(v, 1 / v)
                for _ in range(rounds):
                    r = alpha / v + (1 - alpha) * (r @ p)
                out += [(sid, i, x) for i, x in enumerate(r.tolist())]
            cols = list(zip(*out)) if out else [(), (), ()]
            yield pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.float64())], ["sid", "vid", "rank"])

    return of.join(own.select("sid", "v", "edges").mapInArrow(run, "sid long, vid int, rank double"), "sid").select("gid", "vid", "rank")


def _vertex_scores(v: int, edges: list, rounds: int) -> list[tuple]:
    """(degree, closeness, barycenter, betweenness, eigenvector, hub, authority) of each vertex."""
    from collections import deque

    import numpy as np

    near: list[set[int]] = [set() for _ in range(v)]
    for s, d in edges:
        if s != d:
            near[s].add(d)
            near[d].add(s)
    between, closeness, barycenter, share = [0.0] * v, [None] * v, [None] * v, [0.0] * v
    for s in range(v):
        far, paths, order, todo = {s: 0}, [0] * v, [], deque([s])
        paths[s] = 1
        while todo:
            x = todo.popleft()
            order.append(x)
            for y in near[x]:
                if y not in far:
                    far[y] = far[x] + 1
                    todo.append(y)
                if far[y] == far[x] + 1:
                    paths[y] += paths[x]
        total = sum(far.values())
        if total:
            closeness[s], barycenter[s] = (len(far) - 1) / total, 1 / total
        ends = sum(len(near[x]) for x in far)
        share[s] = len(far) / v * len(near[s]) / ends if ends else 1 / v
        through = [0.0] * v
        for x in reversed(order):
            for y in near[x]:
                if far[y] == far[x] + 1:
                    through[x] += paths[x] / paths[y] * (1 + through[y])
            if x != s:
                between[x] += through[x] / 2  # each pair of ends is met from both
    a = np.array([[float(j in near[i]) for j in range(v)] for i in range(v)])
    unit = lambda x: x / np.sqrt((x**2).sum()) if x.any() else x
    hub = authority = unit(np.ones(v))
    for _ in range(rounds):
        authority = unit(a @ hub)
        hub = unit(a @ authority)
    return list(zip(map(len, near), closeness, barycenter, between, share, hub.tolist(), authority.tolist()))


def centralities(graphs: DataFrame, rounds: int = 20) -> DataFrame:
    """(gid, vid, degree, closeness, barycenter, betweenness, eigenvector, hub, authority); loops do not count.

    closeness is 1 over the mean distance of the reachable vertices and barycenter 1 over the sum, both null where
    none is; betweenness counts each unordered pair of ends once; eigenvector is the share of time that a random walk
    from any vertex spends there; hub and authority come from so many rounds. Equal structures are scored once."""
    import pyarrow as pa

    from .ged import structures

    own, of = structures(graphs)
    names = ["degree", "closeness", "barycenter", "betweenness", "eigenvector", "hub", "authority"]
    kinds = [pa.int32(), *[pa.float64()] * 6]

    def run(batches):
        for b in batches:
            out = [
                (sid, i, *row)
                for sid, v, es in zip(b["sid"].to_pylist(), b["v"].to_pylist(), b["edges"].to_pylist())
                for i, row in enumerate(_vertex_scores(v, [(e["src"], e["dst"]) for e in es or ()], rounds) if v else ())
            ]
            cols = list(zip(*out)) if out else [()] * 9
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, [pa.int64(), pa.int32(), *kinds])], ["sid", "vid", *names])

    found = own.select("sid", "v", "edges").mapInArrow(run, "sid long, vid int, degree int, " + ", ".join(f"{n} double" for n in names[1:]))
    return of.join(found, "sid").select("gid", "vid", *names)
