"""Random edits of graphs with a known number of operations, and random graphs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graphs import GRAPH


def relabel(rng, nodes, edges, labels: int):
    """One vertex gets another label; with a single label nothing changes."""
    if nodes and labels > 1:
        i = int(rng.integers(len(nodes)))
        nodes = [*nodes]
        nodes[i] = int((nodes[i] + rng.integers(1, labels)) % labels)
        return nodes, edges, 1
    return nodes, edges, 0


def insert_edge(rng, nodes, edges, labels: int):
    have = {(s, d) for s, d, _ in edges}
    free = [(i, j) for i in range(len(nodes)) for j in range(i + 1, len(nodes)) if (i, j) not in have]
    return (nodes, [*edges, (*free[int(rng.integers(len(free)))], 1)], 1) if free else (nodes, edges, 0)


def delete_edge(rng, nodes, edges, labels: int):
    if not edges:
        return nodes, edges, 0
    k = int(rng.integers(len(edges)))
    return nodes, [*edges[:k], *edges[k + 1 :]], 1


def insert_vertex(rng, nodes, edges, labels: int):
    return [*nodes, int(rng.integers(max(labels, 1)))], edges, 1


def delete_isolated(rng, nodes, edges, labels: int):
    """An isolated vertex goes, and ends behind it move up."""
    used = {x for s, d, _ in edges for x in (s, d)}
    free = [i for i in range(len(nodes)) if i not in used]
    if not free:
        return nodes, edges, 0
    k = free[int(rng.integers(len(free)))]
    shift = lambda x: x - (x > k)
    return [*nodes[:k], *nodes[k + 1 :]], [(shift(s), shift(d), label) for s, d, label in edges], 1


EDITS = (relabel, insert_edge, delete_edge, insert_vertex, delete_isolated)


def similar(graphs: DataFrame, copies: int, most: int, labels: int, seed: int = 3, origin: bool = False) -> DataFrame:
    """(gid, copy, ops, v, e, nodes, edges): copies with 1..most random edits; the distance is at most ops.

    origin adds the graph that each was copied from as (nodes1, edges1): no join has to bring it back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for gid, nodes, edges in zip(b["gid"].to_pylist(), b["nodes"].to_pylist(), b["edges"].to_pylist()):
                for c in range(copies):
                    rng = np.random.default_rng([seed, gid & (1 << 62) - 1, c])
                    n, e, ops = list(nodes or ()), [(x["src"], x["dst"], x["label"]) for x in edges or ()], 0
                    for _ in range(int(rng.integers(1, most + 1))):
                        n, e, done = EDITS[int(rng.integers(len(EDITS)))](rng, n, e, labels)
                        ops += done
                    rows.append((gid, c, ops, len(n), len(e), n, [{"src": s, "dst": d, "label": x} for s, d, x in sorted(e)]))
            schema = pa.schema([("gid", pa.int64()), ("copy", pa.int32()), ("ops", pa.int32()), ("v", pa.int32()), ("e", pa.int32()), ("nodes", pa.list_(pa.int32())), ("edges", pa.list_(pa.struct([("src", pa.int32()), ("dst", pa.int32()), ("label", pa.int32())])))])
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 7, schema)]
            if origin:
                each = pa.array(np.repeat(np.arange(b.num_rows), copies))
                columns += [b["nodes"].take(each), b["edges"].take(each)]
            yield pa.RecordBatch.from_arrays(columns, names=[*schema.names, *(("nodes1", "edges1") if origin else ())])

    edge = "array<struct<src:int,dst:int,label:int>>"
    more = f", nodes1 array<int>, edges1 {edge}" if origin else ""
    return graphs.select("gid", "nodes", "edges").mapInArrow(run, f"gid long, copy int, ops int, v int, e int, nodes array<int>, edges {edge}{more}")


def preferential_graphs(spark: SparkSession, n: int, seed: int = 1, sizes: tuple[int, int] = (7, 15), mean: float = 10, most_links: int | None = None) -> DataFrame:
    """n graphs by preferential attachment: sizes Poisson(mean) within sizes, 1 <= m < size (m <= most_links), labels by fixed shares."""
    share = [0.8, 0.1, 0.05, 0.025, 0.025]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for gid in b["id"].to_pylist():
                rng = np.random.default_rng([seed, gid])
                size = 0
                while not sizes[0] <= size <= sizes[1]:
                    size = int(rng.poisson(mean))
                m = int(rng.integers(1, min(size, (most_links or size) + 1)))
                edges, ends = [], list(range(m))
                for v in range(m, size):
                    to: set[int] = set()
                    while len(to) < min(m, v):
                        to.add(int(ends[int(rng.integers(len(ends)))]))
                    edges += [(t, v) for t in sorted(to)]
                    ends += [*to, *[v] * len(to)]
                rows.append((gid, size, len(edges), rng.choice(5, size, p=share).tolist(), [{"src": s, "dst": d, "label": 1} for s, d in sorted(edges)]))
            schema = pa.schema([("gid", pa.int64()), ("v", pa.int32()), ("e", pa.int32()), ("nodes", pa.list_(pa.int32())), ("edges", pa.list_(pa.struct([("src", pa.int32()), ("dst", pa.int32()), ("label", pa.int32())])))])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 5, schema)], schema=schema)

    return spark.range(n).mapInArrow(run, GRAPH)


def cumulative_sample(weights: DataFrame, draws: DataFrame) -> DataFrame:
    """draws (draw, u in 0..1) with the first id whose cumulative share of weight exceeds u.

    weights (id, w): a batch's handful of rows, at most 10 000: they meet each draw by a range, in one table sent to all tasks."""
    from pyspark.sql import Window as W

    from ..plans.planner import small_enough

    if not small_enough(weights, 10_000):
        raise ValueError("more weights than a batch has")

    total = weights.agg(F.sum("w").alias("total"))
    cum = weights.join(F.broadcast(total)).select("id", (F.sum("w").over(W.orderBy("id")) / F.col("total")).alias("hi"), "w", "total")
    cum = cum.select("id", "hi", (F.col("hi") - F.col("w") / F.col("total")).alias("lo"))
    return draws.join(F.broadcast(cum), (F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi"))).select("draw", "id")


def trailing_stop(losses: DataFrame, long: int = 500, short: int = 50, gain: float = 0.1, every: int = 50, by: str | None = None) -> DataFrame:
    """(by, epoch, long_mean, short_mean, stop): stop where the long trailing mean exceeds the short one by less than gain.

    by: the column that tells training runs apart; without it the table is one run's short history."""
    from pyspark.sql import Window as W

    own = W.partitionBy(by) if by else W.partitionBy(F.lit(0))
    mean = lambda n: F.avg("loss").over(own.orderBy("epoch").rowsBetween(-(n - 1), 0))
    out = losses.select(*([by] if by else []), "epoch", mean(long).alias("long_mean"), mean(short).alias("short_mean"))
    return out.withColumn("stop", (F.col("epoch") >= long) & (F.col("epoch") % every == 0) & (F.col("long_mean") - F.col("short_mean") < gain))
