"""Exact nearest neighbours by pivots: vectors lie in cells around pivots, and a query leaves out cells that the
triangle inequality rules out.

Pivots are a bounded sample. Each vector belongs to its nearest pivot's cell and keeps its distance from it; of a
cell the number of vectors and the least and largest distance are known. For a query q and a cell around p no
vector is nearer than |q - p| less the largest distance, or the least distance less |q - p|.
1. The cells nearest to a query that hold k vectors together give it k distances, the k-th of which bounds the result.
2. Only cells that this bound does not rule out are compared then, in numpy: a task meets each of its cells with the queries
   that may need it, and the nearest it has seen bound the next cells. A task hands on k vectors of a query at most.

Cells are a table dealt by cell; the queries go to the tasks in slices (blocks.slices). A cell with very many vectors (copies of one
vector, for instance) is cut into slices of SLICE. The driver holds the pivots and one row a cell. Distances
that decide are those of columns.sq_l2; those to pivots only exclude, with room for rounding.

Vectors must have one number of entries, that of the first pivot; others, and those that are null or hold null or
non-finite entries, take no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import sq_l2
from ..plans.planner import small_enough
from ..sources.scratch import written, written_in_buckets
from . import blocks

MOST = 2048  # pivots at most: the bound of what the driver and each task hold
SLICE = 100_000  # vectors of a cell in one bucket
ROOM = 1e-9


@dataclass
class Pivots:
    rows: DataFrame  # key (cell and slice), gid, emb, r (distance from the cell's pivot)
    pivots: np.ndarray
    n: np.ndarray  # by cell: vectors, least and largest distance
    low: np.ndarray
    high: np.ndarray
    slice_rows: int


def _finite(c: str) -> F.Column:
    return F.col(c).isNotNull() & (F.size(c) > 0) & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def _distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """(rows of x, rows of p), in blocks that keep differences small."""
    out = np.empty((len(x), len(p)))
    for i in range(0, len(x), 64):
        out[i : i + 64] = np.sqrt(((x[i : i + 64, None, :] - p[None]) ** 2).sum(axis=2))
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), float).reshape(len(column), -1)


def build(codes: DataFrame, pivots: int | None = None, slice_rows: int = SLICE) -> Pivots:
    """Cells of codes (gid, emb); about the square root of their number of pivots, unless given, and at most MOST."""
    spark = codes.sparkSession
    usable = codes.select("gid", F.col("emb").cast("array<double>").alias("emb")).where(_finite("emb"))
    count = usable.count()
    k = min(MOST, pivots or max(1, math.isqrt(count)))
    sample = [r.emb for r in usable.orderBy(F.xxhash64("gid", "emb"), "gid").limit(k).collect()]
    size = len(sample[0]) if sample else 0
    p = np.unique(np.array([x for x in sample if len(x) == size], float).reshape(-1, size), axis=0) if sample else np.zeros((0, 0))
    shared = spark.sparkContext.broadcast(p)  # MOST vectors at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d = _distances(_matrix(b["emb"]), shared.value)
                cell = d.argmin(axis=1)
                yield pa.record_batch([b["gid"], b["emb"], pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(cell)), cell])], ["gid", "emb", "cell", "r"])

    cells = written(usable.where(F.size("emb") == size).mapInArrow(run, "gid long, emb array<double>, cell int, r double"), "cells")
    n, low, high = np.zeros(len(p), np.int64), np.zeros(len(p)), np.zeros(len(p))
    for r in cells.groupBy("cell").agg(F.count("*").alias("n"), F.min("r").alias("low"), F.max("r").alias("high")).collect():  # a row a cell
        n[r.cell], low[r.cell], high[r.cell] = r.n, r.low, r.high
    slices = F.array(*[F.lit(int(-(-x // slice_rows)) or 1) for x in n]) if len(p) else F.array(F.lit(1))
    part = F.pmod(F.xxhash64("gid", "emb"), F.get(slices, F.col("cell")))
    keyed = cells.select((F.shiftleft(F.col("cell").cast("long"), 32) + part).alias("key"), "gid", "emb", "r")
    return Pivots(written_in_buckets(keyed, "pivots", ["key"], int(spark.conf.get("spark.sql.shuffle.partitions"))), p, n, low, high, slice_rows)


def _probes(queries: DataFrame, index: Pivots, k: int) -> DataFrame:
    """(qid, key): the cells nearest to a query that hold k vectors together."""
    shared = queries.sparkSession.sparkContext.broadcast((index.pivots, index.n, index.slice_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, n, slice_rows = shared.value
        for b in batches:
            if not b.num_rows or not len(p):
                continue
            for qid, d in zip(b["qid"].to_pylist(), _distances(_matrix(b["qemb"]), p)):
                near = np.argsort(d, kind="stable")
                cells = near[: np.searchsorted(np.cumsum(n[near]), k) + 1]
                cells = cells[n[cells] > 0]
                parts = np.maximum(-(-n[cells] // slice_rows), 1)
                rows = np.repeat(cells, parts)
                part = np.arange(len(rows)) - np.repeat(np.cumsum(parts) - parts, parts)
                yield pa.record_batch([pa.array(np.full(len(rows), qid)), pa.array((rows.astype(np.int64) << 32) + part)], ["qid", "key"])

    return queries.select("qid", "qemb").mapInArrow(run, "qid long, key long")


def nearest(queries: DataFrame, index: Pivots, k: int, others: bool = False, counted: list | None = None) -> DataFrame:
    """(qid, rank, gid, sq_l2): the k nearest vectors of each query (gid, emb), ties to the smaller gid; others leaves out its own id.

    counted: gets a DataFrame (compared) with the number of pairs whose distance was computed."""
    size = index.pivots.shape[1] if len(index.pivots) else 0
    q = queries.select(F.col("gid").alias("qid"), F.col("emb").cast("array<double>").alias("qemb")).where(_finite("qemb") & (F.size("qemb") == size))
    more = k
    if others:  # a query's own id is not counted, however often it is there
        own = index.rows.join(q.select(F.col("qid").alias("gid")).distinct(), "gid", "left_semi").groupBy("gid").agg(F.count("*").alias("n"))
        more += own.agg(F.max("n")).first()[0] or 0
    probes = _probes(q, index, more)
    own = F.col("qid") != F.col("gid") if others else F.lit(True)
    few = F.broadcast(q) if small_enough(q, 10_000) else q
    one = probes.join(few, "qid").join(index.rows, "key").where(own).select("qid", "gid", sq_l2(F.col("qemb"), F.col("emb")).alias("sq_l2"))
    ranked = lambda d: d.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy("sq_l2", "gid"))).where(F.col("rank") <= k)
    near = written(ranked(one).select("qid", "gid", "sq_l2"), "near")
    bound = near.groupBy("qid").agg(F.when(F.count("*") >= k, F.max("sq_l2")).alias("bound")).withColumnRenamed("qid", "gid")
    asked = q.select(F.col("qid").alias("gid"), F.lit(0).cast("long").alias("code"), F.col("qemb").alias("emb")).join(bound, "gid", "left")
    found = None
    for part in blocks.slices(asked, size, "bound"):
        rows = _compared(part, index, k, others)
        found = rows if found is None else found.union(rows)
    if found is None:
        found = near.select("qid", "gid", "sq_l2", F.lit(0).cast("long").alias("compared"))
    if counted is not None:
        counted.append(one.agg(F.count("*").alias("n")).union(found.agg(F.coalesce(F.sum("compared"), F.lit(0)).alias("n"))).agg(F.sum("n").alias("compared")))
    return ranked(found.where("qid is not null").select("qid", "gid", "sq_l2")).select("qid", "rank", "gid", "sq_l2")


def _compared(part: blocks.Stated, index: Pivots, k: int, others: bool) -> DataFrame:
    """(qid, gid, sq_l2, compared): of the cells of each task the k nearest of each query of a slice, none beyond its bound (`more`), and
    a row without ids that says how many pairs were compared."""
    spark = index.rows.sparkSession
    shared, cells = spark.sparkContext.broadcast(part), spark.sparkContext.broadcast((index.pivots, index.low, index.high))
    schema = pa.schema([("qid", pa.int64()), ("gid", pa.int64()), ("sq_l2", pa.float64()), ("compared", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, (p, low, high), compared = shared.value, cells.value, 0
        best, bound = blocks.Best(len(q.ids), k), np.array([np.inf if x is None else x for x in q.more])
        for b in batches:
            cell, ids = b["key"].to_numpy() >> 32, b["gid"].to_numpy(zero_copy_only=False)
            x = blocks.matrix(b["emb"], p.shape[1])
            for c in np.unique(cell):
                at = np.flatnonzero(cell == c)
                d = np.sqrt(blocks.squares(q.emb, p[c][:, None])[:, 0])
                lb = np.maximum(np.maximum(d - high[c], low[c] - d), 0) * (1 - ROOM) - ROOM
                reach = np.sqrt(np.minimum(bound, best.key[:, -1])) * (1 + ROOM) + ROOM
                asked, mine, names = np.flatnonzero(lb <= reach), np.ascontiguousarray(x[at].T), ids[at]
                compared += len(asked) * len(at)
                for a in range(0, len(asked), blocks.TILE[0]):
                    rows = asked[a : a + blocks.TILE[0]]
                    for t in range(0, len(at), blocks.TILE[1]):
                        own = names[t : t + blocks.TILE[1]]
                        key = blocks.squares(q.emb[rows], mine[:, t : t + blocks.TILE[1]])
                        if others:
                            key[q.ids[rows, None] == own] = np.inf
                        worst = blocks.bounded(key, np.minimum(bound[rows], best.worst(rows)), k)
                        i, j = np.nonzero((key <= worst[:, None]) & (key < np.inf))
                        if len(i):
                            best.add(rows, i, key[i, j], own[j], key[i, j])
        out = best.batch(q)
        zero = pa.array(np.zeros(out.num_rows, np.int64))
        yield pa.record_batch([out["qid"], out["gid"], out["sq_l2"], zero], schema=schema)
        yield pa.record_batch([pa.array(y, f.type) for y, f in zip(([None], [None], [None], [compared]), schema)], schema=schema)

    return index.rows.select("key", "gid", "emb").mapInArrow(run, "qid long, gid long, sq_l2 double, compared long")
