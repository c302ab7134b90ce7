"""Approximate nearest neighbours by multi-index hashing over learned rotated binary codes.

A rotation (principal directions turned by iterative quantization) is learned on a bounded
sample; the signs of a rotated, centred vector are its code. Blocks of vectors keep an index of
each 16-bit substring of their codes. Thresholds of the substrings add up so that a code within
the radius lies within its threshold of some substring's value (general pigeonhole principle:
the sum of threshold + 1 exceeds the radius), so probing those values finds every code within
the radius, and these are reranked by the inner product of the original vectors in double
precision. The radius is the distance within which the sample holds a COVER share of its own
nearest neighbours; true neighbours among more vectors are nearer, so recall only grows.
Vectors of different lengths are searched by direction and length: codes see one more
coordinate that makes all lengths equal. Lengths of very different size would leave nothing of the
direction then, so each class of lengths, at most a factor of four wide, has codes and an index of its own: a few
vectors of extreme length do not change the search of the others.

Vectors with different numbers of components have no inner product: each number of components
is searched for itself, and a query's candidates are the vectors that have as many as it has.

Vectors that are null, zero, or hold null or non-finite components take no part; neither do
rows without an id. Rows that repeat an id are candidates of their own, but never a query's
own id; a query id that repeats is answered once, for its first vector in byte order. With
fewer candidates than k all are returned; a query whose radius reaches fewer than k in all
blocks together is searched again with a radius that holds every code. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import column, written

SAMPLE, PROBES, COVER = 8000, 400, 0.94
BLOCK, QUERIES, GROUPS = 32768, 512, 16  # vectors of a block, queries of a group, most groups that meet a block at once
SUB = 16
MOST = 1e300  # lengths beyond it count as this


def _packed_bits(x: np.ndarray) -> np.ndarray:
    """Rows of at most 64 truth values as integers, the first value lowest."""
    b = np.packbits(x, axis=1, bitorder="little")
    return np.pad(b, ((0, 0), (0, 8 - b.shape[1]))).view("<u8").ravel()


class Codes:
    """Learned on a sample (rows of equal number of components): mean, rotation, and the radius for the share of neighbours.

    top: the largest length of any vector; all is done with vectors divided by it."""

    def __init__(self, x: np.ndarray, k: int, top: float, bits: int | None = None, rounds: int = 30, seed: int = 5):
        self.top = top
        y = self._even(x)
        self.mean = y.mean(axis=0)
        y = y - self.mean
        bits = min(bits or 64, 64)
        _, vectors = np.linalg.eigh(y.T @ y)
        basis = vectors[:, ::-1][:, : min(bits, y.shape[1])]
        v = y @ basis
        rng = np.random.default_rng(seed)
        r = np.linalg.qr(rng.normal(size=(v.shape[1], v.shape[1])))[0]
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
            r = (u @ w).T
        self.rotation = basis @ r
        self.bits = self.rotation.shape[1]
        c = self.of(x)
        step = max(1, len(x) // PROBES)
        x, found = x / top, []
        for q in range(0, len(x), step):
            s = x @ x[q]
            s[q] = -np.inf
            near = np.argsort(-s, kind="stable")[: min(k, len(x) - 1)]
            found.append(np.bitwise_count(c[near] ^ self.of_queries(x[q : q + 1])))
        found = np.concatenate(found) if found else np.zeros(1)
        self.radius = int(np.quantile(found, COVER, method="higher")) if len(found) else self.bits

    def _even(self, x: np.ndarray) -> np.ndarray:
        x = x / self.top
        rest = np.sqrt(np.maximum(1 - (x * x).sum(axis=1), 0))
        return np.concatenate([x, rest[:, None] if rest.max(initial=0) > 1e-3 else np.zeros((len(x), 1))], axis=1)

    def of(self, x: np.ndarray) -> np.ndarray:
        """64-bit codes of rows."""
        return _packed_bits((self._even(x) - self.mean) @ self.rotation >= 0)

    def of_queries(self, x: np.ndarray) -> np.ndarray:
        """A query's length does not order its candidates: it is coded at full length, without the extra coordinate."""
        x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of what is left neither overflow nor vanish
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        return _packed_bits((np.concatenate([x, np.zeros((len(x), 1))], axis=1) - self.mean) @ self.rotation >= 0)


@lru_cache
def masks(width: int) -> tuple[np.ndarray, np.ndarray]:
    """All changes of a substring, the fewest bits first, and how many change at most 0, 1, 2 ... bits."""
    every = np.arange(1 << width)
    n = np.bitwise_count(every)
    return every[np.argsort(n, kind="stable")].astype(np.int32), np.cumsum(np.bincount(n, minlength=width + 1))


@lru_cache
def thresholds(bits: int, radius: int) -> tuple[int, ...]:
    """For each substring the errors to probe (-1: none): the sum of threshold + 1 exceeds the radius.

    Each step goes where the share of values probed grows least."""
    widths = [min(SUB, bits - i) for i in range(0, bits, SUB)]
    out = [-1] * len(widths)

    def more(s: int) -> float:
        sizes = masks(widths[s])[1]
        return float("inf") if out[s] == widths[s] else (sizes[out[s] + 1] - (sizes[out[s]] if out[s] >= 0 else 0)) / sizes[-1]

    for _ in range(min(radius, bits) + 1):
        out[min(range(len(out)), key=more)] += 1
    return tuple(out)


class Index:
    """Multi-index over one block: for every substring the rows of each value."""

    def __init__(self, codes: np.ndarray, bits: int):
        self.codes, self.bits = codes, bits
        self.widths = [min(SUB, bits - i) for i in range(0, bits, SUB)]
        self.order, self.cut = [], []
        for s, w in enumerate(self.widths):
            part = self._part(codes, s)
            self.order.append(np.argsort(part, kind="stable").astype(np.int32))
            self.cut.append(np.concatenate([[0], np.cumsum(np.bincount(part, minlength=1 << w))]).astype(np.int32))

    def _part(self, codes: np.ndarray, s: int) -> np.ndarray:
        return ((codes >> np.uint64(s * SUB)) & np.uint64((1 << self.widths[s]) - 1)).astype(np.int32)

    def probed(self, code: np.uint64, radius: int) -> np.ndarray:
        """Rows that probing touches."""
        hit = np.zeros(len(self.codes), bool)
        own = np.array([code], np.uint64)
        for s, t in enumerate(thresholds(self.bits, radius)):
            if t < 0:
                continue
            change, sizes = masks(self.widths[s])
            values = self._part(own, s) ^ change[: sizes[t]]
            start, end = self.cut[s][values], self.cut[s][values + 1]
            some = end > start
            start, n = start[some], (end - start)[some]
            if len(n):  # the lists of all these values, one after the other
                at = np.repeat(start - (np.cumsum(n) - n).astype(np.int32), n) + np.arange(n.sum(), dtype=np.int32)
                hit[self.order[s][at]] = True
        return np.flatnonzero(hit)

    def within(self, code: np.uint64, radius: int) -> np.ndarray:
        """Rows whose codes differ in at most radius bits."""
        rows = self.probed(code, radius)
        return rows[np.bitwise_count(self.codes[rows] ^ code) <= radius]


def inner(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Row by row in one order of summation, so that equal vectors have equal products."""
    return (x * q).sum(axis=1)


def _usable(vectors: DataFrame) -> DataFrame:
    ok = (
        F.col("vec_id").isNotNull()
        & F.col("embedding").isNotNull()
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("embedding", lambda x: x != 0)
    )
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(ok)


def _packed(rows: DataFrame, group: str, extra: list[str]) -> DataFrame:
    """One row a group: ids and vectors as binaries."""

    def run(t: pa.Table) -> pa.Table:
        x = np.array(t.column("embedding").to_pylist(), float)
        one = {c: [t.column(c)[0].as_py()] for c in [group, *extra]}
        return pa.table(one | {"ids": [t.column("vec_id").to_numpy().astype("<i8").tobytes()], "vectors": [x.astype("<f8").tobytes()]}).cast(schema)

    schema = pa.schema([(c, pa.int32()) for c in [group, *extra]] + [("ids", pa.binary()), ("vectors", pa.binary())])
    return rows.groupBy(group, *extra).applyInArrow(run, "".join(f"{c} int, " for c in [group, *extra]) + "ids binary, vectors binary")


def nearest(vectors: DataFrame, is_query, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score for every row that is_query (a condition on vec_id) selects."""
    spark = vectors.sparkSession
    rows = _usable(vectors)
    asked = rows.where(is_query).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
    # Where squares vanish or overflow the largest entry tells the size well enough.
    length = F.when((length > 0) & (length < MOST), length).otherwise(F.least(F.array_max(F.transform("embedding", F.abs)), F.lit(MOST)))
    octave = F.floor(F.log2(length)).cast("int")
    sizes = rows.groupBy(F.size("embedding").alias("size"), octave.alias("octave")).agg(F.count("*").alias("n"), F.max(length).alias("top")).collect()  # at most 2200 rows for each number of components
    queries = {r["size"]: r["n"] for r in asked.groupBy(F.size("embedding").alias("size")).agg(F.count("*").alias("n")).collect()}
    found = None
    for size in sorted(queries):
        classes: list[list] = []
        for r in sorted((r for r in sizes if r["size"] == size), key=lambda r: r["octave"]):
            if classes and r["octave"] <= classes[-1][0]["octave"] + 1:
                classes[-1].append(r)
            else:
                classes.append([r])
        for c in classes:
            own = rows.where(F.size("embedding") == size)
            own = own.where(octave.between(c[0]["octave"], c[-1]["octave"])) if len(classes) > 1 else own
            one = _near(own, asked.where(F.size("embedding") == size), size, sum(r["n"] for r in c), max(r["top"] for r in c), queries[size], k)
            found = one if found is None else found.union(one)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _near(rows: DataFrame, asked: DataFrame, size: int, n: int, top: float, n_asked: int, k: int) -> DataFrame:
    """query_id, vec_id, score: the nearest of every block of n rows of `size` components, for each vector asked."""
    spark = rows.sparkSession
    sample = np.array([r.embedding for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()])  # at most SAMPLE vectors
    codes = spark.sparkContext.broadcast(Codes(sample, k, top))
    found = _searched(rows, asked, size, n, n_asked, codes, k, None)
    # Queries that found fewer than they could are searched with a radius that holds all codes.
    most = F.least(F.lit(k), F.lit(n) - F.coalesce("own", F.lit(0)))
    held = rows.join(asked.select("vec_id"), "vec_id").groupBy("vec_id").agg(F.count("*").alias("own"))
    few = asked.select("vec_id").join(held, "vec_id", "left").join(found.groupBy(F.col("query_id").alias("vec_id")).agg(F.count("*").alias("got")), "vec_id", "left").where(F.coalesce("got", F.lit(0)) < most)
    again = written(asked.join(few.select("vec_id"), "vec_id", "left_semi"), "again")
    n_again = again.count()
    if not n_again:
        return found
    return found.join(again.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").union(_searched(rows, again, size, n, n_again, codes, k, 64))


def _searched(rows: DataFrame, asked: DataFrame, size: int, n: int, n_asked: int, codes, k: int, radius: int | None) -> DataFrame:
    groups, n_blocks = max(1, -(-n_asked // QUERIES)), max(1, -(-n // BLOCK))
    at_once = max(1, min(GROUPS, groups * n_blocks // 64))
    queries = _packed(asked.withColumn("g", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int")), "g", [])
    queries = queries.groupBy(F.floor(F.col("g") / at_once).alias("chunk")).agg(F.collect_list(F.struct("ids", "vectors")).alias("asked"))  # at_once each
    blocks = _packed(rows.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(n_blocks)).cast("int")), "block", [])
    # The stated queries meet all rows block by block: an equi-join on the chunk of query groups.
    chunks = F.sequence(F.lit(0), F.lit((groups - 1) // at_once)).cast("array<long>")
    meet = blocks.withColumn("chunk", F.explode(chunks)).join(queries, "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codes.value
        reach = c.radius if radius is None else min(radius, c.bits)
        for b in batches:
            for ids, vecs, asked in zip(*(column(b, x) for x in ("ids", "vectors", "asked"))):
                i, x = np.frombuffer(ids, "<i8"), np.frombuffer(vecs, "<f8").reshape(-1, size)
                index = Index(c.of(x), c.bits)
                for group in asked:
                    qi, qx = np.frombuffer(group["ids"], "<i8"), np.frombuffer(group["vectors"], "<f8").reshape(-1, size)
                    out = []
                    for q, v, code in zip(qi, qx, c.of_queries(qx)):
                        near = index.within(code, reach)
                        near = near[i[near] != q]
                        if len(near) > k:  # rounding can move what is as near as this to the last
                            rough = x[near] @ v
                            least = -np.partition(-rough, k - 1)[k - 1]
                            near = near[rough >= least - 1e-9 * max(1.0, np.abs(rough).max())]
                        s = inner(x[near], v)
                        order = np.lexsort((i[near], -s))[:k]
                        out.append((np.full(len(order), q), i[near[order]], s[order]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)) for a in zip(*out)], names=["query_id", "vec_id", "score"])

    return written(meet.select("chunk", "ids", "vectors", "asked").repartition(F.xxhash64("chunk", "ids")).mapInArrow(run, "query_id long, vec_id long, score double"), "near")


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
