"""Best-fit packing of token sequences after Martello-Toth dominance reduction.

Capacity bounds the number of different lengths, so the instance is a histogram (at most
`capacity` rows, however many documents there are) and the driver plans with multiplicities:
reduction and best-fit handle equal lengths at once. The plan, a list of bin patterns, comes
back to the pieces by their rank among pieces of the same length, without moving a text.

A null text is an empty one (its end id alone). Rows that repeat a doc_id are separate
documents; a null doc_id stays null. An empty table gives an empty result. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow, column, slices, written
from .words import word_ids

Pattern = tuple[int, tuple[int, ...]]  # how often, and the lengths in a bin in order


def reduce_instance(counts: dict[int, int], capacity: int) -> tuple[list[Pattern], dict[int, int]]:
    """Martello-Toth reduction: (bins fixed for good, what is left).

    For a length j, from the longest, let r be the space beside it. The set {j} dominates every
    other that holds j if nothing fits r. {j, k}, with the longest k that fits, does so if k
    fills r, if no two others fit r, or if no three do and no pair that fits is longer than k.
    Fixing a pair only lowers counts, so these stay true for as many pairs as there are.
    """
    left = np.zeros(capacity + 1, np.int64)
    for n, c in counts.items():
        left[n] = c
    fixed: list[Pattern] = []
    for j in range(capacity, 0, -1):
        while left[j]:
            r = capacity - j
            left[j] -= 1  # j itself is no companion
            fits = np.flatnonzero(left[: r + 1])
            left[j] += 1
            if not len(fits):
                fixed.append((int(left[j]), (j,)))
                left[j] = 0
                break
            k = int(fits[-1])
            few = np.repeat(fits[:3], np.minimum(left[fits[:3]] - (fits[:3] == j), 3))[:3]
            two, three = few[:2].sum() if len(few) > 1 else r + 1, few.sum() if len(few) > 2 else r + 1
            if not (k == r or two > r or three > r and _longest_pair(fits, left, j, r) <= k):
                break
            m = int(left[j] // 2 if j == k else min(left[j], left[k]))
            fixed.append((m, (j, k)))
            left[j] -= m
            left[k] -= m
    return fixed, {int(n): int(left[n]) for n in np.flatnonzero(left)}


def _longest_pair(fits: np.ndarray, left: np.ndarray, j: int, r: int) -> int:
    best, a, b = 0, 0, len(fits) - 1
    while a <= b:
        x, y = int(fits[a]), int(fits[b])
        if x + y > r:
            b -= 1
            continue
        if x != y or left[x] - (x == j) > 1:
            best = max(best, x + y)
        a += 1
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing with multiplicities: each item goes to the fullest open bin that it fits."""
    nodes: list[tuple[int, int, int]] = [(-1, 0, 0)]  # parent, length, times
    open_: list[list[list[int]]] = [[] for _ in range(capacity + 1)]  # by space left: [node, bins]
    for n in sorted(counts, reverse=True):
        m, r = counts[n], n
        while m and r <= capacity:
            if not open_[r]:
                r += 1
                continue
            node, bins = open_[r].pop()
            q = r // n
            full = min(bins, m // q)
            if full:
                nodes.append((node, n, q))
                open_[r - q * n].append([len(nodes) - 1, full])
                m -= full * q
            if full < bins:
                if 0 < m < q:
                    nodes.append((node, n, m))
                    open_[r - m * n].append([len(nodes) - 1, 1])
                    m, full = 0, full + 1
                if full < bins:
                    open_[r].append([node, bins - full])
        q = capacity // n
        for times, bins in ((q, m // q), (m % q, 1)):
            if times and bins:
                nodes.append((0, n, times))
                open_[capacity - times * n].append([len(nodes) - 1, bins])
    out = []
    for node, bins in (x for level in open_ for x in level):
        lengths: list[int] = []
        while node:
            parent, n, times = nodes[node]
            lengths[:0] = [n] * times
            node = parent
        out.append((bins, tuple(lengths)))
    return out


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Martello and Toth's L2: no packing has fewer bins.

    For a small size a: lengths over capacity - a have bins of their own, those over half have one each, whose
    space the lengths from a to half may fill; what does not fit there fills further bins."""
    n = np.zeros(capacity + 2, np.int64)
    for size, c in counts.items():
        n[size] = c
    many, tokens = np.cumsum(n), np.cumsum(n * np.arange(capacity + 2))
    half, best = capacity // 2, 0
    for a in range(half + 1):
        large = int(many[capacity] - many[half])  # over half, those over capacity - a among them
        free = int(many[capacity - a] - many[half]) * capacity - int(tokens[capacity - a] - tokens[half]) if capacity - a > half else 0
        small = int(tokens[half] - (tokens[a - 1] if a else 0))
        best = max(best, large + max(0, -(-(small - free) // capacity)))
    return best


def plan(counts: dict[int, int], capacity: int) -> list[Pattern]:
    fixed, rest = reduce_instance(counts, capacity)
    return fixed + best_fit(rest, capacity)


def slots(patterns: list[Pattern]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: first rank, first sequence and offset of each run of slots, ranks ascending."""
    found: dict[int, list] = defaultdict(list)
    ranks: Counter = Counter()
    first = 0
    for bins, lengths in patterns:
        at = 0
        for n in lengths:
            found[n].append((ranks[n], first, at))
            ranks[n] += bins
            at += n
        first += bins
    return {n: tuple(np.array(c, np.int64) for c in zip(*rows)) for n, rows in found.items()}


def tokenize_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """One row a piece, with its rank among its task's pieces of the same length."""
    end = np.array([end_id], "<u4").tobytes()
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("nth", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, seen = word_ids(tokenizer), TaskContext.get().partitionId(), Counter()
        for b in slices(batches):
            rows: list[tuple] = []
            for i, text in zip(column(b, "doc_id"), column(b, "text")):
                ids = words.ids(text) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    x = ids[at : at + 4 * capacity]
                    n = len(x) // 4
                    rows.append((i, k, at // 4, n, zlib.crc32(x), part, seen[n]))
                    seen[n] += 1
            yield arrow([list(c) for c in zip(*rows)], schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long")


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """pieces (a stored table with length, part, nth) with sequence_id and offset."""
    per = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = {r.length: r.n for r in per.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    table = slots(plan(counts, capacity))
    base = per.withColumn("base", F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)))
    ranked = pieces.join(base.select("length", "part", F.coalesce("base", F.lit(0)).alias("base")), ["length", "part"])
    names = [c for c in pieces.columns if c not in ("part", "nth")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length = b.column(b.schema.get_field_index("length")).to_numpy()
            rank = b.column(b.schema.get_field_index("nth")).to_numpy() + b.column(b.schema.get_field_index("base")).to_numpy()
            seq, off = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                ranks, first, at = table[int(length[own[0]])]
                e = np.searchsorted(ranks, rank[own], "right") - 1
                seq[own], off[own] = first[e] + rank[own] - ranks[e], at[e]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in names] + [pa.array(seq), pa.array(off)], names=[*names, "sequence_id", "offset"])

    kinds = dict(pieces.dtypes)
    return ranked.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in names) + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096) -> DataFrame:
    return pack(written(tokenize_pieces(docs, tokenizer, end_id, capacity), "pieces"), capacity)


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import documents

    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
