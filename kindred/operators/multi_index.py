"""Multi-index of codes: a stored table of their substrings, probed within a radius that the substrings share.

A code is cut into parts. If a pair's distance is at most the radius, some part lies within its own threshold (the
thresholds, each plus one, add up to one more than the radius; with weights, the thresholds add up to the
limit). So a query is exploded into the values of each part within its threshold, and an equi-join on part and
value finds every code; full distances are compared then. The table is dealt into buckets by its key, so a
search moves only its probes. Each distinct code has a row for each part. A value that very many codes
share is cut into slices, which are buckets of their own; probes of it are repeated for each slice.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import hamming, weighted_hamming
from ..plans.planner import small_enough
from ..sources.scratch import written, written_in_buckets

SLICE = 50_000  # codes of one value in one bucket
MASKS = 30_000  # values that a query may be exploded into
WIDE = 32  # bits of the widest part


@dataclass
class MultiIndex:
    entries: DataFrame  # key, code: a row for each part of each distinct code
    heavy: DataFrame  # part, value, slices: only where there is more than one
    cuts: list[int]  # where the parts begin, and the width
    n: int  # distinct codes

    @property
    def width(self) -> int:
        return self.cuts[-1]


def cuts_of(width: int, parts: int) -> list[int]:
    return [round(i * width / parts) for i in range(parts + 1)]


def thresholds(cuts: list[int], radius: int) -> list[int]:
    """Errors to allow in each part, -1 where it need not be probed: each plus one, they add up to radius + 1."""
    parts = len(cuts) - 1
    share, more = divmod(radius + 1, parts)
    return [min(share + (i < more) - 1, cuts[i + 1] - cuts[i]) for i in range(parts)]


def choose_parts(n: int, radius: int, width: int) -> int:
    """The number of parts whose probes and expected candidates among n codes are fewest for a query."""

    def cost(parts: int) -> float:
        cuts = cuts_of(width, parts)
        balls = [sum(comb(b - a, k) for k in range(t + 1)) for a, b, t in zip(cuts, cuts[1:], thresholds(cuts, radius))]
        return float("inf") if sum(balls) > MASKS else sum(balls) + sum(n * x / 2 ** (b - a) for x, a, b in zip(balls, cuts, cuts[1:]))

    return min(range(-(-width // WIDE), width + 1), key=lambda p: (cost(p), p))


def _key(part, value, slice_) -> Column:
    """The three as one number: tables are dealt and joined by it."""
    return value.bitwiseOR(F.shiftleft(part.cast("long"), WIDE)).bitwiseOR(F.shiftleft(slice_.cast("long"), WIDE + 6))


def _part(code: Column, a: int, b: int) -> Column:
    return F.shiftrightunsigned(code, a).bitwiseAND(F.lit((1 << (b - a)) - 1))


def build(codes: DataFrame, width: int, radius: int = 9, parts: int | None = None, slice_rows: int = SLICE) -> MultiIndex:
    """The index of the column code; the number of parts, unless given, suits searches of about this radius."""
    spark = codes.sparkSession
    distinct = written(codes.select("code").distinct(), "codes")
    n = distinct.count()
    cuts = cuts_of(width, max(parts or choose_parts(n, radius, width), -(-width // WIDE)))
    each = F.array(*[F.struct(F.lit(i).alias("part"), _part(F.col("code"), a, b).alias("value")) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))])
    rows = distinct.select("code", F.inline(each))
    heavy = rows.groupBy("part", "value").agg(F.ceil(F.count("*") / slice_rows).cast("int").alias("slices")).where("slices > 1")
    heavy = written(heavy, "heavy")
    key = _key(F.col("part"), F.col("value"), F.pmod(F.xxhash64("code"), F.coalesce("slices", F.lit(1))))
    sliced = rows.join(heavy, ["part", "value"], "left").select(key.alias("key"), "code")
    entries = written_in_buckets(sliced, "multi_index", ["key"], int(spark.conf.get("spark.sql.shuffle.partitions")))
    return MultiIndex(entries, heavy, cuts, n)


def _list(values: list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")  # folded to one literal


def _probes(qcodes: DataFrame, index: MultiIndex, masks: list[list[int]]) -> DataFrame:
    """(qcode, part, key) of all values to look up."""
    each = [F.struct(F.lit(i).alias("part"), _part(F.col("qcode"), a, b).alias("own"), _list(m).alias("masks")) for i, (a, b, m) in enumerate(zip(index.cuts, index.cuts[1:], masks)) if m]
    p = qcodes.select("qcode", F.inline(F.array(*each)))
    p = p.select("qcode", "part", "own", F.explode("masks").alias("mask")).select("qcode", "part", F.col("own").bitwiseXOR(F.col("mask")).alias("value"))
    heavy = index.heavy
    if heavy.isEmpty():
        return p.select("qcode", "part", _key(F.col("part"), F.col("value"), F.lit(0)).alias("key"))
    p = p.join(F.broadcast(heavy) if small_enough(heavy) else heavy, ["part", "value"], "left")
    p = p.withColumn("slice", F.explode(F.sequence(F.lit(0), F.coalesce("slices", F.lit(1)) - 1)))
    return p.select("qcode", "part", _key(F.col("part"), F.col("value"), F.col("slice")).alias("key"))


def probe(queries: DataFrame, index: MultiIndex, radius: int) -> DataFrame:
    """(qcode, code, h): the codes within radius of each distinct code of queries."""
    radius, cuts = min(radius, index.width), index.cuts
    limits = thresholds(cuts, radius)
    masks = [[sum(1 << x for x in c) for k in range(t + 1) for c in combinations(range(b - a), k)] for a, b, t in zip(cuts, cuts[1:], limits)]
    q = queries.select(F.col("code").alias("qcode")).distinct()
    found = _probes(q, index, masks).join(index.entries, "key")
    h = hamming(F.col("qcode"), F.col("code"), index.width)
    # A pair comes out once, at the first part that lies within its threshold.
    near = [F.bit_count(_part(F.col("qcode").bitwiseXOR(F.col("code")), a, b)) <= t for a, b, t in zip(cuts, cuts[1:], limits)]
    first = F.coalesce(*[F.when(x, F.lit(i)) for i, x in enumerate(near)])
    return found.where((h <= radius) & (first == F.col("part"))).select("qcode", "code", h.alias("h"))


def weighted_probe(queries: DataFrame, index: MultiIndex, limit: float, weights: list[float]) -> DataFrame:
    """(qcode, code, h): weighted Hamming distances at most limit. Each part gets the share of the limit that its weights have."""
    cuts, total = index.cuts, sum(weights)
    masks = []
    for a, b in zip(cuts, cuts[1:]):
        own, most = weights[a:b], limit * sum(weights[a:b]) / total + 1e-9
        sums = [0.0]
        for w in own:  # of all masks in order
            sums += [s + w for s in sums]
        masks.append([m for m, s in enumerate(sums) if s <= most])
    q = queries.select(F.col("code").alias("qcode")).distinct()
    found = _probes(q, index, masks).join(index.entries, "key")
    wh = weighted_hamming(F.col("qcode"), F.col("code"), weights)
    return found.where(wh <= limit).select("qcode", "code", wh.alias("h")).distinct()


def weighted_parts(n: int, limit: float, weights: list[float]) -> int:
    """The number of parts of at most 16 bits whose probes and expected candidates are fewest."""
    width, total = len(weights), sum(weights)

    def cost(parts: int) -> float:
        cuts, out = cuts_of(width, parts), 0.0
        for a, b in zip(cuts, cuts[1:]):
            sums = [0.0]
            for w in weights[a:b]:
                sums += [s + w for s in sums]
            ball = sum(s <= limit * sum(weights[a:b]) / total + 1e-9 for s in sums)
            out += ball + n * ball / 2 ** (b - a)
        return out

    return min(range(-(-width // 16), width + 1), key=lambda p: (cost(p), p))
