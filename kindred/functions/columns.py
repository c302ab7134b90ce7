"""Column functions over hash codes, embeddings, labels and strings; all stay in the JVM.

Null in, null out, unless a function says otherwise.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def binarize(values: Column, thresholds: Column | None = None, width: int | None = None) -> Column:
    """array<boolean>: whether each of the first `width` values exceeds its threshold (0 by default)."""
    v = F.slice(values, 1, width) if width else values
    if thresholds is None:
        return F.transform(v, lambda x: x > 0)
    return F.zip_with(v, F.slice(thresholds, 1, width) if width else thresholds, lambda x, t: x > t)


def pack_code(bits: Column) -> Column:
    """A long whose bit i is bits[i]."""
    placed = F.transform(bits, lambda b, i: F.when(b, F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int"))).otherwise(F.lit(0).cast("long")))
    return F.aggregate(placed, F.lit(0).cast("long"), lambda a, x: a + x)


def pack_positions(positions: Column) -> Column:
    """A long with the bits at these positions set."""
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int"))
    return F.aggregate(F.array_distinct(positions), F.lit(0).cast("long"), lambda a, i: a + bit(i))


def structure_code(nodes: Column, edges: Column) -> Column:
    """32 bits of a small graph without a model: labels that occur (8), edges by their ends (16), the number of vertices (8).

    Equal graphs have equal codes; an edit changes a few bits."""
    n = F.least(F.size(nodes), F.lit(8))
    count = F.when(n > 0, F.sequence(F.lit(24), 23 + n)).otherwise(F.array().cast("array<int>"))
    return pack_positions(F.concat(F.transform(nodes, lambda x: F.pmod(x, F.lit(8))), F.transform(edges, lambda e: 8 + F.pmod(e["src"] * 5 + e["dst"], F.lit(16))), count))


def set_bits(code: Column, width: int = 64) -> Column:
    """Positions of the bits that are set, ascending."""
    at = F.sequence(F.lit(0), F.lit(width - 1))
    return F.filter(at, lambda i: F.call_function("shiftright", code, i).bitwiseAND(F.lit(1).cast("long")) == 1)


def hamming(a: Column, b: Column, width: int = 64) -> Column:
    x = a.bitwiseXOR(b)
    return F.bit_count(x if width >= 64 else x.bitwiseAND(F.lit((1 << width) - 1)))


def weighted_hamming(a: Column, b: Column, weights: list[float]) -> Column:
    """Sum of the weights of the bits that differ, from bit 0 on."""
    x = a.bitwiseXOR(b)
    out = F.lit(0.0)
    for i, w in enumerate(weights):
        out = out + F.lit(float(w)) * F.call_function("shiftright", x, F.lit(i)).bitwiseAND(F.lit(1).cast("long"))
    return out


def bit_weights(kind: str, width: int) -> list[float]:
    """const: 1 each; log: log2(i + 2); exp: 2 ** -i; all by bit position i."""
    return {"const": [1.0] * width, "log": [math.log2(i + 2) for i in range(width)], "exp": [2.0**-i for i in range(width)]}[kind]


def sq_l2(a: Column, b: Column) -> Column:
    """Squared Euclidean distance, summed in order in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v)


def angular_difference(a: Column, b: Column) -> Column:
    d = F.abs(a - b)
    return F.least(F.lit(2 * math.pi) - d, d)


def parse_csv_doubles(s: Column) -> Column:
    """'[1.0,2.0]' as array<double>."""
    return F.from_json(s, "array<double>")


def natural_key(s: Column) -> Column:
    """Sorts names by the number in them: (text before it, number, text after it)."""
    return F.struct(F.regexp_extract(s, r"^(\D*)", 1), F.expr("0L") + F.coalesce(F.regexp_extract(s, r"^\D*(\d+)", 1).try_cast("long"), F.lit(-1)), F.regexp_extract(s, r"^\D*\d*(.*)$", 1))


def dense_relabel(labels: Column, *others: Column) -> Column:
    """Each label's place among the distinct labels of all arrays in order of first appearance, from 0."""
    all_ = F.array_distinct(F.concat(labels, *others))
    return F.transform(labels, lambda x: (F.array_position(all_, x) - 1).cast("int"))


def one_hot(labels: Column, width: int) -> Column:
    return F.transform(labels, lambda l: F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.when(i == l, F.lit(1.0)).otherwise(F.lit(0.0))))


def isolated(n: Column, ends: Column) -> Column:
    """Vertices 0..n-1 that no edge touches."""
    return F.when(n > 0, F.array_except(F.sequence(F.lit(0), n - 1), ends)).otherwise(F.array().cast("array<int>"))


def similarity(d: Column, kernel: int) -> Column:
    """0: d, 1: -d**2, 2: -d, 3: tanh(-d), 4: exp(-d)."""
    return {0: d, 1: -d * d, 2: -d, 3: F.tanh(-d), 4: F.exp(-d)}[kernel]


def multiset_common(a: Column, b: Column) -> Column:
    """Size of the intersection of two arrays as multisets."""
    count = lambda arr, x: F.size(F.filter(arr, lambda y: y == x))
    return F.aggregate(F.array_intersect(a, b), F.lit(0), lambda s, x: s + F.least(count(a, x), count(b, x)))


def label_bound(v1: Column, l1: Column, e1: Column, v2: Column, l2: Column, e2: Column) -> Column:
    """Lower bound of the edit distance from label multisets: l1 and l2 are vertex labels, e1 and e2 edge labels."""
    return F.greatest(v1, v2) - multiset_common(l1, l2) + F.greatest(F.size(e1), F.size(e2)) - multiset_common(e1, e2)


def degree_bound(v1: Column, l1: Column, d1: Column, e1: Column, v2: Column, l2: Column, d2: Column, e2: Column) -> Column:
    """Lower bound from vertex labels and degree sequences: edges to insert or delete to match sorted degrees.

    e1 and e2 are the edges' labels."""
    n = F.greatest(F.size(d1), F.size(d2))
    pad = lambda d: F.concat(F.sort_array(d, False), F.array_repeat(F.lit(0), n - F.size(d)))
    gap = F.zip_with(pad(d1), pad(d2), lambda a, b: a - b)
    half = lambda sign: F.ceil(F.aggregate(gap, F.lit(0), lambda s, x: s + F.greatest(sign * x, F.lit(0))) / 2).cast("int")
    ins, dele = half(-1), half(1)
    n1, n2 = F.size(e1), F.size(e2)
    edges = F.greatest(2 * ins + n1 - n2, 2 * dele + n2 - n1, n2 - multiset_common(e1, e2) + dele)
    return F.greatest(v1, v2) - multiset_common(l1, l2) + edges


def degree_edit_distance(d1: Column, d2: Column) -> Column:
    """Edges to insert and to delete, each half the summed gaps of sorted degree sequences, rounded up."""
    n = F.greatest(F.size(d1), F.size(d2))
    pad = lambda d: F.concat(F.sort_array(d, False), F.array_repeat(F.lit(0), n - F.size(d)))
    gap = F.zip_with(pad(d1), pad(d2), lambda a, b: a - b)
    half = lambda sign: F.ceil(F.aggregate(gap, F.lit(0), lambda s, x: s + F.greatest(sign * x, F.lit(0))) / 2).cast("int")
    return half(1) + half(-1)


def out_degree_distance(d1: Column, d2: Column) -> Column:
    """L1 distance of the sorted degree sequences."""
    n = F.greatest(F.size(d1), F.size(d2))
    pad = lambda d: F.concat(F.sort_array(d, False), F.array_repeat(F.lit(0), n - F.size(d)))
    return F.aggregate(F.zip_with(pad(d1), pad(d2), lambda a, b: F.abs(a - b)), F.lit(0), lambda s, x: s + x)


# Costs of attributed graphs, one attribute at a time.


def cost_squared(a: Column, b: Column) -> Column:
    return (a - b) * (a - b)


def cost_absolute(a: Column, b: Column) -> Column:
    return F.abs(a - b)


def cost_discrete(a: Column, b: Column, same: float, different: float) -> Column:
    return F.when(a == b, F.lit(same)).otherwise(F.lit(different))


def combine_costs(costs: list[tuple[Column, float]], root: float, share: float) -> Column:
    """Weighted sum of attribute costs, to the power 1 / root, times share."""
    total = F.lit(0.0)
    for c, importance in costs:
        total = total + c * F.lit(float(importance))
    return F.pow(total, F.lit(1.0 / root)) * F.lit(float(share))
