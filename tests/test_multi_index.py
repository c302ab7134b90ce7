import random

import pytest
from pyspark.sql import functions as F

from kindred.functions.columns import bit_weights
from kindred.operators import multi_index, search
from kindred.plans import lifecycle


def codes_of(spark, values, start=0):
    return spark.createDataFrame([(start + i, v, [float(v % 7), float(i)]) for i, v in enumerate(values)], "gid long, code long, emb array<double>")


def values(seed, n, width):
    """Codes with near ones among them, many that share low bits, and repeats."""
    r = random.Random(seed)
    base = [r.getrandbits(width) for _ in range(n // 3)]
    near = [b ^ sum(1 << i for i in r.sample(range(width), r.randint(0, min(6, width)))) for b in base]
    low = [(r.getrandbits(width) >> 9 << 9) | 5 for _ in range(n // 3)]
    return [*base, *near, *low, base[0], base[0], 0, (1 << width) - 1]


def near_pairs(queries, codes, radius):
    return {(q, c, (q ^ c).bit_count()) for q in set(queries) for c in set(codes) if (q ^ c).bit_count() <= radius}


@pytest.mark.parametrize("width, radius, parts, slices", [(32, 9, None, 50_000), (32, 3, 4, 4), (32, 0, None, 3), (12, 4, 2, 5), (12, 12, None, 50_000), (63, 7, 5, 2), (32, 11, 3, 50_000)])
def test_probing_finds_every_pair_once(spark, width, radius, parts, slices):
    db, qs = values(1, 150, width), values(1, 150, width)[::5] + values(2, 30, width)
    index = multi_index.build(codes_of(spark, db), width, radius, parts, slices)
    found = multi_index.probe(codes_of(spark, qs), index, radius).collect()
    assert len(found) == len({(r.qcode, r.code) for r in found})
    assert {(r.qcode, r.code, r.h) for r in found} == near_pairs(qs, db, radius)


def test_weighted_probing(spark):
    w = bit_weights("log", 32)
    db, qs = values(3, 150, 32), values(3, 150, 32)[::7]
    cost = lambda x: sum(w[i] for i in range(32) if x >> i & 1)
    for parts in (2, multi_index.weighted_parts(len(db), 20.3, w)):
        index = multi_index.build(codes_of(spark, db), 32, parts=parts, slice_rows=6)
        got = multi_index.weighted_probe(codes_of(spark, qs), index, 20.3, w).collect()
        want = {(q, c) for q in set(qs) for c in set(db) if cost(q ^ c) <= 20.3}
        assert len(got) == len(want) and {(r.qcode, r.code) for r in got} == want and all(abs(r.h - cost(r.qcode ^ r.code)) < 1e-9 for r in got)


def test_thresholds_cover_the_radius():
    for width in (12, 32, 63):
        for parts in range(1, width + 1):
            for radius in range(width + 1):
                cuts = multi_index.cuts_of(width, parts)
                t = multi_index.thresholds(cuts, radius)
                # Parts that hold more errors than allowed, everywhere, hold more than the radius together, or the part has no more bits.
                assert any(x == b - a for x, a, b in zip(t, cuts, cuts[1:])) or sum(x + 1 for x in t) > radius


def test_plan_moves_only_the_probes(spark):
    """The stored index is read by bucket: no shuffle of it, no comparison of all codes."""
    index = multi_index.build(codes_of(spark, values(4, 300, 32)), 32, 9)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = multi_index.probe(codes_of(spark, values(5, 30, 32)), index, 9)
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Bucketed: true" in plan
    assert plan.count("Exchange") == 2  # of the queries' distinct codes, and of the probes


def test_one_stored_index_serves_searches(spark):
    db, qs = codes_of(spark, values(6, 240, 32)), codes_of(spark, values(6, 240, 32)[:40:4], 1000)
    index = multi_index.build(db, 32, 9)
    key = lambda df: sorted(tuple(r) for r in df.collect())
    for radius in (2, 9):
        assert key(search.range_candidates(qs, db, radius, 32, index=index).select("qid", "gid", "h")) == key(search.range_candidates(qs, db, radius, 32, strategy="scan").select("qid", "gid", "h"))
    assert key(lifecycle.top_k_query(db, qs, 3, index=index)) == key(lifecycle.top_k_query(db, qs, 3))
    empty = codes_of(spark, [1]).where("gid < 0")
    assert multi_index.probe(empty, index, 3).count() == 0
    none = multi_index.build(empty, 32)
    assert none.n == 0 and multi_index.probe(qs, none, 3).count() == 0
    assert F
