"""Pairs of equal graphs are searched, stored and scored once; ids come last."""

import numpy as np

from kindred.functions import columns as C
from kindred.operators import encode, ged, graphs, large_graphs, scoring, train
from kindred.operators.graphs import GRAPH
from kindred.plans import lifecycle, model_queries, queries
from pyspark.sql import functions as F


def copies(spark, n):
    """n graphs of three structures."""
    kinds = [([0, 1], [(0, 1, 1)]), ([0, 1, 1], [(0, 1, 1)]), ([2], [])]
    rows = [(i, len(kinds[i % 3][0]), len(kinds[i % 3][1]), *kinds[i % 3]) for i in range(n)]
    return spark.createDataFrame(rows, GRAPH)


def test_batch_labels_search_each_pair_of_structures_once(spark, monkeypatch):
    g, seen, real = copies(spark, 60).withColumn("batch", F.floor(F.col("gid") / 30)), [], ged.decided
    monkeypatch.setattr(ged, "decided", lambda pairs, *a: seen.append(pairs.count()) or real(pairs, *a))
    rows = train.batch_labels(g, "batch", 4).collect()
    assert seen == [3] and len(rows) == 2 * 30 * 30 and all(r.qid // 30 == r.gid // 30 == r.batch for r in rows)
    far = {(0, 1): 1, (0, 2): 3, (1, 2): 4}
    assert all(r.ged == (0 if r.qid % 3 == r.gid % 3 else far[tuple(sorted((r.qid % 3, r.gid % 3)))]) for r in rows)
    _, _, d = train.structure_labels(g, "batch", 4)
    assert sorted(r.n for r in d.collect()) == [90] * 3 + [200] * 3


def test_ids_are_expanded_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(ged, "CHUNK", 7)
    of = spark.createDataFrame([(i, i % 2) for i in range(50)], "gid long, sid long")
    found = spark.createDataFrame([(0, 1, 5), (1, 1, 0)], "s1 long, s2 long, ged int")
    got = sorted(map(tuple, ged.expanded(found, of.where("gid < 10"), of).collect()))
    assert got == sorted((q, g, 5 if q % 2 == 0 else 0) for q in range(10) for g in range(1, 50, 2))
    assert ged.chunks(of, "s", "ids").agg(F.max(F.size("ids"))).first()[0] < 25


def test_pairs_of_large_classes_are_not_held(spark):
    """Both explodes in one stage of generated code held the product of two arrays, 16 million rows, before the first went on."""
    of = spark.range(9000).select(F.col("id").alias("gid"), F.lit(1).cast("long").alias("sid"))
    out = ged.expanded(spark.createDataFrame([(1, 1, 2)], "s1 long, s2 long, ged int"), of.where("gid < 600"), of)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    first, second = (i for i in range(len(plan)) if plan.startswith("Generate explode", i))
    assert "Repartition" in plan[first:second] and "false" in plan[first:second].split("Repartition")[1].split("\n")[0]
    assert ged.chunks(of, "s", "ids", ged.ASKED).agg(F.max(F.size("ids"))).first()[0] < 2 * ged.ASKED
    got = out.agg(F.count("*"), F.count_distinct("qid"), F.count_distinct("gid"), F.sum("qid"), F.sum("gid"), F.max("ged")).first()
    assert tuple(got) == (600 * 9000, 600, 9000, 9000 * sum(range(600)), 600 * sum(range(9000)), 2)


def test_range_query_verifies_classes(spark, monkeypatch):
    g, seen, real = copies(spark, 90), [], lifecycle.verify
    emb = F.array((F.col("v") / 2).cast("double"), (F.col("e") / 2).cast("double"))
    c = g.select("gid", C.structure_code(F.col("nodes"), F.col("edges")).alias("code"), emb.alias("emb"))
    monkeypatch.setattr(lifecycle, "verify", lambda found, *a: seen.append(found.count()) or real(found, *a))
    mine = F.col("gid") % 10 == 0
    rows = lifecycle.range_query(g, g.where(mine), c, c.where(mine), 1, fine=True).collect()
    assert seen[0] <= 9
    assert sorted(map(tuple, rows)) == sorted((q, i, int(q % 3 != i % 3)) for q in range(0, 90, 10) for i in range(90) if q % 3 == i % 3 or 2 not in (q % 3, i % 3))


def test_nearest_by_structure_equal_those_of_all_pairs(spark):
    g = copies(spark, 75)
    q, w, s = g.where("gid % 10 = 0"), encode.make_weights(3), scoring.make_scorer(4, (4,))
    found, qof, gof = scoring.score_structures(q, g, w, s)
    near = scoring.top_k_by_structure(found, gof, 30, 11.0).join(qof.withColumnRenamed("gid", "qid"), F.col("s1") == F.col("sid"))
    want = scoring.top_k_by_distance(scoring.score_pairs(q, g, w, s), 30, 11.0)
    key = lambda r: (r.qid, r.rank, r.gid)
    assert sorted(map(key, near.collect())) == sorted(map(key, want.collect()))
    assert found.count() == 9 and np.isfinite([r.score for r in found.collect()]).all()


def test_decided_sends_no_table_of_pairs_through_the_driver(spark):
    g = copies(spark, 30)
    p = g.select("gid", F.col("nodes").alias("nodes1"), F.col("edges").alias("edges1")).join(g.select(F.col("gid").alias("other"), F.col("nodes").alias("nodes2"), F.col("edges").alias("edges2")))
    d = ged.decided(p.where("gid < other").repartition(2), 3, steps=1)
    assert "Broadcast" not in d._jdf.queryExecution().executedPlan().toString() and d.where("ged is null").count() == 0


def test_a_round_of_ranks_moves_ranks_only(spark, monkeypatch):
    """Edges and vertices stay where they are: a round deals the shares and their sums; ranks equal those of whole rows."""
    g = copies(spark, 40)
    plans, real = [], large_graphs.written
    monkeypatch.setattr(large_graphs, "written", lambda df, name: plans.append((name, df._jdf.queryExecution().executedPlan().toString())) or real(df, name))
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = large_graphs.pagerank(graphs.vertices(g), graphs.edges(g), rounds=3).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert [p.count("Exchange hashpartitioning") for name, p in plans if name == "rank"][1:] == [2, 2, 2]
    want = {(r.gid, r.vid): r.rank for r in graphs.pagerank(g, rounds=3).collect()}
    assert len(got) == len(want) and all(abs(r.rank - want[r.gid, r.vid]) < 1e-12 for r in got)


def test_next_orders_build_paths_once(spark, tmp_path, monkeypatch):
    """Order 2 has no lines: it has no distance, and order 1's next one is still order 2."""
    labels = {1: "AB", 3: "A", 4: "AA", 5: "B"}
    lines = [(k, p, p, p, 1.0, "A" if x == "A" else "R", "F", "2024-01-01") for k, ls in labels.items() for p, x in enumerate(ls)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string, l_linestatus string, l_shipdate string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k, 7, k) for k in range(1, 6)] + [(6, 8, 1)], "o_orderkey long, o_custkey long, o_orderdate int").write.parquet(f"{tmp_path}/orders.parquet")
    stored, real = {}, queries.written
    monkeypatch.setattr(queries, "written", lambda df, name: stored.setdefault(name, df) and real(df, name))
    got = queries.ged_next_order(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == [(3, 4, 2), (4, 5, 3)]
    assert stored["next"].columns == ["gid", "after", "nodes1", "nodes2"]  # edges of a path follow from its length
    plan = stored["next"]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list") == 1


def test_search_bounds_deal_pairs_over_all_tasks(spark, tmp_path, monkeypatch):
    rows = [(i, f"2024-01-01 00:00:{i:02d}", 50 + i // 3, "abc"[i * i % 3]) for i in range(12)]
    e = spark.createDataFrame(rows, "event_id long, t string, user_id long, event_type string")
    e.select("event_id", F.col("t").cast("timestamp").alias("ts"), "user_id", "event_type").write.parquet(f"{tmp_path}/events.parquet")
    calls, dealt, structures = [], [], queries._structures
    monkeypatch.setattr(queries, "_structures", lambda *a: calls.append(a) or structures(*a))
    run = model_queries.assignment.with_attributed_distance
    monkeypatch.setattr(model_queries.assignment, "with_attributed_distance", lambda d, *a, **o: dealt.append(d) or run(d, *a, **o))
    model_queries.search_bounds(spark, str(tmp_path))
    assert len(calls) == 1  # events are read once
    assert dealt[0].rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
