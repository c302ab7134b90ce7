"""Scores of vertices in graphs that are too large for a row: vertices (gid, vid) and edges (gid, src, dst) are tables.

Each round is a join of the scores with the edges and a sum by end, written as a table, so that neither a plan nor a lost
executor goes back further than a round. Edges are stored once, in both directions and without loops and repeats. Sums are
formed in each task before rows move, so what a hub receives is a row a task; what it sends is a join that can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written, written_in_buckets


def both_ways(edges: DataFrame) -> DataFrame:
    """(gid, src, dst) of every edge in both directions, stored."""
    e = edges.where("src <> dst").select("gid", F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
    return written(e.union(e.select("gid", F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "edges")


def _own(vertices: DataFrame) -> DataFrame:
    return vertices.select("gid", F.col("vid").cast("long").alias("vid"))


def pagerank(vertices: DataFrame, edges: DataFrame, alpha: float = 0.1, rounds: int = 20) -> DataFrame:
    """(gid, vid, rank): alpha is the chance of a jump; ranks of vertices without edges spread evenly over their graph."""
    # Edges and vertices are dealt once by what rounds join on. Vertices without edges of a graph have one rank (lone), so that no sum over them is joined.
    buckets = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = written_in_buckets(both_ways(edges), "both", ["gid", "src"], buckets)
    degree = both.groupBy("gid", F.col("src").alias("vid")).agg(F.count("*").alias("degree"))
    own = written(_own(vertices).join(degree, ["gid", "vid"], "left").select("gid", "vid", F.coalesce("degree", F.lit(0)).alias("degree")), "degrees")
    n = own.groupBy("gid").agg(F.count("*").alias("n"), F.count_if(F.col("degree") == 0).alias("zero"))
    v = written_in_buckets(own.join(n, "gid").select("gid", "vid", "n", "zero", "degree"), "vertices", ["gid", "vid"], buckets)
    # a rank is shared by a vertex's edges; lone is the rank of a vertex without any
    row = lambda value: ("gid", "vid", value.alias("rank"), F.when(F.col("degree") > 0, value / F.col("degree")).alias("share"))
    lone = 1 / F.col("n")
    rank = written(v.select(*row(lone)), "rank")
    for _ in range(rounds):
        sent = rank.where("share is not null").select("gid", F.col("vid").alias("src"), "share")
        got = both.join(sent.hint("merge"), ["gid", "src"]).groupBy("gid", F.col("dst").alias("vid")).agg(F.sum("share").alias("got"))
        new = v.join(got.hint("merge"), ["gid", "vid"], "left")
        spread = F.col("zero") * lone / F.col("n")
        value = alpha / F.col("n") + (1 - alpha) * (F.coalesce("got", F.lit(0.0)) + spread)
        rank = written(new.select(*row(value)), "rank")
        lone = alpha / F.col("n") + (1 - alpha) * spread
    return rank.select("gid", "vid", "rank")


def hits(vertices: DataFrame, edges: DataFrame, rounds: int = 20) -> DataFrame:
    """(gid, vid, hub, authority) after so many rounds of both, each scaled to length one in its graph; 0 where there is no edge."""
    both = both_ways(edges)
    v = written(_own(vertices), "vertices")

    def passed_on(x: DataFrame, name: str) -> DataFrame:
        got = both.join(x.select("gid", F.col("vid").alias("src"), "x"), ["gid", "src"]).groupBy("gid", F.col("dst").alias("vid")).agg(F.sum("x").alias("y"))
        length = got.groupBy("gid").agg(F.sqrt(F.sum(F.col("y") * F.col("y"))).alias("length"))
        scaled = v.join(got.join(length, "gid"), ["gid", "vid"], "left")
        return written(scaled.select("gid", "vid", F.coalesce(F.when(F.col("length") > 0, F.col("y") / F.col("length")), F.lit(0.0)).alias("x")), name)

    hub, authority = v.withColumn("x", F.lit(1.0)), v.withColumn("x", F.lit(1.0))
    for _ in range(rounds):
        authority = passed_on(hub, "authority")
        hub = passed_on(authority, "hub")
    return hub.withColumnRenamed("x", "hub").join(authority.withColumnRenamed("x", "authority"), ["gid", "vid"])


def waves(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """(gid, start, vid, d): steps from each vertex of starts (gid, vid) to every vertex that it reaches, wave by wave.

    The starts are the stated side: what is stored is a row for each of them and each vertex that it reaches."""
    both = both_ways(edges)
    edge = written(_own(starts).distinct().select("gid", F.col("vid").alias("start"), "vid", F.lit(0).alias("d")), "wave")
    seen, d = edge, 0
    while not edge.isEmpty():
        d += 1
        step = edge.select("gid", "start", F.col("vid").alias("src")).join(both, ["gid", "src"]).select("gid", "start", F.col("dst").alias("vid")).distinct()
        edge = written(step.join(seen.select("gid", "start", "vid"), ["gid", "start", "vid"], "left_anti").withColumn("d", F.lit(d)), "wave")
        seen = written(seen.union(edge), "seen") if d % 8 == 0 else seen.union(edge)
    return seen


def closeness(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """(gid, vid, closeness, barycenter) of the stated vertices: 1 over the mean and over the sum of their distances, null where nothing is reached."""
    own = waves(starts, edges).groupBy("gid", F.col("start").alias("vid")).agg(F.sum("d").alias("total"), F.count("*").alias("n"))
    return own.select("gid", "vid", F.when(F.col("total") > 0, (F.col("n") - 1) / F.col("total")).alias("closeness"), F.when(F.col("total") > 0, 1 / F.col("total")).alias("barycenter"))
