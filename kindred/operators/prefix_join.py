"""Pairs of graphs whose labels differ by little, by a prefix-filter join on label multisets, and a bound from stars.

A graph's tokens are its vertex labels and its edge labels, each with its number among equal ones, so that a
multiset is a set. An edit changes one token at most: graphs within distance b have all but b tokens of the
larger one in common. Order all tokens by how few graphs have them: then the b + 1 rarest tokens of two such
graphs meet in one at least, and only graphs that share one of these are compared. Graphs of at most b
tokens may have none in common; they meet in a token of their own.

A pair comes out at the first rare token that it shares, so nothing is compared twice. What is joined on tokens are ids,
sizes and rare tokens; graphs are fetched for the pairs whose sizes agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.planner import small_enough
from ..sources.scratch import written

FEW = -1  # the token of graphs that are small against the bound


def _numbered(labels: Column, kind: int) -> Column:
    """Equal labels told apart by their number, as whole numbers: label, number, kind."""
    s = F.array_sort(labels)
    return F.transform(s, lambda x, i: F.shiftleft(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)), 28).bitwiseOR(F.shiftleft((i + 1 - F.array_position(s, x)).cast("long"), 1)).bitwiseOR(F.lit(kind)))


def label_tokens() -> Column:
    """Tokens of a graph row."""
    return F.concat(_numbered(F.col("nodes"), 0), _numbered(F.transform("edges", lambda e: e["label"]), 1))


def star_tokens() -> Column:
    """For each vertex a hash of its label and its neighbours' labels with those of the edges between, numbered among equal ones."""
    ends = F.filter("edges", lambda e: e["src"] != e["dst"])
    around = lambda i: F.concat(
        F.transform(F.filter(ends, lambda e: e["src"] == i), lambda e: F.struct(F.get("nodes", e["dst"]).alias("l"), e["label"].alias("x"))),
        F.transform(F.filter(ends, lambda e: e["dst"] == i), lambda e: F.struct(F.get("nodes", e["src"]).alias("l"), e["label"].alias("x"))),
    )
    stars = F.transform("nodes", lambda l, i: F.hash(l, F.array_sort(around(i))))
    return _numbered(stars, 0)


def star_bound(v1: Column, s1: Column, d1: Column, v2: Column, s2: Column, d2: Column) -> Column:
    """Lower bound of the edit distance from stars: a relabelled vertex changes its own star and its neighbours', any other edit two at most.

    v: vertices, s: star tokens, d: largest degree. Relabelling can come after all deletions and before all insertions,
    where no vertex has more edges than in either graph."""
    most = F.greatest(F.lit(2), 1 + F.least(d1, d2))
    return F.ceil((F.greatest(v1, v2) - F.size(F.array_intersect(s1, s2))) / most).cast("int")


def tokenized(graphs: DataFrame) -> DataFrame:
    """(sid, v, e, tokens) of graphs (sid, v, e, nodes, edges)."""
    return graphs.select("sid", "v", "e", label_tokens().alias("tokens"))


def _rare(tokens: DataFrame, counts: DataFrame, bound: int) -> DataFrame:
    """(sid, v, e, rare): the bound + 1 tokens that fewest graphs have, the rarest first."""
    each = tokens.select("sid", "v", "e", F.explode("tokens").alias("token")).join(F.broadcast(counts) if small_enough(counts) else counts, "token", "left")
    order = F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")))
    rare = each.groupBy("sid").agg(F.first("v").alias("v"), F.first("e").alias("e"), F.slice(F.transform(order, lambda x: x["token"]), 1, bound + 1).alias("rare"))
    few = tokens.where(F.size("tokens") <= bound).select("sid", F.lit(FEW).cast("long").alias("few"))
    out = tokens.select("sid", F.col("v").alias("_v"), F.col("e").alias("_e")).join(rare, "sid", "left").join(few, "sid", "left")
    none = F.array().cast("array<bigint>")
    return out.select("sid", F.col("_v").alias("v"), F.col("_e").alias("e"), F.concat(F.coalesce("rare", none), F.when(F.col("few").isNull(), none).otherwise(F.array("few"))).alias("rare"))


def candidates(queries: DataFrame, graphs: DataFrame, bound: int) -> DataFrame:
    """(s1, s2): pairs of tokenized() graphs that share one of their rarest tokens and whose sizes allow the bound."""
    counts = written(graphs.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n")), "tokens")
    side = lambda t, k: _rare(t, counts, bound).select(F.col("sid").alias(f"s{k}"), F.col("v").alias(f"v{k}"), F.col("e").alias(f"e{k}"), F.col("rare").alias(f"rare{k}"), F.explode("rare").alias("token"))
    pairs = side(graphs, 2).join(side(queries, 1), "token")
    c = F.col
    near = F.abs(c("v1") - c("v2")) + F.abs(c("e1") - c("e2")) <= bound
    return pairs.where(near & (F.get(F.array_intersect("rare1", "rare2"), F.lit(0)) == c("token"))).select("s1", "s2")


def label_join(queries: DataFrame, graphs: DataFrame, bound: int) -> DataFrame:
    """(s1, s2, lb): all pairs of graphs (sid, v, e, nodes, edges) whose label bound is at most bound. Both should be stored tables."""
    q, g = written(tokenized(queries), "tokenized"), written(tokenized(graphs), "tokenized")
    side = lambda t, k: t.select(F.col("sid").alias(f"s{k}"), F.col("v").alias(f"v{k}"), F.col("e").alias(f"e{k}"), F.col("tokens").alias(f"t{k}"))
    pairs = candidates(q, g, bound).join(side(q, 1), "s1").join(side(g, 2), "s2")
    lb = F.greatest("v1", "v2") + F.greatest("e1", "e2") - F.size(F.array_intersect("t1", "t2"))
    return pairs.select("s1", "s2", lb.alias("lb")).where(F.col("lb") <= bound)
