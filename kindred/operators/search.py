"""Search over hash codes and embeddings: inverted index, Hamming balls, nearest neighbours.

Tables: codes (gid long, code long, emb array). Queries are codes with qid for gid.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import hamming, sq_l2
from ..plans.planner import small_enough
from ..sources.scratch import written
from . import blocks, multi_index, pivots

BINS = 64  # that a pass over the values cuts each position's range into
# Hamming radius for each edit distance: one more than the distance.
DEFAULT_MAPPING = tuple(d + 1 for d in range(10))


def build_index(codes: DataFrame) -> DataFrame:
    """(code, n, gids): postings of each code, ids ascending."""
    return codes.groupBy("code").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("gid")).alias("gids"))


def index_offsets(codes: DataFrame) -> DataFrame:
    """(code, n, pos): pos counts the postings of smaller codes.

    The running sum is cut by the code's high bits: totals of at most 4096 ranges are summed
    in one task, everything else stays in its range."""
    per = codes.groupBy("code").agg(F.count("*").alias("n"))
    top = per.agg(F.max("code")).first()[0] or 0
    shift = max(0, int(top).bit_length() - 12)
    per = per.withColumn("r", F.call_function("shiftright", F.col("code"), F.lit(shift)))
    totals = per.groupBy("r").agg(F.sum("n").alias("t")).select("r", F.coalesce(F.sum("t").over(W.orderBy("r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    local = F.coalesce(F.sum("n").over(W.partitionBy("r").orderBy("code").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return per.withColumn("local", local).join(F.broadcast(totals), "r").select("code", "n", (F.col("base") + F.col("local")).alias("pos"))


def _distinct(codes: DataFrame, name: str) -> DataFrame:
    return codes.select(F.col("code").alias(name)).distinct()


def ball_scan(queries: DataFrame, codes: DataFrame, radius: int, width: int) -> DataFrame:
    """(qcode, code, h) by comparing all distinct codes; the queries are the stated side, broadcast only if small."""
    q, c = _distinct(queries, "qcode"), _distinct(codes, "code")
    q = F.broadcast(q) if small_enough(q) else q
    return c.join(q, hamming(F.col("qcode"), F.col("code"), width) <= radius).withColumn("h", hamming(F.col("qcode"), F.col("code"), width))


def flips(radius: int, width: int) -> list[int]:
    return [sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(width), r)]


def ball_probe(queries: DataFrame, codes: DataFrame, radius: int, width: int) -> DataFrame:
    """(qcode, code, h) by enumerating each query's ball and an equi-join on the code."""
    masks = F.split(F.lit(",".join(map(str, flips(radius, width)))), ",").cast("array<bigint>")  # folded to one literal
    q = _distinct(queries, "qcode").select("qcode", F.explode(masks).alias("mask"))
    q = q.select("qcode", F.col("qcode").bitwiseXOR(F.col("mask")).alias("code"), F.bit_count("mask").alias("h"))
    return q.join(_distinct(codes, "code"), "code").select("qcode", "code", "h")


def ball_bands(queries: DataFrame, codes: DataFrame, radius: int, width: int) -> DataFrame:
    """(qcode, code, h) by pigeonhole: of radius + 1 bands at least one is equal; an equi-join per band, then the exact check."""
    cut = [round(i * width / (radius + 1)) for i in range(radius + 2)]
    band = lambda c: F.array(*[F.struct(F.lit(i).alias("i"), F.call_function("shiftright", F.col(c), F.lit(a)).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("x")) for i, (a, b) in enumerate(zip(cut, cut[1:]))])
    q = _distinct(queries, "qcode").select("qcode", F.explode(band("qcode")).alias("band"))
    c = _distinct(codes, "code").select("code", F.explode(band("code")).alias("band"))
    h = hamming(F.col("qcode"), F.col("code"), width)
    return q.join(c, "band").where(h <= radius).select("qcode", "code", h.alias("h")).distinct()


def ball_index(queries: DataFrame, codes: DataFrame, radius: int, width: int, index: multi_index.MultiIndex | None = None) -> DataFrame:
    """(qcode, code, h) by a multi-index, which is built and stored here if none is given."""
    return multi_index.probe(queries, index or multi_index.build(codes, width, radius), radius)


def ball(queries: DataFrame, codes: DataFrame, radius: int, width: int, strategy: str | None = None, index: multi_index.MultiIndex | None = None) -> DataFrame:
    from ..plans.planner import ball_strategy

    if index:
        return multi_index.probe(queries, index, radius)
    strategy = strategy or ball_strategy(codes, radius, width)
    return {"scan": ball_scan, "probe": ball_probe, "bands": ball_bands, "index": ball_index}[strategy](queries, codes, radius, width)


def expand(hits: DataFrame, queries: DataFrame, codes: DataFrame) -> DataFrame:
    """(qid, gid, h) and the embeddings, from pairs of distinct codes."""
    q = queries.select(F.col("gid").alias("qid"), F.col("code").alias("qcode"), F.col("emb").alias("qemb"))
    return hits.join(codes, "code").join(q, "qcode").select("qid", "gid", "h", "qemb", "emb")


def range_candidates(queries: DataFrame, codes: DataFrame, radius: int, width: int, fine: float | None = None, strategy: str | None = None, index: multi_index.MultiIndex | None = None) -> DataFrame:
    """(qid, gid, h, sq_l2): codes within radius; with fine also squared distance of embeddings at most that."""
    rows = expand(ball(queries, codes, radius, width, strategy, index), queries, codes).withColumn("sq_l2", sq_l2(F.col("qemb"), F.col("emb")))
    return (rows if fine is None else rows.where(F.col("sq_l2") <= fine)).select("qid", "gid", "h", "sq_l2")


def all_pairs(queries: DataFrame, codes: DataFrame, width: int) -> DataFrame:
    """(qid, gid, h, sq_l2) of the stated queries against all rows, in blocks."""
    q = queries.select(F.col("gid").alias("qid"), F.col("code").alias("qcode"), F.col("emb").alias("qemb"))
    q = F.broadcast(q) if small_enough(q) else q
    return codes.join(q).select("qid", "gid", hamming(F.col("qcode"), F.col("code"), width).alias("h"), sq_l2(F.col("qemb"), F.col("emb")).alias("sq_l2"))


def range_weighted(queries: DataFrame, codes: DataFrame, limit: float, weights: list[float], index: multi_index.MultiIndex | None = None) -> DataFrame:
    """(qid, gid, wh): weighted Hamming distance at most limit, by a multi-index."""
    if index is None:
        few = codes.select(F.approx_count_distinct("code")).first()[0]
        index = multi_index.build(codes, len(weights), parts=multi_index.weighted_parts(few, limit, weights))
    hits = multi_index.weighted_probe(queries, index, limit, weights)
    return expand(hits, queries, codes).select("qid", "gid", F.col("h").alias("wh"))


def top_k(queries: DataFrame, codes: DataFrame, k: int, others: bool = False, strategy: str | None = None, index: pivots.Pivots | None = None) -> DataFrame:
    """(qid, rank, gid, sq_l2): exact nearest embeddings; ties to the smaller gid. others leaves out the query's own id.

    strategy: scan compares the stated queries with all rows, pivots only with what cells around pivots do not rule out; by
    default scan for few rows. index: stored cells, for many searches."""
    from ..plans.planner import SCAN_ROWS

    if index or (strategy or ("scan" if small_enough(codes, SCAN_ROWS) else "pivots")) == "pivots":
        return pivots.nearest(queries, index or pivots.build(codes), k, others)
    q, c = (x.select("gid", F.lit(0).cast("long").alias("code"), "emb") for x in (queries, codes))
    return _ranked(blocks.nearest(q, c, k, others), k)


def first_by_code(queries: DataFrame, codes: DataFrame, k: int, radius: int, width: int) -> DataFrame:
    """(qid, rank, gid, sq_l2): of the codes within radius the k nearest by (code distance, gid)."""
    w = W.partitionBy("qid").orderBy("key", "gid")
    near = blocks.nearest(queries, codes, k, width=width, radius=radius)
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("qid", "rank", "gid", "sq_l2")


def _ranked(d: DataFrame, k: int) -> DataFrame:
    w = W.partitionBy("qid").orderBy(F.asc_nulls_last("sq_l2"), "gid")
    return d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("qid", "rank", "gid", "sq_l2")


def multi_probe(queries: DataFrame, codes: DataFrame, k: int, width: int, limit: int = 11, factor: int = 5, fall_back: bool = False, index: multi_index.MultiIndex | None = None) -> DataFrame:
    """(qid, rank, gid, sq_l2): nearest embeddings among the Hamming rings up to the first with factor * k candidates.

    Rings are whole. Near rings are probed; queries that they leave short are searched on in the multi-index. Where not
    even limit holds that many, all rings up to limit count. With fall_back a query is compared with all embeddings
    if no ring has a hit, or if it is still short when the next ring has more codes than there are graphs."""
    from ..plans.planner import PROBES, ball_size

    limit = min(limit, width)
    sizes = written(codes.groupBy("code").agg(F.count("*").alias("n")), "sizes")
    index = index or multi_index.build(sizes, width, limit)
    near = limit if index.n <= 2 * PROBES else max(r for r in range(limit + 1) if ball_size(r, width) <= PROBES)
    hits = written((ball_probe(queries, sizes, near, width) if near < limit else multi_index.probe(queries, index, limit)).join(sizes, "code"), "hits")
    if near < limit:
        done = hits.groupBy("qcode").agg(F.sum("n").alias("all")).where(F.col("all") >= factor * k)
        short = queries.join(done.select(F.col("qcode").alias("code")), "code", "left_anti")
        far = written(multi_index.probe(short, index, limit).where(F.col("h") > near).join(sizes, "code").select(*hits.columns), "hits")
        hits = hits.union(far)
    rings = hits.groupBy("qcode", "h").agg(F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("qcode").orderBy("h").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    kept = rings.withColumn("before", before).where(F.col("before") < factor * k).select("qcode", "h")
    rest = None
    if fall_back:
        n = codes.count()
        large = next((d for d in range(1, limit + 1) if comb(width, d) > n), limit + 1)
        inside = rings.where(F.col("h") < large).groupBy("qcode").agg(F.sum("n").alias("all"))
        inside = written(inside.where(F.col("all") >= (factor * k if large <= limit else 1)).select(F.col("qcode").alias("code")), "inside")
        rest = top_k(queries.join(inside, "code", "left_anti"), codes, k)
        queries = queries.join(inside, "code", "left_semi")
    rows = expand(hits.select("qcode", "code", "h").join(kept, ["qcode", "h"]), queries, codes)
    out = _ranked(rows.select("qid", "gid", sq_l2(F.col("qemb"), F.col("emb")).alias("sq_l2")), k)
    return out if rest is None else out.union(rest)


def competition_ranks(queries: DataFrame, codes: DataFrame, results: DataFrame, distance=None, digits: int = 1) -> DataFrame:
    """results (qid, gid, rank, d) with rk: 1 and the number of vectors whose distance from the query is under d.

    The distance is the squared one, rounded, by blocks, or another one as a column, distance(qemb, emb). A query carries its
    results' distances to the tasks; what is shuffled is a count for each query, distance and task."""
    cuts = results.groupBy("qid").agg(F.sort_array(F.collect_set("d")).alias("cuts"))
    q = written(queries.join(cuts.withColumnRenamed("qid", "gid"), "gid"), "cuts")
    if distance is None:
        below = blocks.below(q, codes, digits)
    else:
        q = q.select(F.col("gid").alias("qid"), F.col("emb").alias("qemb"), "cuts")
        d = codes.select("gid", "emb").join(F.broadcast(q) if small_enough(q) else q).select("qid", "cuts", distance(F.col("qemb"), F.col("emb")).alias("d"))
        below = d.select("qid", "d", F.posexplode("cuts").alias("place", "cut")).where("d < cut").groupBy("qid", "place").agg(F.count("*").alias("n"))
    below = below.groupBy(F.col("qid").alias("of"), "place").agg(F.sum("n").alias("n"))
    own = results.join(cuts, "qid").select("qid", "gid", "rank", (F.array_position("cuts", F.col("d")) - 1).alias("at"))
    counts = own.join(below, (F.col("qid") == F.col("of")) & (F.col("at") == F.col("place")), "left")
    return counts.select("qid", "gid", "rank", (F.coalesce("n", F.lit(0)) + 1).alias("rk"))


def medians(values: DataFrame) -> DataFrame:
    """(pos, threshold): the exact median of the finite x of each pos, in passes that only count.

    Each pass cuts what may still hold a middle value into BINS; a row for each bin in use reaches the driver, however many
    values there are. Bins shrink to the least and largest value in them, so a pass always rules some out."""
    v = values.select("pos", F.col("x").cast("double").alias("x")).where("x is not null and not isnan(x) and abs(x) < double('inf')")
    open_ = {}  # (pos, which middle): rank among the values from lo on, lo, hi
    for r in v.groupBy("pos").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect():  # a row a position
        for k in {(r.n - 1) // 2, r.n // 2}:
            open_[r.pos, k] = (k, r.lo, r.hi)
    done = {}
    while True:
        done |= {key: lo for key, (_, lo, hi) in open_.items() if lo == hi}
        open_ = {key: x for key, x in open_.items() if key not in done}
        if not open_:
            break
        at = values.sparkSession.createDataFrame([(pos, k, lo, hi) for (pos, k), (_, lo, hi) in open_.items()], "pos int, k long, lo double, hi double")
        share = (F.col("x") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)  # halves: no overflow
        inside = v.join(F.broadcast(at), "pos").where(F.col("x").between(F.col("lo"), F.col("hi")))  # two rows a position
        bins = inside.groupBy("pos", "k", F.least(F.lit(BINS - 1), F.floor(share * BINS)).alias("bin")).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()
        narrower = {}
        for r in sorted(bins, key=lambda r: r.bin):
            key = r.pos, r.k
            if key not in narrower:
                rank = open_[key][0]
                if rank < r.n:
                    narrower[key] = (rank, r.lo, r.hi)
                else:
                    open_[key] = (rank - r.n, r.lo, r.hi)
        open_ = narrower
    middle: dict = {}
    for (pos, _), x in done.items():
        middle.setdefault(pos, []).append(x)
    rows = [(pos, x[0] if len(x) == 1 else (x[0] + x[1]) / 2) for pos, x in sorted(middle.items())]
    return values.sparkSession.createDataFrame(rows, "pos int, threshold double")


def thresholds(vectors: DataFrame, kind: str) -> DataFrame:
    """(pos, threshold): median or mean of each position."""
    v = vectors.select(F.posexplode("emb").alias("pos", "x"))
    return medians(v) if kind == "median" else v.groupBy("pos").agg(F.avg(F.col("x").cast("double")).alias("threshold"))
