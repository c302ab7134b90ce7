"""One registered query for each operator, over whole tables, with the same as DuckDB SQL where SQL can say it.

Codes are the signs of the first WIDTH components of an embedding. The stated queries are the
vectors, or graphs, whose id is divisible by 50; all vectors, or graphs, are the database, their own ones among them.
"""

from __future__ import annotations

from collections.abc import Callable
from math import comb

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import assignment, augment, blocks, encode, ged, graphs, metrics, prefix_join, search
from ..sources import formats
from ..sources.scratch import scratch_path, written
from ..streaming.queries import range_stream
from . import lifecycle

Query = Callable[[SparkSession, str], DataFrame]
WIDTH = 12
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def codes(spark: SparkSession, sf_dir: str, width: int = WIDTH) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("gid"), C.pack_code(C.binarize(F.col("embedding"), width=width)).alias("code"), F.col("embedding").alias("emb"))


def sides(spark: SparkSession, sf_dir: str, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    c = codes(spark, sf_dir, width)
    return c.where("gid % 50 = 0"), c


def r6(c) -> F.Column:
    return F.round(c, 6)


def _codes_sql(width: int) -> str:
    return f"""codes AS (SELECT vec_id AS gid, CAST(list_sum(list_transform(range({width}), lambda i: CASE WHEN embedding[i + 1] > 0 THEN (1::BIGINT << i) ELSE 0::BIGINT END)) AS BIGINT) AS code, embedding AS emb FROM embeddings),
q AS (SELECT gid AS qid, code AS qcode, emb AS qemb FROM codes WHERE gid % 50 = 0), d AS (SELECT * FROM codes),
pairs AS (SELECT qid, gid, CAST(bit_count(xor(qcode, code)) AS BIGINT) AS h, list_sum(list_transform(range(1, len(emb) + 1), lambda i: (qemb[i]::DOUBLE - emb[i]::DOUBLE) * (qemb[i]::DOUBLE - emb[i]::DOUBLE))) AS sq, xor(qcode, code) AS x FROM q, d)"""


CODES, CODES32 = _codes_sql(WIDTH), _codes_sql(32)


# Index and code queries


@query(f"WITH {CODES} SELECT code, count(*) AS n, array_to_string(list(gid ORDER BY gid), ',') AS gids FROM codes GROUP BY code")
def index_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.build_index(codes(spark, sf_dir)).select("code", "n", F.array_join(F.transform("gids", lambda x: x.cast("string")), ",").alias("gids"))


@query(f"WITH {CODES32} SELECT code, count(*) AS n, array_to_string(list(gid ORDER BY gid), ',') AS gids FROM codes GROUP BY code")
def index_build_32(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.build_index(codes(spark, sf_dir, 32)).select("code", "n", F.array_join(F.transform("gids", lambda x: x.cast("string")), ",").alias("gids"))


@query(f"WITH {CODES}, n AS (SELECT code, count(*) AS n FROM codes GROUP BY code) SELECT code, n, CAST(coalesce(sum(n) OVER (ORDER BY code ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos FROM n")
def index_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.index_offsets(codes(spark, sf_dir))


@query("SELECT vec_id AS gid, CAST(list_sum(list_transform(range(32), lambda i: CASE WHEN embedding[i + 1] > 0 THEN (1::BIGINT << i) ELSE 0::BIGINT END)) AS BIGINT) AS code FROM embeddings")
def code_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes(spark, sf_dir, 32).select("gid", "code")


@query(f"WITH {CODES} SELECT gid, array_to_string(list_filter(range(64), lambda i: (code >> i) & 1 = 1), ',') AS bits FROM codes")
def code_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes(spark, sf_dir).select("gid", F.array_join(F.transform(C.set_bits(F.col("code")), lambda x: x.cast("string")), ",").alias("bits"))


def _threshold_sql(f: str) -> str:
    return f"SELECT i - 1 AS pos, round({f}(embedding[i]::DOUBLE), 6) AS threshold FROM embeddings, range(1, 65) t(i) GROUP BY i"


@query(_threshold_sql("median"))
def code_threshold_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.thresholds(codes(spark, sf_dir), "median").select(F.col("pos").cast("long").alias("pos"), r6("threshold").alias("threshold"))


@query(_threshold_sql("avg"))
def code_threshold_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.thresholds(codes(spark, sf_dir), "mean").select(F.col("pos").cast("long").alias("pos"), r6("threshold").alias("threshold"))


# Range and top-k search

BALL = f"WITH {CODES} SELECT qid, gid, h FROM pairs WHERE h <= 2"


def _ball(strategy: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        q, d = sides(spark, sf_dir)
        return search.range_candidates(q, d, 2, WIDTH, strategy=strategy).select("qid", "gid", F.col("h").cast("long").alias("h"))

    run.__name__ = f"range_hamming_{strategy}"
    return run


for _s in ("scan", "probe", "bands"):
    query(BALL)(_ball(_s))


@query(f"WITH {CODES} SELECT qid, gid, h, round(sq, 6) AS sq_l2 FROM pairs WHERE h <= 4 AND sq <= 1.75")
def range_fine(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, d = sides(spark, sf_dir)
    return search.range_candidates(q, d, 4, WIDTH, fine=1.75).select("qid", "gid", F.col("h").cast("long").alias("h"), r6("sq_l2").alias("sq_l2"))


@query(f"WITH {CODES}, w AS (SELECT qid, gid, list_sum(list_transform(range({WIDTH}), lambda i: log2(i + 2) * ((x >> i) & 1))) AS wh FROM pairs) SELECT qid, gid, round(wh, 6) AS wh FROM w WHERE wh <= 5.05")
def range_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, d = sides(spark, sf_dir)
    return search.range_weighted(q, d, 5.05, C.bit_weights("log", WIDTH)).select("qid", "gid", r6("wh").alias("wh"))


@query(f"WITH {CODES} SELECT qid, CAST(rank AS BIGINT) AS rank, gid, round(sq, 6) AS sq_l2 FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sq, gid) AS rank FROM pairs) WHERE rank <= 10")
def topk_emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top_k(*sides(spark, sf_dir), 10).select("qid", F.col("rank").cast("long").alias("rank"), "gid", r6("sq_l2").alias("sq_l2"))


MULTI = f"""{CODES}, rings AS (SELECT qid, h, count(*) AS n FROM pairs WHERE h <= 11 GROUP BY qid, h),
cum AS (SELECT qid, h, coalesce(sum(n) OVER (PARTITION BY qid ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM rings),
multi AS (SELECT qid, gid, sq, row_number() OVER (PARTITION BY qid ORDER BY sq, gid) AS rank FROM pairs JOIN cum USING (qid, h) WHERE before < 50 QUALIFY rank <= 10)"""


@query(f"WITH {MULTI} SELECT qid, CAST(rank AS BIGINT) AS rank, gid, round(sq, 6) AS sq_l2 FROM multi")
def topk_multiprobe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.multi_probe(*sides(spark, sf_dir), 10, WIDTH).select("qid", F.col("rank").cast("long").alias("rank"), "gid", r6("sq_l2").alias("sq_l2"))


@query(BALL)
def range_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query codes arrive as a stream and meet the stored index; the sink is a table that is then read."""
    jvm, path = spark._jvm, f"{sf_dir}/embeddings.parquet"
    p = jvm.org.apache.hadoop.fs.Path(path)
    folder = p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()
    source = spark.readStream.schema(spark.read.parquet(path).schema)
    e = source.parquet(path) if folder else source.option("pathGlobFilter", "embeddings.parquet").parquet(sf_dir)
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("gid"), C.pack_code(C.binarize(F.col("embedding"), width=WIDTH)).alias("code"))
    _, d = sides(spark, sf_dir)
    out = scratch_path(spark, "stream")
    w = range_stream(q, d, 2, WIDTH).writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    w.awaitTermination()
    return spark.read.schema("qid long, gid long, h int").parquet(f"{out}/rows").select("qid", "gid", F.col("h").cast("long").alias("h"))


@query(f"WITH {CODES32} SELECT qid, gid, h, round(sq, 6) AS sq_l2 FROM pairs WHERE h <= 9")
def range_hamming_32(spark: SparkSession, sf_dir: str) -> DataFrame:
    """32-bit codes within 9 bits, by the strategy that the planner chooses."""
    return search.range_candidates(*sides(spark, sf_dir, 32), 9, 32).select("qid", "gid", F.col("h").cast("long").alias("h"), r6("sq_l2").alias("sq_l2"))


@query(f"WITH {CODES32}, w AS (SELECT qid, gid, list_sum(list_transform(range(32), lambda i: log2(i + 2) * ((x >> i) & 1))) AS wh FROM pairs) SELECT qid, gid, round(wh, 6) AS wh FROM w WHERE wh <= 30.05")
def range_weighted_32(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.range_weighted(*sides(spark, sf_dir, 32), 30.05, C.bit_weights("log", 32)).select("qid", "gid", r6("wh").alias("wh"))


_RINGS = ", ".join(f"({d}, {comb(32, d)})" for d in range(1, 12))
TOPK_FULL = f"""WITH {CODES32}, large AS (SELECT coalesce(min(dist), 12) AS dist FROM (VALUES {_RINGS}) t(dist, n) WHERE n > (SELECT count(*) FROM d)),
rings AS (SELECT qid, h, count(*) AS n FROM pairs WHERE h <= 11 GROUP BY qid, h),
cum AS (SELECT qid, h, coalesce(sum(n) OVER (PARTITION BY qid ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM rings),
inside AS (SELECT r.qid FROM rings r, large l WHERE r.h < l.dist GROUP BY r.qid HAVING sum(n) >= max(CASE WHEN l.dist <= 11 THEN 50 ELSE 1 END)),
cand AS (SELECT qid, gid, sq FROM pairs JOIN cum USING (qid, h) WHERE before < 50 AND qid IN (SELECT qid FROM inside) UNION ALL SELECT qid, gid, sq FROM pairs WHERE qid NOT IN (SELECT qid FROM inside))
SELECT qid, CAST(rank AS BIGINT) AS rank, gid, round(sq, 6) AS sq_l2 FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sq, gid) AS rank FROM cand) WHERE rank <= 10"""


@query(TOPK_FULL)
def topk_query_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The top-k driver on 32-bit codes: rings of the code index, or all embeddings where rings cost more or have no hit."""
    q, d = sides(spark, sf_dir, 32)
    return lifecycle.top_k_query(d, q, 10).select("qid", F.col("rank").cast("long").alias("rank"), "gid", r6("sq_l2").alias("sq_l2"))


# Metrics of code search against exact neighbours

TRUTH = f"{CODES}, truth AS (SELECT qid, gid, sq FROM pairs QUALIFY row_number() OVER (PARTITION BY qid ORDER BY sq, gid) <= 20)"
PRF = f"""WITH {TRUTH}, res AS (SELECT qid, gid FROM pairs WHERE h <= 1),
per AS (SELECT q.qid, count(t.gid) AS nt, count(r.gid) AS nr, count(CASE WHEN t.gid IS NOT NULL AND r.gid IS NOT NULL THEN 1 END) AS nb
 FROM q LEFT JOIN (SELECT coalesce(t.qid, r.qid) AS k, t.gid AS tg, r.gid AS rg FROM (SELECT * FROM truth WHERE sq < 1.3) t FULL JOIN res r ON t.qid = r.qid AND t.gid = r.gid) b ON q.qid = b.k
 LEFT JOIN (SELECT 1) ON false LEFT JOIN LATERAL (SELECT b.tg AS gid) t ON true LEFT JOIN LATERAL (SELECT b.rg AS gid) r ON true GROUP BY q.qid),
pr AS (SELECT *, CASE WHEN nt = 0 AND nr = 0 THEN 1.0 WHEN nr = 0 THEN 0.0 ELSE nb::DOUBLE / nr END AS p, CASE WHEN nt = 0 AND nr = 0 THEN 1.0 WHEN nt = 0 THEN 0.0 ELSE nb::DOUBLE / nt END AS r FROM per),
f AS (SELECT *, CASE WHEN p * r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END AS f1 FROM pr)
SELECT round(avg(p::DOUBLE), 6) AS precision, round(avg(r::DOUBLE), 6) AS recall, round(avg(f1::DOUBLE), 6) AS f1, round(avg(nr), 6) AS mean_result, count(CASE WHEN nb = 0 THEN 1 END) AS n_zero, count(*) AS n_queries FROM f"""


def _prf(only_relevant: bool) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        q, d = sides(spark, sf_dir)
        truth = search.top_k(q, d, 20).where("sq_l2 < 1.3")
        per = metrics.per_query(q.select(F.col("gid").alias("qid")), truth, search.range_candidates(q, d, 1, WIDTH))
        m = metrics.macro(per, only_relevant)
        return m.select(*(r6(c).alias(c) for c in ("precision", "recall", "f1", "mean_result")), "n_zero", "n_queries")

    run.__name__ = "prf1_nonempty" if only_relevant else "prf1_macro"
    return run


query(PRF)(_prf(False))
query(PRF.replace("AS n_queries FROM f", "AS n_queries FROM f WHERE nt > 0"))(_prf(True))

RANKED = f"""{CODES}, t AS (SELECT qid, gid, round(sq, 1) AS dd FROM pairs), rk AS (SELECT qid, gid, rank() OVER (PARTITION BY qid ORDER BY dd) AS rk FROM t),
res AS (SELECT qid, gid, row_number() OVER (PARTITION BY qid ORDER BY h, gid) AS pos FROM pairs WHERE h <= 5 QUALIFY pos <= 10),
adj AS (SELECT qid, pos, rk + row_number() OVER (PARTITION BY qid, rk ORDER BY pos) - 1 AS arank FROM res JOIN rk USING (qid, gid))"""


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each query's first ten results by code distance with their ranks in the truth, which is rounded so that it has ties."""
    q, d = sides(spark, sf_dir)
    near = search.first_by_code(q, d, 10, 5, WIDTH)
    near = written(near.select("qid", "gid", "rank", F.round("sq_l2", 1).alias("d")), "near")
    return search.competition_ranks(q, d, near)


@query(f"WITH {RANKED} SELECT q.qid, round(count(r.gid) / 10.0::DOUBLE, 6) AS p_at_k FROM q LEFT JOIN (SELECT res.qid, res.gid FROM res JOIN rk USING (qid, gid) WHERE rk <= 10) r ON q.qid = r.qid GROUP BY q.qid")
def p_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.precision_at_k(sides(spark, sf_dir)[0].select(F.col("gid").alias("qid")), _ranked(spark, sf_dir), 10).select("qid", r6("p_at_k").alias("p_at_k"))


@query(f"WITH {RANKED}, r AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY pos) AS x, row_number() OVER (PARTITION BY qid ORDER BY arank, pos) AS y FROM adj) SELECT qid, round(CASE WHEN count(*) > 1 THEN corr(x, y) END, 6) AS rho FROM r GROUP BY qid")
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.spearman(metrics.tie_adjusted(_ranked(spark, sf_dir))).select("qid", r6("rho").alias("rho"))


@query(f"WITH {RANKED} SELECT a.qid, round(sum(sign(b.arank - a.arank))::DOUBLE / count(*), 6) AS tau FROM adj a JOIN adj b ON a.qid = b.qid AND a.pos < b.pos GROUP BY a.qid")
def kendall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.kendall(metrics.tie_adjusted(_ranked(spark, sf_dir))).select("qid", r6("tau").alias("tau"))


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ged, h, n): counts of all pairs by quarters of the squared distance and by code distance."""
    return blocks.histogram(*sides(spark, sf_dir), WIDTH, 4).withColumnRenamed("step", "ged")


@query(f"WITH {CODES} SELECT CAST(floor(sq * 4) AS BIGINT) AS ged, least(h, 11) AS ham, count(*) AS n FROM pairs WHERE floor(sq * 4) BETWEEN 0 AND 11 GROUP BY ALL")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(_steps(spark, sf_dir), n="n")


_CELLS = " || ' ' || ".join(f"count(CASE WHEN h IS NOT NULL AND least(h, 11) = {j} THEN 1 END)" for j in range(12))


@query(f"WITH {CODES} SELECT CAST(r.i AS BIGINT) AS ged, {_CELLS} AS value FROM range(12) r(i) LEFT JOIN pairs ON floor(sq * 4) = r.i GROUP BY r.i")
def confusion_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 12 x 12 matrix as the lines of its text file."""
    m = metrics.confusion(_steps(spark, sf_dir), n="n")
    return formats.matrix_lines(m, "ged", "ham", "n").select(F.col("row").cast("long").alias("ged"), "value")


@query(f"WITH {CODES} SELECT CAST(floor(sq * 4) AS BIGINT) AS ged, count(*) AS n FROM pairs GROUP BY ALL")
def ged_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _steps(spark, sf_dir).groupBy("ged").agg(F.sum("n").alias("n"))


@query(f"WITH {CODES} SELECT round(avg((sq - least(h / 4.0::DOUBLE, 2.5)) ** 2), 6) AS mse, count(*) AS n FROM pairs")
def mse_ged(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = blocks.squared_error(*sides(spark, sf_dir), WIDTH, 0.25, 2.5).agg(F.sum("total").alias("total"), F.sum("k").alias("k"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return sums.select(r6(F.when(F.col("k") > 0, F.col("total") / F.col("k"))).alias("mse"), "n")


@query(f"WITH {CODES} SELECT qid, gid, round(sq, 6) AS k0, round(0 - sq * sq, 6) AS k1, round(0 - sq, 6) AS k2, round(tanh(0 - sq), 6) AS k3, round(exp(-sq), 6) AS k4 FROM pairs")
def sim_kernels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.kernels(*sides(spark, sf_dir), 6, C.similarity)


# Graphs of tables

GRAPHS = """ev AS (SELECT user_id * 100000 + date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS gid, ts, event_id, event_type AS t FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL AND event_type IS NOT NULL),
kinds AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS label FROM (SELECT DISTINCT t FROM ev)),
lab AS (SELECT gid, ts, event_id, label FROM ev JOIN kinds USING (t)),
vx AS (SELECT gid, label, row_number() OVER (PARTITION BY gid ORDER BY label) - 1 AS vid FROM (SELECT DISTINCT gid, label FROM lab)),
step AS (SELECT DISTINCT gid, least(label, before) AS a, greatest(label, before) AS b FROM (SELECT gid, label, lag(label) OVER (PARTITION BY gid ORDER BY ts, event_id) AS before FROM lab) WHERE before IS NOT NULL AND before <> label),
ed AS (SELECT s.gid, x.vid AS src, y.vid AS dst FROM step s JOIN vx x ON x.gid = s.gid AND x.label = s.a JOIN vx y ON y.gid = s.gid AND y.label = s.b),
gr AS (SELECT n.gid, n.v, coalesce(m.e, 0) AS e, n.nodes, coalesce(m.edges, '') AS edges FROM (SELECT gid, count(*) AS v, string_agg(label, ' ' ORDER BY vid) AS nodes FROM vx GROUP BY gid) n
 LEFT JOIN (SELECT gid, count(*) AS e, string_agg(src || '-' || dst, ' ' ORDER BY src, dst) AS edges FROM ed GROUP BY gid) m USING (gid)),
both_ AS (SELECT gid, src AS vid, dst AS nb FROM ed UNION ALL SELECT gid, dst, src FROM ed),
deg AS (SELECT vx.gid, vx.vid, vx.label, count(b.nb) AS degree FROM vx LEFT JOIN both_ b ON b.gid = vx.gid AND b.vid = vx.vid GROUP BY ALL)"""


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.transition_graphs(table(spark, sf_dir, "events"))


def _flat(g: DataFrame) -> DataFrame:
    return g.select(
        "gid", F.col("v").cast("long").alias("v"), F.col("e").cast("long").alias("e"),
        F.array_join(F.transform("nodes", lambda x: x.cast("string")), " ").alias("nodes"),
        F.array_join(F.transform("edges", lambda e: F.concat_ws("-", e["src"].cast("string"), e["dst"].cast("string"))), " ").alias("edges"),
    )


@query(f"WITH {GRAPHS} SELECT * FROM gr")
def graph_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(transitions(spark, sf_dir))


@query(f"WITH {GRAPHS} SELECT * FROM gr")
def bss_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graphs written as BSS text files and read again, splits of a file by tasks of their own."""
    path = scratch_path(spark, "bss_files")
    formats.write_bss(transitions(spark, sf_dir), path)
    return _flat(formats.read_bss(spark, path))


ORDERS = """ln AS (SELECT l_orderkey AS gid, list_position(['AF', 'NF', 'NO', 'RF', 'AO', 'RO'], l_returnflag || l_linestatus) - 1 AS label FROM lineitem)"""


@query(f"WITH {ORDERS} SELECT gid, count(*) AS v, count(*) - 1 AS e, CAST(sum(label) AS BIGINT) AS labels FROM ln GROUP BY gid")
def order_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graphs.order_graphs(table(spark, sf_dir, "lineitem"))
    return g.select("gid", F.col("v").cast("long").alias("v"), F.col("e").cast("long").alias("e"), F.aggregate("nodes", F.lit(0).cast("long"), lambda a, x: a + x).alias("labels"))


@query(f"WITH {ORDERS} SELECT gid, CAST(label AS BIGINT) AS label, count(*) AS n FROM ln GROUP BY ALL")
def label_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.label_histogram(graphs.order_graphs(table(spark, sf_dir, "lineitem"))).select("gid", F.col("label").cast("long").alias("label"), "n")


@query(f"WITH {ORDERS} SELECT CAST(max(label) AS BIGINT) AS max_label, count(DISTINCT gid) AS n FROM ln")
def max_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graphs.order_graphs(table(spark, sf_dir, "lineitem"))
    return g.agg(F.max(F.array_max("nodes")).cast("long").alias("max_label"), F.count("*").alias("n"))


@query(f"WITH {GRAPHS} SELECT gid, vid, degree FROM deg")
def degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.degrees(transitions(spark, sf_dir)).select("gid", F.col("vid").cast("long").alias("vid"), "degree")


@query(f"WITH {GRAPHS} SELECT gid, string_agg(vid, ' ' ORDER BY vid) AS isolated FROM deg WHERE degree = 0 GROUP BY gid")
def isolated_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = graphs.isolated_vertices(transitions(spark, sf_dir)).where(F.size("isolated") > 0)
    return i.select("gid", F.array_join(F.transform("isolated", lambda x: x.cast("string")), " ").alias("isolated"))


@query(f"WITH {ORDERS}, v AS (SELECT gid, label, row_number() OVER (PARTITION BY gid ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity) - 1 AS vid, count(*) OVER (PARTITION BY gid) AS n FROM (SELECT l_orderkey AS gid, list_position(['AF', 'NF', 'NO', 'RF', 'AO', 'RO'], l_returnflag || l_linestatus) - 1 AS label, * FROM lineitem)), k AS (SELECT gid, label, CASE WHEN n = 1 THEN '' WHEN vid = 0 THEN '1' WHEN vid = n - 1 THEN (vid - 1)::VARCHAR ELSE (vid - 1) || ',' || (vid + 1) END AS nb FROM v), c AS (SELECT gid, label, nb, count(*) AS n FROM k GROUP BY ALL) SELECT gid, count(*) AS n_classes, CAST(product(n) AS BIGINT) AS product FROM c GROUP BY gid")
def twin_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.twin_classes(graphs.order_graphs(table(spark, sf_dir, "lineitem")))


@query(SQL["twin_classes"])
def twin_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same classes from tables of vertices and edges, as for graphs larger than a row."""
    g = written(graphs.order_graphs(table(spark, sf_dir, "lineitem")), "graphs")
    t = graphs.twins(graphs.vertices(g), graphs.edges(g))
    more = t.where("vid <> twin").groupBy("gid", "twin").agg((F.count("*") + 1).alias("n"))  # classes of one vertex change no product
    rows = t.where("vid = twin").select("gid", F.lit(1).alias("k"), F.lit(1).cast("long").alias("n")).union(more.select("gid", F.lit(0), "n"))
    return rows.groupBy("gid").agg(F.sum("k").alias("n_classes"), F.product("n").cast("long").alias("product"))


@query(f"WITH {GRAPHS}, s AS (SELECT gid, vid, 1 / sqrt(degree + 1) AS s FROM deg) SELECT b.gid, b.vid AS row, b.nb AS col, round(x.s * y.s, 6) AS val FROM both_ b JOIN s x ON x.gid = b.gid AND x.vid = b.vid JOIN s y ON y.gid = b.gid AND y.vid = b.nb UNION ALL SELECT gid, vid, vid, round(s * s, 6) FROM s")
def laplacian(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.laplacian(transitions(spark, sf_dir)).select("gid", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), r6("val").alias("val"))


@query(f"WITH {GRAPHS} SELECT gid, vid, CASE WHEN degree + label = 0 THEN 0.0 ELSE round(degree / (degree + label)::DOUBLE, 6) END AS x0, CASE WHEN degree + label = 0 THEN 0.0 ELSE round(label / (degree + label)::DOUBLE, 6) END AS x1 FROM deg")
def row_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices' features (degree, label) over their sum; both are 0 for an isolated vertex with label 0."""
    rows = transitions(spark, sf_dir).select("gid", F.posexplode(F.arrays_zip(graphs.degree_array().alias("d"), F.col("nodes").alias("l"))).alias("vid", "x"))
    f = rows.select("gid", F.col("vid").cast("long").alias("vid"), graphs.row_normalized(F.array("x.d", "x.l")).alias("f"))
    return f.select("gid", "vid", r6(F.col("f")[0]).alias("x0"), r6(F.col("f")[1]).alias("x1"))


@query(f"WITH {GRAPHS} SELECT gid, 1::BIGINT AS label, count(*) AS n FROM ed GROUP BY gid")
def edge_label_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.edge_label_histogram(transitions(spark, sf_dir)).select("gid", F.col("label").cast("long").alias("label"), "n")


@query("WITH l AS (SELECT l_orderkey AS gid, list(l_returnflag || l_linestatus ORDER BY l_returnflag || l_linestatus, l_partkey) AS x FROM lineitem GROUP BY 1), d AS (SELECT gid, x, list_sort(list_distinct(x)) AS u FROM l) SELECT gid, array_to_string(list_transform(x, lambda y: list_position(u, y) - 1), ' ') AS labels FROM d")
def relabel_joint(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat("l_returnflag", "l_linestatus")
    x = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("gid")).agg(F.transform(F.sort_array(F.collect_list(F.struct(key.alias("k"), "l_partkey"))), lambda s: s["k"]).alias("x"))
    return x.select("gid", F.array_join(F.transform(C.dense_relabel(F.col("x")), lambda i: i.cast("string")), " ").alias("labels"))


@query(f"WITH {GRAPHS} SELECT gid, v, e, nodes, edges FROM (SELECT *, row_number() OVER (ORDER BY gid) AS rn FROM gr) WHERE rn % 2 = 1")
def subsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(graphs.subsample_every_second(transitions(spark, sf_dir)))


# Distances of graphs: equal structures are compared once and weighted

STRUCT = f"""{GRAPHS}, st AS (SELECT nodes, edges, v, e, count(*) AS n, count(*) FILTER (gid % 50 = 0) AS nq FROM gr GROUP BY ALL),
sx AS (SELECT *, list_transform(string_split(nodes, ' '), lambda x: x::INT) AS ls,
 list_reverse_sort(list_transform(range(v), lambda i: CAST(len(list_filter(string_split(replace(edges, '-', ' '), ' '), lambda x: x = i::VARCHAR)) AS BIGINT))) AS ds FROM st),
pr AS (SELECT a.nq * b.n AS w, a.v AS v1, b.v AS v2, a.e AS e1, b.e AS e2, a.ls AS l1, b.ls AS l2, a.ds AS d1, b.ds AS d2, len(list_intersect(a.ls, b.ls)) AS common, a.nodes AS n1, b.nodes AS n2, a.edges AS x1, b.edges AS x2 FROM sx a, sx b WHERE a.nq > 0)"""


def _weighted_pairs(spark: SparkSession, sf_dir: str, bound: int | None = None) -> DataFrame:
    """Structure pairs with their weights: graphs of the queries against all graphs, within what the cheap bounds allow."""
    s = _structures(spark, sf_dir)
    pairs = ged.bounded_pairs(s.where("nq > 0"), s, bound)
    return pairs.join(s.select(F.col("sid").alias("s1"), "nq"), "s1").join(s.select(F.col("sid").alias("s2"), "n"), "s2").withColumn("w", F.col("nq") * F.col("n"))


def _structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct structures, how many graphs have each, and how many of these are queries: a stored table, which pairs and weights read."""
    g = transitions(spark, sf_dir)
    s = g.groupBy("nodes", "edges").agg(F.min("gid").alias("sid"), F.first("v").alias("v"), F.first("e").alias("e"), F.count("*").alias("n"), F.sum((F.col("gid") % 50 == 0).cast("long")).alias("nq"))
    return written(s, "structures")


def _bound(f) -> DataFrame:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _weighted_pairs(spark, sf_dir).groupBy(f(F.col).cast("long").alias("lb")).agg(F.sum("w").alias("n"))

    return run


def _named(name: str, sql: str, f) -> None:
    f.__name__ = name
    query(sql)(f)


_named("label_lb", f"WITH {STRUCT} SELECT greatest(v1, v2) - common + abs(e1 - e2) AS lb, CAST(sum(w) AS BIGINT) AS n FROM pr GROUP BY lb", _bound(lambda c: C.label_bound(c("v1"), c("nodes1"), c("el1"), c("v2"), c("nodes2"), c("el2"))))


_GAPS = "list_transform(range(1, greatest(v1, v2) + 1), lambda i: coalesce(d1[i], 0) - coalesce(d2[i], 0))"
_named(
    "degree_lb",
    f"""WITH {STRUCT}, gp AS (SELECT *, CAST(ceil(list_sum(list_transform({_GAPS}, lambda x: greatest(-x, 0))) / 2) AS BIGINT) AS ie, CAST(ceil(list_sum(list_transform({_GAPS}, lambda x: greatest(x, 0))) / 2) AS BIGINT) AS de FROM pr)
SELECT greatest(v1, v2) - common + greatest(2 * ie + e1 - e2, 2 * de + e2 - e1, e2 - least(e1, e2) + de) AS lb, CAST(sum(w) AS BIGINT) AS n FROM gp GROUP BY lb""",
    _bound(lambda c: C.degree_bound(c("v1"), c("nodes1"), c("d1"), c("el1"), c("v2"), c("nodes2"), c("d2"), c("el2"))),
)

# A graph of at most 5 vertices as 5 label slots (-1 where there is none) and 10 edge flags; the
# distance is the least number of differing slots and flags over the 120 orders of one graph.
_AT = [(i, j) for i in range(5) for j in range(i + 1, 5)]
_COST = " + ".join([f"(coalesce(l1[{i + 1}], -1) <> coalesce(l2[p[{i + 1}] + 1], -1))::INT" for i in range(5)] + [f"(f1[{k + 1}] <> f2[least(p[{i + 1}], p[{j + 1}]) * 5 + greatest(p[{i + 1}], p[{j + 1}]) + 1])::INT" for k, (i, j) in enumerate(_AT)])
_FLAGS1 = "[" + ", ".join(f"list_contains(string_split(x1, ' '), '{i}-{j}')" for i, j in _AT) + "]"
_FLAGS2 = "list_transform(range(25), lambda k: list_contains(string_split(x2, ' '), (k // 5) || '-' || (k % 5)))"
GED = f"""{STRUCT}, perm AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS p FROM range(5) a(i), range(5) b(i), range(5) c(i), range(5) d(i), range(5) e(i) WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
fl AS (SELECT row_number() OVER () AS k, w, l1, l2, {_FLAGS1} AS f1, {_FLAGS2} AS f2 FROM pr), gd AS (SELECT k, any_value(w) AS w, min({_COST}) AS ged FROM fl, perm GROUP BY k)"""


@query(f"WITH {GED} SELECT CAST(ged AS BIGINT) AS ged, CAST(sum(w) AS BIGINT) AS n FROM gd GROUP BY ALL")
def ged_all_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _weighted_pairs(spark, sf_dir).select("nodes1", "edges1", "nodes2", "edges2", "w")
    return ged.decided(w).groupBy(F.col("ged").cast("long").alias("ged")).agg(F.sum("w").alias("n"))


@query(f"WITH {GED} SELECT CAST(ged AS BIGINT) AS ged, CAST(sum(w) AS BIGINT) AS n FROM gd WHERE ged <= 2 GROUP BY ALL")
def ged_range_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs within distance 2: the cheap bounds go first, the search has a bound."""
    w = _weighted_pairs(spark, sf_dir, 2).select("nodes1", "edges1", "nodes2", "edges2", "w")
    return ged.decided(w, 2).where("ged >= 0").groupBy(F.col("ged").cast("long").alias("ged")).agg(F.sum("w").alias("n"))


@query(f"WITH {STRUCT} SELECT v1, v2, greatest(v1, v2) - common + abs(e1 - e2) AS lb, count(*) AS pairs, CAST(sum(w) AS BIGINT) AS n FROM pr WHERE greatest(v1, v2) - common + abs(e1 - e2) <= 2 GROUP BY ALL")
def label_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structure pairs whose label bound is at most 2, by the prefix-filter join: how many, and how many graph pairs they stand for."""
    s = _structures(spark, sf_dir)
    own = lambda k, n: s.select(F.col("sid").alias(f"s{k}"), F.col("v").cast("long").alias(f"v{k}"), n)
    pairs = prefix_join.label_join(s.where("nq > 0"), s, 2).join(own(1, "nq"), "s1").join(own(2, "n"), "s2")
    return pairs.groupBy("v1", "v2", F.col("lb").cast("long").alias("lb")).agg(F.count("*").alias("pairs"), F.sum(F.col("nq") * F.col("n")).alias("n"))


@query(f"WITH {GED} SELECT CAST(ged AS BIGINT) AS ged, CAST(sum(w) AS BIGINT) AS n FROM gd GROUP BY ALL")
def ged_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distances of ged_all_pairs with so few assignments a task that most pairs are split into branches and decided in rounds."""
    w = _weighted_pairs(spark, sf_dir).select("nodes1", "edges1", "nodes2", "edges2", "w")
    return ged.decided(w, steps=12).groupBy(F.col("ged").cast("long").alias("ged")).agg(F.sum("w").alias("n"))


@query()
def ged_next_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(gid, after, ged): the exact distance, without a bound, of each order's path to that of the same customer's next order.

    Equal pairs of paths are searched once; those that 100 assignments do not decide are split into branches. Paths are built
    once and move as labels alone; their edges are made where pairs are searched."""
    paths = graphs.order_graphs(table(spark, sf_dir, "lineitem")).select(F.col("gid").alias("o_orderkey"), F.col("nodes").alias("nodes1"))
    next_ = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    each = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate").join(paths.hint("merge"), "o_orderkey", "left")
    pairs = each.select(F.col("o_orderkey").alias("gid"), F.lead("o_orderkey").over(next_).alias("after"), "nodes1", F.lead("nodes1").over(next_).alias("nodes2"))
    rows = written(pairs.where("after is not null and nodes1 is not null and nodes2 is not null"), "next")
    edges = {f"edges{k}": graphs.path_edges(F.size(f"nodes{k}")) for k in (1, 2)}
    d = ged.decided(rows.select("nodes1", "nodes2").distinct().withColumns(edges), steps=100).select("nodes1", "nodes2", "ged")
    return rows.join(d, ["nodes1", "nodes2"]).select("gid", "after", F.col("ged").cast("long").alias("ged"))


def _listed_sql(condition: str, limit: int, more: str = "") -> str:
    """(qid, gid, ged) of graph pairs within limit, from the structure pairs that satisfy a condition."""
    return f"""{STRUCT}{more}, perm AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS p FROM range(5) a(i), range(5) b(i), range(5) c(i), range(5) d(i), range(5) e(i) WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
fl AS (SELECT row_number() OVER () AS k, n1, n2, x1, x2, l1, l2, {_FLAGS1} AS f1, {_FLAGS2} AS f2 FROM pr WHERE {condition}),
gd AS (SELECT k, any_value(n1) AS n1, any_value(x1) AS x1, any_value(n2) AS n2, any_value(x2) AS x2, min({_COST}) AS ged FROM fl, perm GROUP BY k HAVING min({_COST}) <= {limit})
SELECT a.gid AS qid, b.gid, CAST(ged AS BIGINT) AS ged FROM gd JOIN gr a ON a.nodes = n1 AND a.edges = x1 AND a.gid % 50 = 0 JOIN gr b ON b.nodes = n2 AND b.edges = x2"""


@query(f"WITH {_listed_sql('abs(v1 - v2) <= 1', 1)}")
def ged_pairs_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, gid, ged) of the query graphs' neighbours within distance 1."""
    g = written(transitions(spark, sf_dir), "graphs")
    return ged.ged_pairs(g.where("gid % 50 = 0"), g, 1).select("qid", "gid", F.col("ged").cast("long").alias("ged"))


_CODE = "CAST(list_sum(list_transform(list_distinct(list_concat(list_concat(list_transform({l}, lambda y: y % 8), list_transform(list_filter(string_split({x}, ' '), lambda y: y <> ''), lambda y: 8 + (string_split(y, '-')[1]::INT * 5 + string_split(y, '-')[2]::INT) % 16)), list_transform(range(24, 24 + least({v}, 8)), lambda y: y::INT))), lambda y: 1::BIGINT << y)) AS BIGINT)"
_NEAR = f"bit_count(xor({_CODE.format(l='l1', x='x1', v='v1')}, {_CODE.format(l='l2', x='x2', v='v2')})) <= 2 AND ((v1 - v2) ** 2 + (e1 - e2) ** 2) / 4.0 <= 1.5"


@query(f"WITH {_listed_sql(_NEAR, 1)}")
def range_query_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole range query at threshold 1: 32-bit codes of the structure, Hamming ball, embedding filter, exact distance."""
    g = written(transitions(spark, sf_dir), "graphs")
    emb = F.array((F.col("v") / 2).cast("double"), (F.col("e") / 2).cast("double"))
    c = g.select("gid", C.structure_code(F.col("nodes"), F.col("edges")).alias("code"), emb.alias("emb"))
    mine = F.col("gid") % 50 == 0
    return lifecycle.range_query(g, g.where(mine), c, c.where(mine), 1, fine=True).select("qid", "gid", F.col("ged").cast("long").alias("ged"))


@query("SELECT 2 * count(*) AS n, 0::BIGINT AS undecided_3, 0::BIGINT AS far, 0::BIGINT AS undecided_6 FROM customer")
def ged_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graphs of 20 to 30 vertices against copies with at most three edits: distances at bounds 3 and 6.

    No copy may be farther than its edits, and no pair may be left undecided."""
    n = table(spark, sf_dir, "customer").count()
    g = augment.preferential_graphs(spark, n, sizes=(20, 30), mean=25, most_links=3)
    c = augment.similar(g, 2, 3, 5, origin=True)
    p = c.select("ops", "nodes1", "edges1", F.col("nodes").alias("nodes2"), F.col("edges").alias("edges2"))
    d = ged.decided(ged.decided(p, 3).withColumnRenamed("ged", "ged3"), 6)
    far = (F.col("ged3") < 0) | (F.col("ged3") > F.col("ops")) | (F.col("ged") != F.col("ged3"))
    return d.agg(F.count("*").alias("n"), F.count_if(F.col("ged3").isNull()).alias("undecided_3"), F.count_if(far).alias("far"), F.count_if(F.col("ged").isNull()).alias("undecided_6"))


def _attributed(w: DataFrame) -> tuple[DataFrame, assignment.CostModel]:
    """Structure pairs, as _weighted_pairs() has them, with labels as discrete attributes, and costs that make the edit cost the unit-cost distance."""
    nodes = lambda c: F.transform(c, lambda x: F.create_map(F.lit("label"), x.cast("string")))
    edges = lambda c: F.transform(c, lambda e: F.struct(e["src"].alias("src"), e["dst"].alias("dst"), F.map_from_arrays(F.array(F.lit("label")), F.array(e["label"].cast("string"))).alias("attrs")))
    model = assignment.CostModel(2, 2, 0.5, [assignment.Attribute("label", "discrete", 1, 0, 2)], [assignment.Attribute("label", "discrete", 1, 0, 2)])
    p = w.select(nodes("nodes1").alias("nodes1"), edges("edges1").alias("edges1"), nodes("nodes2").alias("nodes2"), edges("edges2").alias("edges2"), "w", "s1", "s2")
    return _dealt(p), model


def _dealt(pairs: DataFrame) -> DataFrame:
    """Pairs over as many tasks as shuffles have: they are few bytes and much work, and without a number would be put together in a few tasks."""
    return pairs.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "s1", "s2")


@query()
def bipartite_ub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(d, n): assignment upper bounds of structure pairs, labels as discrete attributes."""
    return assignment.with_attributed_distance(*_attributed(_weighted_pairs(spark, sf_dir))).groupBy(r6("d").alias("d")).agg(F.sum("w").alias("n"))


@query(f"WITH {STRUCT} SELECT CAST(sum(w) AS BIGINT) AS n, 0::BIGINT AS below, 0::BIGINT AS above_assignment FROM pr")
def upper_bound_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smaller of assignment and beam bounds: never under the exact distance, never over the assignment's alone."""
    w = _weighted_pairs(spark, sf_dir)
    p, model = _attributed(w)
    d = assignment.with_attributed_distance(assignment.with_attributed_distance(p, model).withColumnRenamed("d", "one"), model, "upper")
    exact = ged.decided(w.select("s1", "s2", "nodes1", "edges1", "nodes2", "edges2")).select("s1", "s2", "ged")
    j = d.select("s1", "s2", "w", "one", "d").join(exact, ["s1", "s2"])
    over = lambda c: F.coalesce(F.sum(F.when(c, F.col("w"))), F.lit(0)).cast("long")
    return j.agg(F.sum("w").alias("n"), over(F.col("d") < F.col("ged") - 1e-9).alias("below"), over(F.col("d") > F.col("one") + 1e-9).alias("above_assignment"))


@query()
def encoder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all transition graphs by a seeded encoder."""
    return encode.encode(transitions(spark, sf_dir), encode.make_weights(5)).select("gid", "code", F.size("emb").alias("n_emb"))


@query()
def augmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    return augment.similar(transitions(spark, sf_dir), 2, 3, 5).select("gid", "copy", "ops", "v", "e")


@query()
def generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "customer").count()
    return augment.preferential_graphs(spark, n).select("gid", "v", "e", F.size("nodes").alias("n_nodes"))


@query("WITH n AS (SELECT count(*) AS n FROM customer) SELECT n, n AS good FROM n")
def generated_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the generated graphs: all have 7 to 15 vertices with labels 0..4, a label for each, simple ascending edges inside, and each
    vertex but the first ones an edge to an earlier one."""
    g = augment.preferential_graphs(spark, table(spark, sf_dir, "customer").count())
    ends = F.forall("edges", lambda e: (e["src"] >= 0) & (e["src"] < e["dst"]) & (e["dst"] < F.col("v")))
    later = F.size(F.array_distinct(F.transform("edges", lambda e: e["dst"])))
    m = F.array_min(F.transform("edges", lambda e: e["dst"]))
    good = F.col("v").between(7, 15) & (F.size("nodes") == F.col("v")) & F.forall("nodes", lambda x: (x >= 0) & (x < 5)) & (F.size(F.array_distinct("edges")) == F.col("e")) & ends & (later == F.col("v") - m)
    return g.agg(F.count("*").alias("n"), F.count_if(good).alias("good"))


@query(f"WITH {GRAPHS}, n AS (SELECT 2 * count(*) AS n FROM gr) SELECT n, n AS good FROM n")
def augmented_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the edited copies: all lie within as many edits of their graph as were counted, and at most three."""
    g = transitions(spark, sf_dir)
    c = augment.similar(g, 2, 3, 5).select("gid", "ops", F.col("nodes").alias("nodes2"), F.col("edges").alias("edges2"))
    d = ged.decided(g.select("gid", F.col("nodes").alias("nodes1"), F.col("edges").alias("edges1")).join(c, "gid"), 8)
    return d.agg(F.count("*").alias("n"), F.count_if((F.col("ops") <= 3) & F.col("ged").between(0, F.col("ops"))).alias("good"))


@query(f"WITH {GRAPHS} SELECT count(*) AS n, count(*) AS good, 0::BIGINT AS split FROM gr")
def encoder_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the encoder: every graph has a 32-bit code and 256 numbers, and equal graphs have equal codes."""
    g = transitions(spark, sf_dir)
    e = g.select("gid", "nodes", "edges").join(encode.encode(g, encode.make_weights(5)), "gid")
    per = e.groupBy("nodes", "edges").agg(F.count("*").alias("n"), F.count_if((F.size("emb") == 256) & F.col("code").between(0, (1 << 32) - 1)).alias("good"), (F.min("code") != F.max("code")).cast("long").alias("split"))
    return per.agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("split").alias("split"))


_AROUND = "list_contains(string_split(edges, ' '), least(i, j) || '-' || greatest(i, j))"
PAGERANK = f"""WITH RECURSIVE {GRAPHS}, s AS (SELECT DISTINCT nodes, edges, v FROM gr),
ad AS (SELECT *, list_transform(range(v), lambda i: len(list_filter(range(v), lambda j: i <> j AND {_AROUND}))) AS d FROM s),
m AS (SELECT nodes, edges, v, list_transform(range(v), lambda j: list_transform(range(v), lambda i: CASE WHEN d[i + 1] = 0 THEN 1.0::DOUBLE / v WHEN i <> j AND {_AROUND} THEN 1.0::DOUBLE / d[i + 1] ELSE 0.0::DOUBLE END)) AS p FROM ad),
r AS (SELECT nodes, edges, v, p, 0 AS k, list_transform(range(v), lambda i: 1.0::DOUBLE / v) AS x FROM m
 UNION ALL SELECT nodes, edges, v, p, k + 1, list_transform(range(v), lambda j: 0.1::DOUBLE / v + 0.9::DOUBLE * list_inner_product(p[j + 1], x)) FROM r WHERE k < 20)
SELECT gr.gid, CAST(t.i AS INTEGER) AS vid, round(r.x[t.i + 1], 6) AS rank FROM gr JOIN r ON r.nodes = gr.nodes AND r.edges = gr.edges AND k = 20, range(5) t(i) WHERE t.i < gr.v"""


@query(PAGERANK)
def pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.pagerank(transitions(spark, sf_dir)).select("gid", "vid", r6("rank").alias("rank"))


# Costs of attributes, from neighbouring parts

PARTS = "pp AS (SELECT *, lag(p_brand) OVER w AS b0, lag(p_retailprice) OVER w AS r0, lag(p_size) OVER w AS s0, lag(p_name) OVER w AS n0 FROM part WINDOW w AS (PARTITION BY p_type ORDER BY p_partkey))"


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("p_type").orderBy("p_partkey")
    return table(spark, sf_dir, "part").withColumns({n: F.lag(c).over(w) for n, c in (("b0", "p_brand"), ("r0", "p_retailprice"), ("s0", "p_size"), ("n0", "p_name"))}).where("b0 is not null")


@query(f"WITH {PARTS} SELECT p_partkey, CASE WHEN p_brand = b0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE END AS cost FROM pp WHERE b0 IS NOT NULL")
def cost_node_discrete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).select("p_partkey", C.cost_discrete(F.col("p_brand"), F.col("b0"), 0.0, 2.0).alias("cost"))


@query(f"WITH {PARTS} SELECT p_partkey, round((p_retailprice - r0) * (p_retailprice - r0), 4) AS cost FROM pp WHERE b0 IS NOT NULL")
def cost_node_squared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).select("p_partkey", F.round(C.cost_squared(F.col("p_retailprice"), F.col("r0")), 4).alias("cost"))


@query(f"WITH {PARTS} SELECT p_partkey, abs(p_size - s0)::DOUBLE AS cost FROM pp WHERE b0 IS NOT NULL")
def cost_node_absolute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).select("p_partkey", C.cost_absolute(F.col("p_size"), F.col("s0")).cast("double").alias("cost"))


@query(f"WITH {PARTS} SELECT p_partkey, round(0.8 * sqrt(CASE WHEN p_brand = b0 THEN 0.0 ELSE 2.0 END + 0.3::DOUBLE * abs(p_size - s0)), 6) AS cost FROM pp WHERE b0 IS NOT NULL")
def cost_node_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = C.combine_costs([(C.cost_discrete(F.col("p_brand"), F.col("b0"), 0.0, 2.0), 1.0), (C.cost_absolute(F.col("p_size"), F.col("s0")), 0.3)], 2.0, 0.8)
    return _parts(spark, sf_dir).select("p_partkey", r6(c).alias("cost"))


SED = f"""WITH RECURSIVE {PARTS}, s AS (SELECT p_partkey, coalesce(p_name, '') AS a, coalesce(n0, '') AS b FROM pp WHERE b0 IS NOT NULL),
r AS (SELECT p_partkey, a, b, 0 AS i, list_transform(range(length(b) + 1), lambda j: 0::BIGINT) AS x FROM s
 UNION ALL SELECT p_partkey, a, b, i + 1, list_prepend(0::BIGINT, list_transform(range(1, length(b) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda h: greatest(x[h + 1], CASE WHEN b[h:h] = a[i + 1:i + 1] THEN x[h] + 1 ELSE 0 END))))) FROM r WHERE i < length(a))
SELECT p_partkey, CAST(length(a) + length(b) - 2 * x[length(b) + 1] AS BIGINT) AS cost FROM r WHERE i = length(a)"""


@query(SED)
def cost_node_sed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insert-delete distance of names: a substitution costs two."""
    @F.pandas_udf("long")
    def sed(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([ged.lcs_distance(x or "", y or "") for x, y in zip(a, b)], dtype="int64")

    return _parts(spark, sf_dir).select("p_partkey", sed("p_name", "n0").alias("cost"))


@query(f"WITH {PARTS} SELECT p_partkey, round(sqrt((p_retailprice - r0) ** 2 + (p_size - s0) ** 2), 4) AS cost FROM pp WHERE b0 IS NOT NULL")
def cost_node_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda *c: F.concat(F.lit("["), F.concat_ws(",", *(F.col(x).cast("string") for x in c)), F.lit("]"))
    a, b = C.parse_csv_doubles(text("p_retailprice", "p_size")), C.parse_csv_doubles(text("r0", "s0"))
    return _parts(spark, sf_dir).select("p_partkey", F.round(F.sqrt(C.sq_l2(a, b)), 4).alias("cost"))


@query(f"SELECT l_orderkey, l_partkey, l_suppkey, round(least(2 * pi() - abs(l_discount - l_tax) * 40, abs(l_discount - l_tax) * 40), 6) AS cost FROM lineitem")
def edge_cost_angle(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.abs(F.col("l_discount") - F.col("l_tax")) * 40
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", r6(C.angular_difference(d, F.lit(0.0))).alias("cost"))


# Windows, order and sets


@query("WITH h AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch FROM events), m AS (SELECT user_id, epoch, avg(value) OVER (PARTITION BY user_id ORDER BY epoch ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS l, avg(value) OVER (PARTITION BY user_id ORDER BY epoch ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS s FROM h) SELECT user_id, epoch, round(l, 6) AS long_mean, round(s, 6) AS short_mean, epoch >= 20 AND epoch % 5 = 0 AND l - s < 0.1 AS stop FROM m")
def early_stop_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = table(spark, sf_dir, "events").withColumn("epoch", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")).select("user_id", "epoch", F.col("value").alias("loss"))
    out = augment.trailing_stop(h, 20, 5, 0.1, 5, by="user_id")
    return out.select("user_id", "epoch", r6("long_mean").alias("long_mean"), r6("short_mean").alias("short_mean"), "stop")


@query("WITH w AS (SELECT n_nationkey AS id, 1.0 + n_regionkey AS w FROM nation), c AS (SELECT id, sum(w) OVER (ORDER BY id) / sum(w) OVER () AS hi FROM w), r AS (SELECT id, hi, coalesce(lag(hi) OVER (ORDER BY id), 0) AS lo FROM c) SELECT c_custkey AS draw, CAST(id AS BIGINT) AS id FROM customer JOIN r ON ((c_custkey * 7919) % 1000 + 0.5) / 1000.0 >= lo AND ((c_custkey * 7919) % 1000 + 0.5) / 1000.0 < hi")
def cum_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), (F.lit(1.0) + F.col("n_regionkey")).alias("w"))
    draws = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("draw"), (((F.col("c_custkey") * 7919) % 1000 + 0.5) / 1000.0).alias("u"))
    return augment.cumulative_sample(w, draws)


@query("SELECT s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY regexp_extract(s_name, '^([^0-9]*)', 1), regexp_extract(s_name, '^[^0-9]*([0-9]+)', 1)::BIGINT) AS place FROM supplier")
def natural_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.row_number().over(W.partitionBy("s_nationkey").orderBy(C.natural_key(F.col("s_name")))).cast("long").alias("place"))


@query("SELECT vec_id AS gid, label::BIGINT AS label, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) // 32 AS batch FROM embeddings")
def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rn = F.row_number().over(W.partitionBy("label").orderBy("vec_id"))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("gid"), F.col("label").cast("long").alias("label"), F.floor((rn - 1) / 32).alias("batch"))


@query("WITH a AS (SELECT DISTINCT o_custkey AS id FROM orders), b AS (SELECT c_custkey AS id FROM customer) SELECT 'intersect' AS op, count(*) AS n FROM (SELECT id FROM a INTERSECT SELECT id FROM b) UNION ALL SELECT 'union', count(*) FROM (SELECT id FROM a UNION SELECT id FROM b) UNION ALL SELECT 'except', count(*) FROM (SELECT id FROM b EXCEPT SELECT id FROM a) UNION ALL SELECT 'union_all', count(*) FROM (SELECT id FROM a UNION ALL SELECT id FROM b)")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")).distinct()
    b = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    parts = {"intersect": a.intersect(b), "union": a.union(b).distinct(), "except": b.subtract(a), "union_all": a.unionByName(b)}
    out = None
    for name, df in parts.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("op"), "n")
        out = one if out is None else out.union(one)
    return out


@query(f"WITH {CODES} SELECT qid, qid || ' ' || string_agg(gid, ' ' ORDER BY gid) AS value FROM pairs WHERE h <= 1 GROUP BY qid")
def result_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, d = sides(spark, sf_dir)
    return formats.result_lines(search.range_candidates(q, d, 1, WIDTH).select("qid", "gid"))


@query("SELECT vec_id AS gid, vec_id % 10 < 2 AS valid FROM embeddings")
def split_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("gid"), (F.col("vec_id") % 10 < 2).alias("valid"))


# Formats: what is written and read again is what was there


@query(f"WITH {GRAPHS} SELECT deg.gid, vid, label, degree FROM deg")
def gxl_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graphs with an int and a string attribute as GXL, parsed again."""
    g = transitions(spark, sf_dir)
    nodes = F.transform("nodes", lambda x, i: F.struct(F.concat(F.lit("_"), i.cast("string")).alias("id"), F.create_map(F.lit("label"), x.cast("string"), F.lit("kind"), F.concat(F.lit("k"), x.cast("string"))).alias("attrs")))
    name = lambda x: F.concat(F.lit("_"), x.cast("string"))
    edges = F.transform("edges", lambda e: F.struct(name(e["src"]).alias("src"), name(e["dst"]).alias("dst"), F.create_map(F.lit("valence"), e["label"].cast("string")).alias("attrs")))
    texts = formats.gxl_text(g.select(F.col("gid").cast("string").alias("name"), F.lit(False).alias("directed"), nodes.alias("nodes"), edges.alias("edges")))
    back = formats.gxl_graphs(texts).where("not directed")
    v = back.select(F.col("name").cast("long").alias("gid"), F.explode("nodes").alias("n"), "edges")
    own = F.filter("edges", lambda e: ((e["src"] == F.col("n.id")) | (e["dst"] == F.col("n.id"))) & (e["attrs"]["valence"] == "1"))
    return v.where(F.col("n.attrs")["kind"] == F.concat(F.lit("k"), F.col("n.attrs")["label"])).select("gid", F.substring("n.id", 2, 9).cast("long").alias("vid"), F.col("n.attrs")["label"].cast("long").alias("label"), F.size(own).cast("long").alias("degree"))


@query("SELECT s_name || '.gxl' AS name, CASE WHEN s_nationkey = 0 THEN 'NO_CLASS' ELSE 'n' || s_nationkey END AS class FROM supplier")
def cxl_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collections of suppliers written as files and read by their elements; the first nation's entries have no class."""
    path = scratch_path(spark, "collections")
    kind = F.when(F.col("s_nationkey") != 0, F.concat(F.lit("n"), F.col("s_nationkey").cast("string")))
    formats.write_cxl(table(spark, sf_dir, "supplier").select(F.concat("s_name", F.lit(".gxl")).alias("name"), kind.alias("class")), path)
    return formats.read_cxl(spark, path)


@query(f"WITH {GRAPHS} SELECT * FROM gr")
def gexf_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graphs as GEXF with the label as an attribute, parsed again; labels of one digit keep their rank."""
    g = transitions(spark, sf_dir)
    node = F.transform("nodes", lambda x, i: F.concat(F.lit('<node id="v'), i.cast("string"), F.lit('"><attvalues><attvalue for="0" value="t'), x.cast("string"), F.lit('"/></attvalues></node>')))
    edge = F.transform("edges", lambda e: F.concat(F.lit('<edge source="v'), e["dst"].cast("string"), F.lit('" target="v'), e["src"].cast("string"), F.lit('"/>')))
    head = '<gexf xmlns="http://www.gexf.net/1.2draft"><graph><attributes class="node"><attribute id="0" title="type" type="string"/></attributes><nodes>'
    text = F.concat(F.lit(head), F.array_join(node, ""), F.lit("</nodes><edges>"), F.array_join(edge, ""), F.lit("</edges></graph></gexf>"))
    return _flat(formats.gexf_graphs(g.select(F.concat(F.col("gid").cast("string"), F.lit(".gexf")).alias("name"), text.alias("value")), "type"))


@query("SELECT vec_id AS gid, CAST(list_sum(list_transform(embedding, lambda x: CAST(round(x::DOUBLE * 1000000) AS BIGINT))) AS BIGINT) AS total, CAST(list_sum(list_transform(range(32), lambda i: CASE WHEN embedding[i + 1] > 0 THEN (1::BIGINT << i) ELSE 0::BIGINT END)) AS BIGINT) AS code FROM embeddings")
def index_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inverted index as text files with their header lines, read again."""
    path = scratch_path(spark, "index")
    formats.write_index(codes(spark, sf_dir, 32), path)
    return formats.read_index(spark, path).select("gid", "code", F.aggregate("emb", F.lit(0).cast("long"), lambda a, x: a + F.round(x * 1000000).cast("long")).alias("total"))


@query("SELECT CAST(list_sum(list_transform(range(32), lambda i: CASE WHEN embedding[i + 1] > 0 THEN (1::BIGINT << i) ELSE 0::BIGINT END)) AS BIGINT) AS code, vec_id AS gid FROM embeddings")
def index_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inverted index as Parquet, sorted by code, read again."""
    path = scratch_path(spark, "index")
    formats.write_index_table(codes(spark, sf_dir, 32), path)
    return spark.read.parquet(path).select("code", "gid")


@query("SELECT l_orderkey AS gid, l_suppkey AS qid, CAST(l_linenumber AS INTEGER) AS ged FROM lineitem")
def truth_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground truth lines written and read."""
    path = scratch_path(spark, "truth")
    c = lambda x: F.col(x).cast("string")
    table(spark, sf_dir, "lineitem").select(F.concat_ws(" ", c("l_orderkey"), c("l_suppkey"), c("l_linenumber")).alias("value")).write.text(path)
    return formats.read_truth(spark, path)


@query(f"WITH {CODES} SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY sq, gid) AS rank, gid FROM pairs WHERE h <= 2")
def result_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results in order of distance as lines, written and read again: ranks are places in a line."""
    path = scratch_path(spark, "results")
    formats.result_lines(search.range_candidates(*sides(spark, sf_dir), 2, WIDTH), "sq_l2").select("value").write.text(path)
    return formats.read_results(spark, path).select("qid", F.col("rank").cast("long").alias("rank"), "gid")


@query("SELECT vec_id AS gid, CAST(list_sum(list_transform(range(32), lambda i: CASE WHEN embedding[i + 1] > 0 THEN CAST(round(log2(i + 2) * 1000000) AS BIGINT) ELSE 0::BIGINT END)) AS BIGINT) AS weight FROM embeddings")
def weight_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weight of each embedding's code, in millionths, by bit weights that were written and read again."""
    path = scratch_path(spark, "weights")
    formats.write_numbers(spark.createDataFrame(list(enumerate(C.bit_weights("log", 32))), "pos int, x double"), path)
    weights = formats.read_numbers(spark, path).select("pos", F.round(F.col("x") * 1000000).cast("long").alias("w"))  # 32 rows
    bits = codes(spark, sf_dir, 32).select("gid", F.explode_outer(C.set_bits(F.col("code"), 32)).alias("pos"))
    return bits.join(F.broadcast(weights), "pos", "left").groupBy("gid").agg(F.coalesce(F.sum("w"), F.lit(0)).cast("long").alias("weight"))
