"""Quality of retrieval: every query of the truth counts, also those with nothing relevant or nothing returned."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def per_query(queries: DataFrame, truth: DataFrame, results: DataFrame) -> DataFrame:
    """(qid, n_truth, n_result, n_both, p, r, f1) for each qid of queries; truth and results are (qid, gid)."""
    both = truth.select("qid", "gid", F.lit(1).alias("t")).distinct().join(results.select("qid", "gid", F.lit(1).alias("s")).distinct(), ["qid", "gid"], "full")
    sums = both.groupBy("qid").agg(F.count("t").alias("n_truth"), F.count("s").alias("n_result"), F.sum(F.when(F.col("t").isNotNull() & F.col("s").isNotNull(), 1).otherwise(0)).alias("n_both"))
    q = queries.select("qid").distinct().join(sums, "qid", "left").na.fill(0, ["n_truth", "n_result", "n_both"])
    none = (F.col("n_truth") == 0) & (F.col("n_result") == 0)
    p = F.when(none, 1.0).when(F.col("n_result") == 0, 0.0).otherwise(F.col("n_both") / F.col("n_result"))
    r = F.when(none, 1.0).when(F.col("n_truth") == 0, 0.0).otherwise(F.col("n_both") / F.col("n_truth"))
    q = q.withColumn("p", p).withColumn("r", r)
    return q.withColumn("f1", F.when(F.col("p") * F.col("r") == 0, 0.0).otherwise(2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))))


def macro(per: DataFrame, only_relevant: bool = False) -> DataFrame:
    """Means over queries; with only_relevant those without truth do not count."""
    rows = per.where("n_truth > 0") if only_relevant else per
    return rows.agg(
        F.avg("p").alias("precision"), F.avg("r").alias("recall"), F.avg("f1").alias("f1"), F.avg("n_result").alias("mean_result"), F.sum(F.when(F.col("n_both") == 0, 1).otherwise(0)).alias("n_zero"), F.count("*").alias("n_queries")
    )


def precision_at_k(queries: DataFrame, ranked: DataFrame, k: int) -> DataFrame:
    """(qid, p_at_k): the share of the first k results whose competition rank rk in the truth is at most k, so that ties
    with the k-th distance count. ranked: (qid, gid, rank, rk) of results."""
    hits = ranked.where((F.col("rank") <= k) & (F.col("rk") <= k)).groupBy("qid").agg(F.count("*").alias("n"))
    return queries.select("qid").distinct().join(hits, "qid", "left").select("qid", (F.coalesce("n", F.lit(0)) / k).alias("p_at_k"))


def tie_adjusted(ranked: DataFrame) -> DataFrame:
    """(qid, pos, arank): the competition rank rk of each result, its k-th repetition raised by k - 1 in result order."""
    j = ranked.select("qid", F.col("rank").alias("pos"), "rk")
    return j.select("qid", "pos", (F.col("rk") + F.row_number().over(W.partitionBy("qid", "rk").orderBy("pos")) - 1).alias("arank"))


def spearman(adjusted: DataFrame) -> DataFrame:
    """(qid, rho): correlation of result positions with re-ranked adjusted ranks."""
    r = adjusted.select("qid", F.row_number().over(W.partitionBy("qid").orderBy("pos")).alias("x"), F.row_number().over(W.partitionBy("qid").orderBy("arank", "pos")).alias("y"))
    n = F.count("*")
    return r.groupBy("qid").agg(F.when(n > 1, 1 - 6 * F.sum((F.col("x") - F.col("y")) * (F.col("x") - F.col("y"))) / (n * (n * n - 1))).alias("rho"))


def kendall(adjusted: DataFrame) -> DataFrame:
    """(qid, tau): concordant less discordant pairs over all pairs; a query's k results meet each other."""
    a = adjusted.select("qid", F.col("pos").alias("p1"), F.col("arank").alias("r1"))
    b = adjusted.select("qid", F.col("pos").alias("p2"), F.col("arank").alias("r2"))
    return a.join(b, "qid").where("p1 < p2").groupBy("qid").agg((F.sum(F.signum((F.col("r2") - F.col("r1")).cast("double"))) / F.count("*")).alias("tau"))


def confusion(pairs: DataFrame, top: int = 11, n: str | None = None) -> DataFrame:
    """(ged, ham, n): counts of distances against code distances clamped to top. n: a column of how many pairs a row stands for."""
    return pairs.where(F.col("ged").between(0, top)).groupBy("ged", F.least(F.col("h"), F.lit(top)).alias("ham")).agg((F.sum(n) if n else F.count("*")).alias("n"))


def mean_squared_error(pairs: DataFrame, limit: float) -> DataFrame:
    """mse of true distance t against estimate est, which is clipped at limit."""
    gap = F.col("t") - F.least(F.col("est"), F.lit(limit))
    return pairs.agg(F.avg(gap * gap).alias("mse"), F.count("*").alias("n"))
