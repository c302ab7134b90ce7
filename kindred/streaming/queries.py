"""A stream of query codes against a stored index: stateless, so it needs no watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.search import flips


def range_stream(queries: DataFrame, codes: DataFrame, radius: int, width: int) -> DataFrame:
    """(qid, gid, h) for a streaming DataFrame queries (gid, code): each ball is enumerated and joined on the code."""
    masks = F.array(*[F.lit(m).cast("long") for m in flips(radius, width)])
    q = queries.select(F.col("gid").alias("qid"), F.col("code").alias("qcode"), F.explode(masks).alias("mask"))
    probes = q.select("qid", F.col("qcode").bitwiseXOR(F.col("mask")).alias("code"), F.bit_count("mask").alias("h"))
    return probes.join(codes.select("code", "gid"), "code").select("qid", "gid", "h")
