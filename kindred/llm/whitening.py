"""Whitening of embeddings on a grid of whole numbers.

Each entry c becomes x = floor(64 c) + 1000000. Sums of x are exact, so a row can be centred exactly: n x - S is
a whole number for each dimension, and its quotient by n is rounded once. The covariance is the Gramian of
these rows (RowMatrix, summed on the executors) over n; its eigenvectors are taken on the driver, where only
matrices of the number of dimensions lie. Means, axes and scales are broadcast, and every row is
projected in Arrow batches. The whitened rows are stored, and their own covariance, centred again, is held against
the identity.

Vectors that are null, or hold null or non-finite entries, take no part; neither do empty ones and those whose
number of entries is not the commonest (the largest of several such): a matrix has one number of columns. Null
and repeated ids are rows like others. Entries are held within -2**46 and 2**46, so that 64 c stays exact. A deviation
beyond the range of a long is null. Components on which the rows do not differ (an eigenvalue of at most RANK times the
largest) cannot be scaled to variance one: their whitened value is null, and the identity error leaves them out;
without any other the error is null. Without rows the result is empty. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
RANK = 1e-10
EDGE = float(1 << 46)


def grid(vectors: DataFrame) -> DataFrame:
    """vec_id and x (array<long>) of the vectors that take part, whatever their length."""
    ok = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    held = lambda c: F.greatest(F.least(c.cast("double"), F.lit(EDGE)), F.lit(-EDGE))
    x = F.transform("embedding", lambda c: F.floor(held(c) * SCALE).cast("long") + SHIFT)
    return vectors.where(ok).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))


def gramian(rows: DataFrame, column: str) -> np.ndarray:
    """Sum of the outer products of a column of arrays of doubles, computed on the executors."""
    v = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(column).alias("v")), "v")
    return RowMatrix(v).computeGramianMatrix().toArray()


def _sums(rows: DataFrame, column: str, size: int, whole: bool = False) -> list:
    """Sums of an array column's places: `size` numbers. Those of whole numbers are exact: high and low parts are summed apart."""
    c = F.col("col")
    parts = [F.sum(F.shiftright(c, 20)), F.sum(c.bitwiseAND(F.lit((1 << 20) - 1)))] if whole else [F.sum(c)]
    got = {r[0]: (r[1] << 20) + r[2] if whole else r[1] for r in rows.select(F.posexplode(column)).groupBy("pos").agg(*parts).collect()}
    return [got[k] for k in range(size)]


def _signed(vectors: np.ndarray) -> np.ndarray:
    """Columns whose entry of largest size is positive."""
    return vectors * np.where(np.take_along_axis(vectors, np.abs(vectors).argmax(axis=0)[None], 0) < 0, -1.0, 1.0)


def differences(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exact: as longs, or as Python's whole numbers where they could exceed a long."""
    if max(n * (int(np.abs(x).max(initial=0)) + 1), *map(abs, sums)) < 1 << 62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def deviations(d: np.ndarray) -> list:
    """Sums of squares by row, exact; None beyond a long."""
    if d.dtype != object and int(np.abs(d).max(initial=0)) ** 2 * d.shape[1] < 1 << 63:
        return (d * d).sum(axis=1).tolist()
    return [v if v < 1 << 63 else None for v in (sum(a * a for a in row) for row in d.tolist())]


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each vector and component."""
    spark = vectors.sparkSession
    every = written(grid(vectors), "grid")
    most = every.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if most is None:
        return spark.createDataFrame([], schema)
    size, n = most["d"], most["n"]
    rows = every.where(F.size("x") == size)
    sums = _sums(rows, "x", size, whole=True)

    shared = spark.sparkContext.broadcast((n, sums))  # a number a dimension

    def centre(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, sums = shared.value
        for b in batches:
            if len(b):
                yield pd.DataFrame({"y": list((differences(np.stack(b.x.to_numpy()), n, sums) / n).astype(float))})

    cov = gramian(rows.select("x").mapInPandas(centre, "y array<double>"), "y") / n
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], _signed(axes[:, ::-1])
    m = min(components, size)
    trace = float(np.trace(cov))
    usable = values[:m] > RANK * max(values[0], 0)
    scaled = axes[:, :m][:, usable] / np.sqrt(values[:m][usable])
    axis = spark.sparkContext.broadcast(scaled)  # at most `components` vectors

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, sums = shared.value
        for b in batches:
            if len(b):
                d = differences(np.stack(b.x.to_numpy()), n, sums)
                z = (d / n).astype(float) @ axis.value
                yield pd.DataFrame({"vec_id": b.vec_id.astype("Int64"), "deviation": pd.array(deviations(d), "Int64"), "z": list(z)})

    done = written(rows.mapInPandas(project, "vec_id long, deviation long, z array<double>"), "whitened")
    error = None
    if usable.any():
        mean = [s / n for s in _sums(done, "z", int(usable.sum()))]
        back = done.select(F.zip_with("z", F.array(*map(F.lit, mean)), lambda a, b: a - b).alias("z"))
        error = float(np.abs(gramian(back, "z") / n - np.eye(int(usable.sum()))).max())

    at = np.cumsum(usable)
    each = [
        F.struct(
            F.lit(k + 1).cast("int").alias("component"),
            (F.element_at("z", int(at[k])) if usable[k] else F.lit(None)).cast("double").alias("whitened"),
            F.lit(float(values[k]) / trace if trace > 0 else None).cast("double").alias("explained"),
        )
        for k in range(m)
    ]
    out = done.select("vec_id", "deviation", F.explode(F.array(*each)).alias("e"))
    return out.select("vec_id", F.col("e.component").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", F.col("e.whitened").alias("whitened"), F.col("e.explained").alias("explained"), F.lit(error).cast("double").alias("identity_error"))


def op13_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
