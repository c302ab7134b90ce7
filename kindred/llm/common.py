"""What the operators of this subpackage share: scratch tables and Arrow batch helpers."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..sources.scratch import scratch_path as new_path

ROWS = 256  # rows handled at once inside a Python worker; texts can be long
MODEL: dict = {}  # the one word cache that a Python worker keeps, for whichever operator ran there last


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """df as a table in the shared folder: it cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kindred_path = path
    return out


def written_in_buckets(df: DataFrame, name: str, column: str, buckets: int, codec: str = "zstd") -> DataFrame:
    """df as a table in the shared folder, dealt by a hash of a column without a shuffle: joins on that column move
    only their other side, if it has the same number of partitions."""
    spark = df.sparkSession
    path, table = new_path(spark, name), f"kindred_{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, column).option("compression", codec).option("path", path).format("parquet").saveAsTable(table)
    out = spark.table(table)
    out.schema  # resolved: it reads the files by their paths from here on
    spark.sql(f"DROP TABLE {table}")  # the name alone; the files stay
    out._kindred_path = path
    return out


def kept_path(df: DataFrame, of: DataFrame) -> DataFrame:
    """df, which reads the table of written() named by `of` and is dropped with it."""
    df._kindred_path = of._kindred_path
    return df


def drop(df: DataFrame) -> None:
    """Deletes a table of written() that nothing reads any more."""
    path = getattr(df, "_kindred_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def arrow(rows: list[list], schema: pa.Schema) -> pa.RecordBatch:
    """rows: one list per column."""
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema)], schema=schema)


def per_worker(cache: dict, key, make: Callable):
    """An object that a Python worker makes once: models and word caches."""
    if key not in cache:
        _empty(cache)
        cache[key] = make()
    return cache[key]


def _empty(cache: dict) -> None:
    if cache:
        cache.clear()
        gc.collect()  # a model and its caches may hold each other


def release() -> None:
    """Frees the word cache that an earlier operator left in this Python worker, and what Arrow keeps for later."""
    _empty(MODEL)
    pa.default_memory_pool().release_unused()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
