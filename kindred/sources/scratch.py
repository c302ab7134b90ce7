"""Tables that one part of a query writes and another reads."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder named in spark.checkpoint.dir, which all executors share.

    Where that is unset a temporary folder serves a local master alone."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        base = "file://" + tempfile.mkdtemp(prefix="kindred-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in that folder: it is computed once, cuts lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_in_buckets(df: DataFrame, name: str, columns: list[str], buckets: int) -> DataFrame:
    """df as a table in that folder, dealt and sorted by columns: joins on them move only their other side."""
    spark, path, table = df.sparkSession, scratch_path(df.sparkSession, name), f"kindred_{name}_{uuid.uuid4().hex}"
    dealt = df.repartition(buckets, *columns)
    dealt.write.bucketBy(buckets, *columns).sortBy(*columns).option("path", path).format("parquet").saveAsTable(table)
    out = spark.table(table)
    out.schema  # resolved: it reads the files by their paths from here on
    spark.sql(f"DROP TABLE {table}")  # the name alone; the files stay
    return out
