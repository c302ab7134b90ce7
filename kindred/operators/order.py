"""Places in a total order over a whole table, without a window in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import written


def ranges(df: DataFrame, *order: Column) -> DataFrame:
    """df as a stored table, dealt in ranges of the order, with `at`: ascending along the whole order, its high bits (at >> 33) the range.

    Rows equal in the order must be interchangeable."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *order, F.xxhash64(*df.columns))  # rows equal in the order are dealt by the rest
    return written(dealt.sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "ordered")


def numbered(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """df with a long column `name`: 1, 2, 3 ... along the order. One row a range is summed in one task."""
    rows = ranges(df, *order)
    part = F.shiftright("at", 33)
    sizes = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = (F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias(name)
    return rows.withColumn("part", part).join(F.broadcast(before), "part").select(*df.columns, place)  # as many rows as there are ranges
