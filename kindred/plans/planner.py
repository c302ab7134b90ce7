"""Choices that depend on the data's size."""

from __future__ import annotations

from math import comb

from pyspark.sql import DataFrame

BROADCAST_ROWS = 100_000  # of a few numbers each; beyond that a side is not broadcast
SCAN_ROWS = 200_000  # vectors that stated queries are compared with one by one
PROBES = 2048  # masks that a query may be exploded into


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether df has at most so many rows; it reads no further than that."""
    return df.limit(rows + 1).count() <= rows


def ball_size(radius: int, width: int) -> int:
    return sum(comb(width, i) for i in range(min(radius, width) + 1))


def ball_strategy(codes: DataFrame, radius: int, width: int) -> str:
    """probe where the ball has fewer codes than the table and fits an explode; else a multi-index, built for this search."""
    size = ball_size(radius, width)
    return "probe" if size <= PROBES and not small_enough(codes.select("code").distinct(), size) else "index"
