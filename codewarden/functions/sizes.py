"""Broadcast only what was measured to be small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_LIMIT = 64 << 20


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """``df`` with a broadcast hint when its rows, written as JSON, fit the limit; else unchanged.

    The measurement is one aggregate over ``df``; callers pass sides that are cheap to compute twice. Without the hint the join is a
    shuffle join, which adaptive execution splits where a key is hot.
    """
    return F.broadcast(df) if measured_bytes(df) <= limit else df


def measured_bytes(df: DataFrame) -> int:
    """Bytes of the rows, written as JSON: one aggregate over ``df``."""
    return df.select(F.sum(F.octet_length(F.to_json(F.struct("*")))).alias("n")).first()["n"] or 0


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of ``df`` (no job)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread_if_few(df: DataFrame, *keys: str, partition_bytes: int = 16 << 20) -> DataFrame:
    """Repartition by ``keys`` when the input is too small to fill the cluster by itself.

    A small table in one file is one task, however many cores wait; scanning it is CPU-bound, so moving
    it once pays. A table with at least ``partition_bytes`` per core is returned as it is: its files
    give enough tasks, and contents of that size must not be shuffled. ``keys`` should be unique per
    row, so that no partition gets a hot key.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if estimated_bytes(df) >= cores * partition_bytes:
        return df
    return df.repartition(2 * cores, *keys)


def spread_rows(df: DataFrame, *keys: str, rows: int = 1 << 20) -> DataFrame:
    """A table as read, spread as :func:`spread_if_few` does and also where its partitions hold more than ``rows``.

    Numbers compress so well that one split of a file holds many million rows, and what sorts them (an aggregate over
    texts does) takes memory by the row. The count reads the files' footers only. Tables of contents have few rows a
    partition and are not moved.
    """
    few = spread_if_few(df, *keys)
    pieces = -(-df.count() // rows)
    return df.repartition(pieces, *keys) if pieces > few.rdd.getNumPartitions() else few
