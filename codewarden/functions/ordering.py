"""Order-dependent columns without one task per group.

A plain ``Window.partitionBy(key)`` puts a whole key into one task. Here a key is cut along its order,
into range partitions or blocks of positions; each piece is a window partition of its own, and only
one summary row per piece is ordered per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codewarden.functions.sizes import broadcast_if_small
from codewarden.session import cut_lineage


def range_rank(df: DataFrame, keys: list[str], order: list[Column], out: str) -> DataFrame:
    """1-based position of each row within ``keys`` in the given order.

    Rows are range-partitioned by key and order and written once with the number of their partition, so
    that a key of any size spans as many partitions as it needs, whatever makes it large. One count per
    (key, partition) gives each partition's offset; rows are then numbered inside their partition.
    Keys must not be NULL.
    """
    names = [f"_o{i}" for i in range(len(order))]
    ranged = df.withColumns(dict(zip(names, order))).repartitionByRange(*keys, *names)
    stored = cut_lineage(ranged.withColumn("_part", F.spark_partition_id()))
    totals = stored.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    offsets = totals.select(*keys, "_part", F.coalesce(before, F.lit(0)).alias("_before"))
    local = stored.withColumn("_local", F.row_number().over(W.partitionBy(*keys, "_part").orderBy(*names)))
    joined = local.join(offsets, [*keys, "_part"])
    return joined.select(*df.columns, (F.col("_before") + F.col("_local")).cast("bigint").alias(out))


BLOCK = "_block"


def with_blocks(df: DataFrame, pos: str, rows: int = 100_000) -> DataFrame:
    """Adds the block number of each row. The functions below keep it, so that windows and joins of
    several steps share one hash partitioning by (keys, block) and the rows move once."""
    return df.withColumn(BLOCK, F.floor(F.col(pos) / rows))


def carry_forward(df: DataFrame, keys: list[str], pos: str, states: dict[str, Column]) -> DataFrame:
    """Per row, the last non-NULL value of each state at or before it, in ``pos`` order within ``keys``.

    ``df`` has blocks; keys must not be NULL.
    """
    cut = df.withColumns({f"_m_{name}": value for name, value in states.items()})
    by_block = W.partitionBy(*keys, BLOCK).orderBy(pos).rowsBetween(W.unboundedPreceding, 0)
    local = cut.withColumns({name: F.last(f"_m_{name}", ignorenulls=True).over(by_block) for name in states})
    ends = cut.groupBy(*keys, BLOCK).agg(
        *[
            F.max_by(f"_m_{name}", F.when(F.col(f"_m_{name}").isNotNull(), F.col(pos))).alias(f"_e_{name}")
            for name in states
        ]
    )
    earlier = W.partitionBy(*keys).orderBy(BLOCK).rowsBetween(W.unboundedPreceding, -1)
    carried = ends.select(
        *keys, BLOCK, *[F.last(f"_e_{name}", ignorenulls=True).over(earlier).alias(f"_c_{name}") for name in states]
    )
    joined = local.join(carried, [*keys, BLOCK], "left")
    return joined.select(*df.columns, *[F.coalesce(F.col(n), F.col(f"_c_{n}")).alias(n) for n in states])


def block_rank(df: DataFrame, keys: list[str], order: list[Column], out: str) -> DataFrame:
    """1-based position of each row within ``keys`` in the given order, which goes up with the blocks of ``df``.

    Rows are numbered inside their block, where the steps before have left them, and written once. Only a key that
    meets a block after its first has an offset there, and rows are joined with those; the block is dropped. Keys must
    not be NULL.
    """
    here = W.partitionBy(*keys, BLOCK).orderBy(*order)
    stored = cut_lineage(df.withColumn("_local", F.row_number().over(here)))
    totals = stored.groupBy(*keys, BLOCK).agg(F.max("_local").alias("_n"))
    before = F.sum("_n").over(W.partitionBy(*keys).orderBy(BLOCK).rowsBetween(W.unboundedPreceding, -1))
    offsets = cut_lineage(totals.withColumn("_before", before.cast("bigint")).where("_before IS NOT NULL").drop("_n"))
    joined = stored.join(broadcast_if_small(offsets), [*keys, BLOCK], "left")
    kept = [c for c in df.columns if c != BLOCK]
    return joined.select(*kept, (F.coalesce(F.col("_before"), F.lit(0)) + F.col("_local")).cast("bigint").alias(out))


def count_since(df: DataFrame, keys: list[str], pos: str, flag: Column, start: Column, out: str) -> DataFrame:
    """``out`` = last non-NULL ``start`` at or before a row, plus the flagged rows after it up to this row.

    One local pass and one summary row per block: the block's count, and its last start relative to it.
    """
    cut = df.withColumn("_one", F.when(flag, F.lit(1)).otherwise(F.lit(0))).withColumn("_start", start)
    by_block = W.partitionBy(*keys, BLOCK).orderBy(pos).rowsBetween(W.unboundedPreceding, 0)
    counted = cut.withColumn("_n", F.sum("_one").over(by_block))
    relative = counted.withColumn("_rel", F.col("_start") - F.col("_n"))
    local = relative.withColumn("_base", F.last("_rel", ignorenulls=True).over(by_block))
    ends = relative.groupBy(*keys, BLOCK).agg(
        F.sum("_one").alias("_sum"), F.max_by("_rel", F.when(F.col("_rel").isNotNull(), F.col(pos))).alias("_end")
    )
    earlier = W.partitionBy(*keys).orderBy(BLOCK).rowsBetween(W.unboundedPreceding, -1)
    offsets = ends.withColumn("_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))
    carried = offsets.withColumn("_carry", F.last(F.col("_end") - F.col("_before"), ignorenulls=True).over(earlier))
    joined = local.join(carried.select(*keys, BLOCK, "_before", "_carry"), [*keys, BLOCK], "left")
    value = F.coalesce(
        F.col("_base") + F.col("_n"), F.col("_carry") + F.col("_before") + F.col("_n"), F.col("_before") + F.col("_n")
    )
    return joined.select(*df.columns, value.alias(out))
