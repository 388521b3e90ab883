"""Mixing of sources to target weights by a time-varying curriculum.

A source has a weight and, by its place in the order of sources, a schedule: how strongly the run draws on it
from the start (time 0) to the end (time 1), as knots of a piecewise linear curve. The schedule's integral says
which part of the source's target is due by a time. A source's documents stand in one shuffled order, pass after
pass; the words before a document are the demand that it waits for, and inverting the integral gives the time at
which the run reaches it. Times become positions in words of the whole mix, and documents are range-sorted by them.

Targets: the sources share ``share`` of all sizes by weight, but none gets more than ``most`` times its own size;
what it can't take is shared again by weight until no target is above. Each such round reads one row per source,
in whole numbers, and only two sums reach the driver.

Words before a document are summed within range partitions of (source, shuffled order) and shifted by one row per
source and partition, so neither a hot source nor one id with many rows is a group. Texts are never moved, only
their sizes.

Defined results: a null or empty text has size 0 and takes no words; null sources are one source, the last;
repeated rows are documents of their own, next to each other; null ids are shuffled as one id; an empty table
gives no rows; other columns are ignored. A source without words has target 0.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codewarden.functions.ordering import range_rank
from codewarden.session import cut_lineage

WEIGHTS = (5, 2, 1)
#: Schedules as (time, strength) knots, taken in turn like the weights: strong sources early, weak ones late.
SHAPES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 0.5), (0.5, 1.5), (1.0, 0.5)), ((0.0, 0.5), (1.0, 1.5)))
_WORD = r"[^\x20\x09-\x0D]+"


def integrated(shape: Sequence[tuple[float, float]]) -> list[tuple[float, float, float, float]]:
    """(time, part due, strength, slope) where each piece of a schedule begins; at time 1 the whole is due."""
    times, heights = zip(*shape)
    if times[0] != 0 or times[-1] != 1 or any(a >= b for a, b in zip(times, times[1:])) or min(heights) < 0 or max(heights) == 0:
        raise ValueError("a schedule leads from time 0 to time 1, ascending, and is nowhere negative nor zero throughout")
    areas = [(t1 - t0) * (h0 + h1) / 2 for t0, t1, h0, h1 in zip(times, times[1:], heights, heights[1:])]
    whole, due, out = sum(areas), 0.0, []
    for t0, t1, h0, h1, area in zip(times, times[1:], heights, heights[1:], areas):
        out.append((t0, due / whole, h0 / whole, (h1 - h0) / (t1 - t0) / whole))
        due += area
    return out


def _by_piece(value: Column, pieces: list, starts: int, each) -> Column:
    """``each(piece)`` of the last piece whose start (its ``starts``-th number) is at or before ``value``."""
    out = each(pieces[0])
    for piece in pieces[1:]:
        out = F.when(value >= F.lit(piece[starts]), each(piece)).otherwise(out)
    return out


def part_due(time: Column, shape) -> Column:
    """The schedule's integral from time 0."""

    def each(piece):
        start, due, height, slope = piece
        x = time - F.lit(start)
        return F.lit(due) + F.lit(height) * x + F.lit(slope / 2) * x * x

    return _by_piece(time, integrated(shape), 0, each)


def time_of(part: Column, shape) -> Column:
    """When ``part`` (0 to 1) of a source's target is due: the inverse of :func:`part_due`."""

    def each(piece):
        start, due, height, slope = piece
        c = part - F.lit(due)
        root = F.sqrt(F.greatest(F.lit(0.0), F.lit(height * height) + F.lit(2 * slope) * c))
        return F.when(c <= 0, F.lit(start)).otherwise(F.lit(start) + F.lit(2.0) * c / (F.lit(height) + root))

    return _by_piece(part, integrated(shape), 1, each)


def targets(sizes: DataFrame, weights: Sequence[int], share: Fraction, most: Fraction) -> DataFrame:
    """source, source_size, turn, target of ``sizes(source, source_size)``; ``turn`` is the place in the weights' cycle."""
    order = [F.col("source").isNull(), F.col("source")]
    ranked = range_rank(sizes.withColumn("_all", F.lit(0)), ["_all"], order, "_rank")
    turn = ((F.col("_rank") - 1) % len(weights)).cast("int")
    weight = F.get(F.array(*map(F.lit, weights)), F.col("turn"))
    stored = cut_lineage(ranked.select("source", "source_size", turn.alias("turn")).withColumn("weight", weight))
    exact = lambda x: F.lit(str(x)).cast("decimal(38,0)")
    total = stored.agg(F.sum("source_size")).first()[0] or 0
    full, level = None, Fraction(0)
    while True:
        above = F.col("weight") * exact(level.numerator * most.denominator) > F.col("source_size") * exact(most.numerator * level.denominator)
        row = stored.agg(F.sum(F.when(above, F.col("source_size"))).alias("full"), F.sum(F.when(~above, F.col("weight"))).alias("open")).first()
        if (row["full"] or 0) == full or not row["open"]:
            break
        full = row["full"] or 0
        level = (share * total - most * full) / row["open"]
    own = (F.col("weight") * exact(level.numerator)).cast("double") / F.lit(float(level.denominator))
    cap = (F.col("source_size") * F.lit(most.numerator)).cast("double") / F.lit(float(most.denominator))
    return cut_lineage(stored.select("source", "source_size", "turn", F.when(above, cap).otherwise(own).alias("target")))


def mix(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    share: str | float = "1.5",
    most: str | float = "2",
    shapes=SHAPES,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, taken, positions; range-sorted by its first position.

    ``taken`` counts the words of all passes. ``positions`` has the place of each pass in the mix, in words from its
    start; null for a pass that does not reach the document.
    """
    share, most = Fraction(str(share)), Fraction(str(most))
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(_WORD)), F.lit(0)).cast("long")
    # Fixed value: 15 digits of a digest of the id; the same shuffled order on every engine and in every run.
    shuffled = F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), shuffled.alias("_at"))
    keys = [F.col("source").isNull().alias("_none"), F.col("source"), F.col("_at"), F.col("doc_id"), F.col("size")]
    ranged = own.withColumn("_salt", F.monotonically_increasing_id()).repartitionByRange(*keys, F.col("_salt"))
    stored = cut_lineage(ranged.withColumn("_part", F.spark_partition_id()))

    parts = cut_lineage(stored.groupBy("source", "_part").agg(F.sum("size").alias("_sum")))
    sources = targets(parts.groupBy("source").agg(F.sum("_sum").alias("source_size")), weights, share, most)
    earlier = W.partitionBy("source").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = parts.withColumn("_offset", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    known = offsets.join(sources, same(offsets, sources)).select(offsets["source"], "_part", "_offset", "source_size", "turn", "target")

    inside = W.partitionBy("source", "_part").orderBy("_at", "doc_id", "size", "_salt").rowsBetween(W.unboundedPreceding, -1)
    local = stored.withColumn("_before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = local.join(known, same(local, known) & (local["_part"] == known["_part"])).select(
        local["doc_id"], local["source"], "size", "source_size", "target", "turn", "_at", (F.col("_offset") + F.col("_before")).alias("_before")
    )
    wanted = F.floor(F.col("target") + 0.5)
    totals = dict(sources.groupBy("turn").agg(F.sum(wanted)).collect())  # at most one row per weight

    def place(demand: Column) -> Column:
        part = demand / F.col("_wanted")
        time = time_of(part, shapes[0])
        for turn in range(1, len(weights)):
            time = F.when(F.col("turn") == turn, time_of(part, shapes[turn % len(shapes)])).otherwise(time)
        return F.when(demand < F.col("_wanted"), time)

    def position(time: Column) -> Column:
        out = F.lit(0.0)
        for turn, words in sorted(totals.items()):
            out = out + F.lit(float(words)) * part_due(time, shapes[turn % len(shapes)])
        return F.floor(out)

    demands = [F.col("_before") + F.col("source_size") * k for k in range(ceil(most))]
    taken = sum((F.greatest(F.lit(0), F.least(F.col("_wanted") - d, F.col("size"))) for d in demands), F.lit(0))
    timed = joined.withColumn("_wanted", wanted).withColumns({f"_time{k}": place(d) for k, d in enumerate(demands)} | {"taken": taken.cast("long")})
    placed = timed.select(
        "doc_id", "source", "size", "source_size", "target", "taken", F.array(*[position(F.col(f"_time{k}")) for k in range(len(demands))]).alias("positions"), "_at"
    )
    return placed.orderBy(F.get("positions", F.lit(0)).asc_nulls_last(), "_at", "doc_id").drop("_at")
