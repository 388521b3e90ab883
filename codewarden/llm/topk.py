"""Exact top-k inner products: norm-sorted candidates, SVD-rotated partial sums, Cauchy-Schwarz bounds.

Candidates lie in blocks by descending length. Every query first meets the block of the longest vectors,
which gives it a score to beat; a later block whose longest vector cannot reach that score is not visited.
Inside a block the product over the first rotated coordinates plus the product of the residual lengths
bounds the score, and only what can still win is scored exactly, in integers: in doubles where products stay below
2**53, else in whole numbers of any size. Lengths and bounds are doubles.

Queries and candidates are both dealt into cells of bounded size, so neither is broadcast.

Defined results: a vector that is null, empty or holds a null or non-finite component takes no part; shorter
vectors count as filled with zeros; of repeated ids the smallest vector counts; ties go to the smaller id;
components and scores beyond 64 bits are the largest such numbers; fewer candidates than ``k`` are all returned; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from operator import mul

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codewarden.llm.text import map_rows
from codewarden.session import cut_lineage

BLOCK, QUERIES, STEP = 8192, 2048, 512
_EPS = 1e-6


def quantized(vectors: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v (floor(scale * x) as bigints), norm2, of the vectors that take part."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fine = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where((F.size("v") > 0) & ~bad & F.col("vec_id").isNotNull())
    most = float(1 << 62) * 2 - 1024  # the largest double that is a bigint
    whole = fine.select("vec_id", F.transform("v", lambda x: F.floor(F.greatest(F.lit(-most), F.least(F.lit(most), scale * x)))).alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))
    return whole.withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def rotation(vectors: DataFrame, dim: int) -> np.ndarray:
    """Right singular vectors of all vectors, from their Gram matrix; dim * dim sums reach the driver."""

    def rows(it):
        gram, held = np.zeros((dim, dim)), []
        for (v,) in it:
            held.append(v + [0] * (dim - len(v)))
            if len(held) == 1024:
                x = np.array(held, float)
                gram, held = gram + x.T @ x, []
        if held:
            x = np.array(held, float)
            gram += x.T @ x
        yield from enumerate(gram.ravel().tolist())

    sums = map_rows(vectors.select("v"), rows, "i int, g double").groupBy("i").agg(F.sum("g").alias("g")).collect()
    gram = np.zeros(dim * dim)
    for row in sums:
        gram[row["i"]] = row["g"]
    return np.linalg.eigh(gram.reshape(dim, dim))[1][:, ::-1]


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, int]]:
    order = np.lexsort((ids, ~scores))[:k]  # ~ turns the order round and never leaves 64 bits
    return list(zip(scores[order].tolist(), ids[order].tolist()))


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers of any size, kept inside 64 bits."""
    low, high = -(1 << 63), (1 << 63) - 1
    return np.array([min(high, max(low, sum(map(mul, x, y)))) for x, y in zip(a.tolist(), b.tolist())], np.int64)


def search_cell(q_ids, q_whole, floors, c_ids, c_whole, turn, k: int):
    """(query, score, id) of at most k candidates per query that reach its floor; c comes longest first."""
    q, c = q_whole.astype(float), c_whole.astype(float)
    q_turned, c_turned = q @ turn, c @ turn
    parts = sorted({max(1, turn.shape[1] // 4), max(1, turn.shape[1] // 2)})
    rest = lambda x, p: np.sqrt(np.maximum(0.0, (x[:, p:] ** 2).sum(axis=1)))
    q_rest, c_rest = {p: rest(q_turned, p) for p in parts}, {p: rest(c_turned, p) for p in parts}
    q_long, c_long = rest(q_turned, 0), rest(c_turned, 0)
    best: list[list[tuple[int, int]]] = [[] for _ in q_ids]
    floors = floors.astype(float)
    slack = 1 + _EPS * q_long * (c_long.max() if len(c_long) else 0)
    fits = not len(c_long) or not len(q_long) or float(q_long.max()) * float(c_long.max()) < 2.0**52
    # A floor beyond 2**53 was rounded: scores that may be it are kept, and the last ranking tells.
    floors = floors if fits else floors - np.where(np.isfinite(floors), np.abs(floors), 0) * 1e-12
    for at in range(0, len(c), STEP):
        part = slice(at, at + STEP)
        alive = np.flatnonzero(q_long * c_long[part].max() + slack >= floors)
        if not len(alive):
            break
        bound = np.zeros((len(alive), len(c_ids[part])))
        seen = 0
        for p in parts:
            bound += q_turned[alive, seen:p] @ c_turned[part, seen:p].T
            seen = p
            can = bound + q_rest[p][alive, None] * c_rest[p][None, part] + slack[alive, None] >= floors[alive, None]
            if not can.any():
                break
        rows, cols = np.nonzero(can)
        keep = q_ids[alive[rows]] != c_ids[at + cols]
        rows, cols = rows[keep], cols[keep]
        exact = np.einsum("ij,ij->i", q[alive[rows]], c[at + cols]).astype(np.int64) if fits else _exact(q_whole[alive[rows]], c_whole[at + cols])
        enough = exact >= floors[alive[rows]]
        rows, cols, exact = rows[enough], cols[enough], exact[enough]
        starts = np.flatnonzero(np.diff(rows, prepend=-1)) if len(rows) else []
        for lo, hi in zip(starts, [*starts[1:], len(rows)]):
            i = alive[rows[lo]]
            old = best[i]
            scores = np.concatenate([exact[lo:hi], np.array([s for s, _ in old], np.int64)])
            ids = np.concatenate([c_ids[at + cols[lo:hi]], np.array([x for _, x in old], np.int64)])
            best[i] = _best(scores, ids, k)
            if len(best[i]) == k:
                floors[i] = max(floors[i], best[i][-1][0] if fits else best[i][-1][0] - abs(best[i][-1][0]) * 1e-12)
    for q_id, found in zip(q_ids.tolist(), best):
        for score, vec_id in found:
            yield q_id, int(score), vec_id


def _cells(queries: DataFrame, candidates: DataFrame, turn: np.ndarray, dim: int, k: int) -> DataFrame:
    """Both sides carry (chunk, block); a cell holds at most QUERIES by BLOCK vectors."""

    def matrix(column):
        out = np.zeros((len(column), dim), np.int64)
        for i, v in enumerate(column):
            out[i, : len(v)] = v
        return out

    def run(q, c):
        import pandas as pd

        c = c.sort_values("norm2", ascending=False, kind="stable")
        rows, found = [], matrix(c["v"])
        for at in range(0, len(q), STEP):
            part = q.iloc[at : at + STEP]
            rows += search_cell(part["q_id"].to_numpy(np.int64), matrix(part["q"]), part["low"].to_numpy(float), c["vec_id"].to_numpy(np.int64), found, turn, k)
        return pd.DataFrame(rows, columns=["query_id", "score", "vec_id"])

    # Both sides come from one table: other names keep their columns apart.
    left = queries.select(F.col("chunk").alias("q_chunk"), F.col("block").alias("q_block"), F.col("vec_id").alias("q_id"), F.col("v").alias("q"), "low")
    right = candidates.select("chunk", "block", "vec_id", "v", "norm2")
    return left.groupBy("q_chunk", "q_block").cogroup(right.groupBy("chunk", "block")).applyInPandas(run, "query_id long, score long, vec_id long")


def top_k(vectors: DataFrame, is_query: F.Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest integer inner products with the other vectors.

    ``is_query`` is a condition on ``vec_id``.
    """
    spark = vectors.sparkSession
    own = cut_lineage(quantized(vectors, scale, id_col, vector_col))
    size = own.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim"), F.sum(is_query.cast("int")).alias("queries")).first()
    if not size["n"] or not size["queries"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim = size["dim"]
    turn = rotation(own, dim)
    # Blocks by descending length: ranges of lengths, and salted parts of a range that ties make too large.
    ranges = max(1, -(-size["n"] // BLOCK))
    cuts = sorted({float(x) for x in own.approxQuantile("norm2", [i / ranges for i in range(1, ranges)], 0.25 / ranges)}, reverse=True) if ranges > 1 else []
    in_range = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast("array<double>"), lambda c: c > F.col("norm2")))
    ranged = own.withColumn("in_range", in_range)
    stats = sorted(tuple(r) for r in ranged.groupBy("in_range").agg(F.count("*"), F.max("norm2")).collect())  # one row per block
    firsts, longest, total = {}, [], 0
    for i, n, top in stats:
        parts = -(-n // BLOCK)
        firsts[i] = (total, parts)
        longest += [top] * parts
        total += parts
    pick = lambda j: F.element_at(F.create_map(*[F.lit(x) for i, v in firsts.items() for x in (i, v[j])]), F.col("in_range"))
    blocked = ranged.withColumn("block", (pick(0) + F.pmod(F.xxhash64("vec_id"), pick(1))).cast("int"))
    chunks = max(1, -(-size["queries"] // QUERIES))
    blocked = cut_lineage(blocked.select("vec_id", "v", "norm2", "block"))
    asked = blocked.where(is_query).select("vec_id", "v", "norm2", F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(chunks)).cast("int").alias("chunk"))
    spread = blocked.select("vec_id", "v", "norm2", "block", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
    head = asked.withColumns({"block": F.lit(0), "low": F.lit(float("-inf"))})
    first = cut_lineage(_cells(head, spread.where("block = 0"), turn, dim, k))
    lows = first.groupBy("query_id").agg(F.min("score").alias("low"), F.count("*").alias("n")).where(F.col("n") >= k)
    lows = lows.select(F.col("query_id").alias("vec_id"), F.col("low").cast("double").alias("low"))
    # Blocks come longest first, so those that can still matter are the first ones.
    tops = F.array(*[F.lit(float(x)) for x in longest])
    reach = F.size(F.filter(tops, lambda t: F.sqrt(t) * F.sqrt("norm2") * (1 + _EPS) + 1 >= F.col("low")))
    later = asked.join(lows, "vec_id", "left").withColumn("low", F.coalesce("low", F.lit(float("-inf")))).withColumn("reach", reach).where("reach > 1")
    later = later.select("vec_id", "v", "low", "chunk", F.explode(F.sequence(F.lit(1), F.col("reach") - 1)).alias("block"))
    found = first if total == 1 else first.unionByName(_cells(later, spread.where("block > 0"), turn, dim, k))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
