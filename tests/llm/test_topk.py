import random

import numpy as np
from pyspark.sql import functions as F

from codewarden.llm import topk


def _table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", "x", "x") for i, v in rows], "vec_id long, embedding array<float>, label int, v string, block string, chunk string")


def _brute(rows, k, is_query):
    best = {}
    for i, v in rows:
        if i is None or not v or any(x is None or not np.isfinite(x) for x in v):
            continue
        w = [int(np.floor(256 * float(np.float32(x)))) for x in v]
        best[i] = min(best.get(i, w), w)
    out = set()
    for q in filter(is_query, best):
        scores = sorted((-sum(a * b for a, b in zip(best[q], best[c])), c) for c in best if c != q)
        out |= {(q, r + 1, c, -s) for r, (s, c) in enumerate(scores[:k])}
    return out


def _got(df):
    return {(r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect()}


def test_against_brute_force(spark):
    rnd = random.Random(3)
    rows = [(i, [rnd.gauss(0, 1 if i % 9 else 4) for _ in range(12)]) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(40)]  # ties
    rows += [(2000, None), (2001, []), (2002, [1.0, None]), (2003, [float("nan")] * 12), (2004, [float("inf")] * 12), (None, rows[3][1]), (2005, [0.0] * 12), (2010, [1.0, -2.0])]
    rows += [rows[5], (5, rows[6][1])]
    block, queries = topk.BLOCK, topk.QUERIES
    for topk.BLOCK, topk.QUERIES in ((block, queries), (64, 16)):  # one cell, and many
        got = topk.top_k(_table(spark, rows), F.col("vec_id") % 5 == 0)
        assert _got(got) == _brute(rows, 5, lambda i: i % 5 == 0)
    topk.BLOCK, topk.QUERIES = block, queries


def test_few_candidates_and_empty_table(spark):
    rows = [(50, [1.0, 2.0]), (51, [0.5, -1.0]), (52, [0.25, 0.0])]
    assert _got(topk.top_k(_table(spark, rows), F.col("vec_id") % 50 == 0)) == _brute(rows, 5, lambda i: i % 50 == 0)
    assert topk.top_k(_table(spark, []), F.col("vec_id") % 50 == 0).count() == 0
    assert topk.top_k(_table(spark, rows), F.col("vec_id") < 0).count() == 0


def test_bounds_never_lose_a_candidate():
    rng = np.random.default_rng(2)
    c = np.floor(256 * rng.normal(size=(900, 16)) * rng.uniform(0.1, 3, size=(900, 1)))
    c = c[np.argsort(-(c**2).sum(axis=1))]
    q, turn = c[::30].copy(), np.linalg.eigh(c.T @ c)[1][:, ::-1]
    ids = np.arange(900)
    got = list(topk.search_cell(ids[::30], q, np.full(30, -np.inf), ids, c, turn, 5))
    scores = q @ c.T
    want = [(i * 30, int(scores[i, j]), j) for i in range(30) for j in [x for x in np.lexsort((ids, -scores[i])) if x != i * 30][:5]]
    assert sorted(got) == sorted(want)


def test_all_finite_values(spark):
    """Components whose products are beyond 2**53, and beyond 64 bits, where a score is the largest number there is."""
    rnd = random.Random(6)
    big = [(i, [rnd.choice([1, -1]) * 10 ** rnd.uniform(3, 6) for _ in range(6)]) for i in range(120)]
    rows = big + [(200 + i, [float(rnd.randint(-3, 3)) for _ in range(6)]) for i in range(60)] + [(300, [3e9] + [0.0] * 5), (301, [3e9, 1.0, 0.0, 0.0, 0.0, 0.0]), (305, [3.0e38] * 6), (306, [-3.0e38] * 6)]
    low, high = -(1 << 63), (1 << 63) - 1
    clipped = lambda x: int(np.floor(max(-9223372036854774784.0, min(9223372036854774784.0, 256 * float(np.float32(x))))))
    whole = {i: [clipped(x) for x in v] for i, v in rows}
    want = set()
    for q in (i for i in whole if i % 5 == 0):
        scores = sorted((-min(high, max(low, sum(a * b for a, b in zip(whole[q], whole[c])))), c) for c in whole if c != q)
        want |= {(q, r + 1, c, -s) for r, (s, c) in enumerate(scores[:5])}
    block, queries = topk.BLOCK, topk.QUERIES
    try:
        for topk.BLOCK, topk.QUERIES in ((block, queries), (16, 8)):
            assert _got(topk.top_k(_table(spark, rows), F.col("vec_id") % 5 == 0)) == want
    finally:
        topk.BLOCK, topk.QUERIES = block, queries
