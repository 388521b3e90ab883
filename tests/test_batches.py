"""A worker holds a bounded piece of an Arrow batch as Python objects."""

import pyarrow as pa
from pyspark.sql import functions as F

from codewarden.functions import batches as B
from codewarden.operators import closure, facts_py


def test_pieces_keep_the_rows_and_their_order_within_the_limits():
    texts = [None, "", "a" * 3 * B.PIECE_BYTES] + [str(i) * (i % 700) for i in range(3000)]
    parts = [part for (part,) in B.pieces((pa.array(texts),))]
    assert [v for part in parts for v in part.to_pylist()] == texts
    assert all(len(p) == 1 or (len(p) <= B.PIECE_ROWS and p.nbytes <= B.PIECE_BYTES) for p in parts)
    assert not list(B.pieces((pa.array([], pa.string()),)))


def test_results_leave_before_the_rest_of_the_batch_is_taken():
    taken = []
    found = B.results(lambda v: taken.append(v) or v, iter([pa.array(range(10_000))]), pa.int64())
    assert len(next(found)) == len(taken) <= B.PIECE_ROWS
    assert sum(len(part) for part in found) + B.PIECE_ROWS >= 10_000 > len(taken) - 1


def test_module_tables_and_walks_send_their_rows_in_pieces(spark):
    plans = spark.range(1).select(facts_py.facts(F.lit("x")).alias("f")), spark.createDataFrame(
        [([(["*"], "x")],)], "e array<struct<srcs:array<string>,dst:string>>"
    ).select(closure.reached_names(F.col("e")))
    for df in plans:
        # 251: helpers that are given batches one after another and give arrays of any length.
        assert "#" in (plan := df._jdf.queryExecution().executedPlan().toString()) and ", 251" in plan


def test_module_tables_of_many_rows(spark):
    texts = [None, "", "def f(:", "x = input()\nf(x)\n"] + [f"y{i} = g({i})\n" for i in range(900)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(1).select("i", facts_py.facts(F.col("t")).alias("f"))
    got = {r["i"]: r["f"].asDict(recursive=True) for r in rows.collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        want = facts_py.module_facts(text) or dict.fromkeys(facts_py._FIELDS)
        assert got[i] == want
