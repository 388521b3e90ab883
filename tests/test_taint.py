"""Taint environments: linear walks, and what the tables of a module's syntax say."""

import random
import time

from pyspark.sql import functions as F

from codewarden.functions import text as X
from codewarden.operators import closure, facts_py, taint_js, taint_py


def _js_tainted(spark, text):
    df = spark.createDataFrame([(text,)], "t string").withColumn("d", taint_js.definitions(X.split_lines(F.col("t"))))
    return set(df.select(taint_js.tainted_names(F.col("d")).alias("n")).first().n)


def test_a_long_chain_of_definitions_is_linear(spark):
    hops = 16_000
    text = "const a0 = req.query.q;\n" + "".join(f"const a{i + 1} = a{i} + 1;\n" for i in range(hops))
    _js_tainted(spark, "const a = req.query.q;")  # starts the worker
    start = time.time()
    assert len(_js_tainted(spark, text)) == hops + 1
    assert time.time() - start < 6  # definitions included; the walk by itself takes milliseconds
    rows = [(i == 0, [f"a{i}"], [f"a{i - 1}"]) for i in range(200_000)]
    start = time.time()
    assert len(closure.forward(rows)) == len(rows)
    assert time.time() - start < 2


def test_forward_order_counts(spark):
    assert _js_tainted(spark, "const b = a;\nconst a = req.body.x;\nconst c = a;\n") == {"a", "c"}
    assert _js_tainted(spark, "const b = 1;\n") == set()
    assert spark.createDataFrame([(None,)], "d array<struct<src:boolean,names:array<string>,uses:array<string>>>").select(
        taint_js.tainted_names(F.col("d")).alias("n")
    ).first().n is None


def test_walks_against_repeated_passes():
    rnd = random.Random(3)
    for _ in range(200):
        names = "abcdefgh"
        rows = [(rnd.random() < 0.1, [rnd.choice(names)], rnd.sample(names, rnd.randint(0, 2))) for _ in range(rnd.randint(0, 25))]
        seen = set()
        for source, new, uses in rows:
            seen |= set(new) if source or seen & set(uses) else set()
        assert set(closure.forward(rows)) == seen
        edges = [(rnd.sample(names + closure.ROOT, rnd.randint(0, 3)), rnd.choice(names)) for _ in range(rnd.randint(0, 25))]
        far = {closure.ROOT}
        for _ in edges:
            far |= {end for starts, end in edges if far & set(starts)}
        assert set(closure.reached(edges)) == far


# Expression: source, call, literal, text put together, names.
TRAITS = {
    "request": (False, False, False, False, ["request"]),
    "request.args['q']": (True, False, False, False, ["request"]),
    "request.args['q'].x[0]": (True, False, False, False, ["request"]),
    "request().x": (False, True, False, False, ["request"]),
    "my.request.args": (False, False, False, False, ["my"]),
    "sys.argv[1]": (True, False, False, False, ["sys"]),
    "a.sys.argv": (False, False, False, False, ["a"]),
    "os.environ['A']": (True, False, False, False, ["os"]),
    "os.getenv('A')": (True, True, False, False, ["os"]),
    "x.os.getenv('A')": (False, True, False, False, ["x"]),
    "getenv('A')": (False, True, False, False, ["getenv"]),
    "input()": (True, True, False, False, ["input"]),
    "x.input()": (False, True, False, False, ["x"]),
    "[1, ('a', None), []]": (False, False, True, False, []),
    "[1, x]": (False, False, False, False, ["x"]),
    "{'a': 1}": (False, False, False, False, []),
    "-1": (False, False, False, False, []),
    "'a' + x": (False, False, False, True, ["x"]),
    "x + 1 + (y + 'b')": (False, False, False, True, ["x", "y"]),
    "x * ('a' % y)": (False, False, False, False, ["x", "y"]),
    "x + y * 'a'": (False, False, False, True, ["x", "y"]),
    "x + f('a')": (False, True, False, False, ["x", "f"]),
    "x + [('a' + y)]": (False, False, False, False, ["x", "y"]),
    "1 + 2": (False, False, False, False, []),
    "b'a' + x": (False, False, False, False, ["x"]),
    "'%s' % x": (False, False, False, True, ["x"]),
    "f'{x}'": (False, False, False, True, ["x"]),
    "f'plain'": (False, False, False, False, []),
    "x + f'plain'": (False, False, False, True, ["x"]),
    "'{}'.format(x)": (False, True, False, True, ["x"]),
    "format(x)": (False, True, False, False, ["format", "x"]),
    "g(x).format(1)": (False, True, False, True, ["g", "x"]),
}


def test_traits_of_expressions(spark):
    texts = [f"q = {e}\nrun({e})\n" for e in TRAITS]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("s", facts_py.facts(F.col("t")))
    got = {r.i: r.f for r in df.select("i", taint_py.judged(F.col("s")).alias("f")).collect()}
    for i, (text, (src, call, const, builds, names)) in enumerate(TRAITS.items()):
        arg = got[i].calls[-1].args[0] if got[i].calls[-1].name == "run" else next(c for c in got[i].calls if c.name == "run").args[0]
        assert (arg.src, arg.call, arg.const, arg.builds, sorted(arg.names)) == (src, call, const, builds, sorted(names)), text
        assert (got[i].assigns[0].src, got[i].assigns[0].const) == (src, const), text


def test_deep_and_broken_modules(spark):
    texts = ["f(" + "+".join(["x"] * 3000) + ")", "def (", None, "", "x: int\nx = input()\ny += x\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("s", facts_py.facts(F.col("t")))
    got = {r.i: r.f for r in df.select("i", taint_py.judged(F.col("s")).alias("f")).collect()}
    assert got[1] is None and got[2] is None and got[3].functions == 0
    assert [(a.name, a.src) for a in got[4].assigns] == [("x", True), ("y", False)]
    assert got[0] is None or len(got[0].calls[0].args[0].names) == 3000
