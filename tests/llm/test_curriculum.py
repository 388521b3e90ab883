import hashlib
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from codewarden.llm import curriculum as c


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute(rows, weights=(5, 2, 1), share=Fraction(3, 2), most=2):
    """{source: (size, target)} and the sorted rows (doc_id, size, source_size, target, taken)."""
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + words(text)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full, total = set(), sum(sizes.values())
    while True:
        open_ = [s for s in order if s not in full]
        if not open_:
            target = {s: Fraction(most * sizes[s]) for s in order}
            break
        level = (share * total - sum(most * sizes[s] for s in full)) / sum(weight[s] for s in open_)
        above = {s for s in open_ if weight[s] * level > most * sizes[s]}
        if not above:
            target = {s: Fraction(most * sizes[s]) if s in full else weight[s] * level for s in order}
            break
        full |= above
    out = []
    for source in order:
        at = lambda r: int(hashlib.md5(b"" if r[0] is None else str(r[0]).encode()).hexdigest()[:15], 16)
        own = sorted((r for r in rows if r[2] == source), key=lambda r: (at(r), r[0] or 0, words(r[1])))
        wanted, before = int(target[source] + Fraction(1, 2)), 0
        for doc_id, text, _ in own:
            n = words(text)
            taken = sum(max(0, min(wanted - before - k * sizes[source], n)) for k in range(most))
            out.append((doc_id, n, sizes[source], float(target[source]), taken))
            before += n
    return target, sorted(out, key=str)


def mixed(spark, rows, **options):
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, source string, size string, turn int")
    return c.mix(frame.repartition(3), **options)


def case(odd, prose):
    sources = ["b", "a", None, "", "é", "Z", "z"]
    rows = [(i, t, sources[k % 3]) for k, (i, t) in enumerate(odd)]
    return rows + [(100 + i, prose(i % 90, i), sources[i % 7] if i % 3 else "b") for i in range(300)] + [(None, "two words", "a")] * 30 + [(9, "", "empty")]


def test_mix_against_plain_sums(spark, odd, prose):
    rows = case(odd, prose)
    target, want = brute(rows)
    got = mixed(spark, rows).collect()
    assert sorted([(r.doc_id, r["size"], r.source_size, r.target, r.taken) for r in got], key=str) == want
    by_source = {}
    for r in got:
        assert r.taken <= 2 * r["size"] and sum(p is not None for p in r.positions) == 2 or r.taken < 2 * r["size"] or not r["size"]
        by_source[r.source] = by_source.get(r.source, 0) + r.taken
    assert all(abs(by_source[s] - t) <= 0.5 for s, t in target.items())


def test_sorted_by_position_and_reruns_agree(spark, odd, prose):
    rows = case(odd, prose)
    got = mixed(spark, rows).collect()
    first = [r.positions[0] for r in got if r.positions[0] is not None]
    assert first == sorted(first) and 0 <= first[0] and first[-1] <= sum(r.taken for r in got)
    again = mixed(spark, rows[::-1]).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_positions_follow_the_schedule(spark):
    """Strong sources are met early: a source's words before a position are its demand by then."""
    rows = [(i, "w " * 50, "abc"[i % 3]) for i in range(600)]
    got = mixed(spark, rows).collect()
    half = sum(r.taken for r in got) / 2
    early = {s: sum(p is not None and p < half for r in got if r.source == s for p in r.positions) / sum(p is not None for r in got if r.source == s for p in r.positions) for s in "abc"}
    assert early["a"] > early["b"] > early["c"]


@pytest.mark.parametrize("shape", [*c.SHAPES, ((0.0, 0.0), (0.3, 4.0), (0.7, 0.0), (1.0, 1.0))])
def test_times_invert_the_integral(spark, shape):
    points = spark.range(101).select((F.col("id") / 100).alias("part"))
    back = points.select("part", c.part_due(c.time_of(F.col("part"), shape), shape).alias("again")).collect()
    assert all(abs(r.part - r.again) < 1e-9 for r in back)
    steps = 200_000
    knots = lambda t: next(a + (b - a) * (t - x) / (y - x) for (x, a), (y, b) in zip(shape, shape[1:]) if t <= y)
    heights = [knots((i + 0.5) / steps) for i in range(steps)]
    for cut in (0.25, 0.6):
        due = spark.range(1).select(c.part_due(F.lit(cut), shape)).first()[0]
        assert abs(due - sum(heights[: int(cut * steps)]) / sum(heights)) < 1e-6


def test_all_full_other_weights_and_no_rows(spark):
    rows = [(1, "a b c", "x"), (2, "a", "y"), (3, None, None)]
    for options in ({"weights": (1, 9), "share": "1.2"}, {"share": "3"}):
        _, want = brute(rows, options.get("weights", (5, 2, 1)), Fraction(options["share"]))
        got = mixed(spark, rows, **options).collect()
        assert sorted([(r.doc_id, r["size"], r.source_size, r.target, r.taken) for r in got], key=str) == want
    assert mixed(spark, []).collect() == []
    assert [tuple(r)[:6] for r in mixed(spark, [(1, None, "x")]).collect()] == [(1, "x", 0, 0, 0.0, 0)]
