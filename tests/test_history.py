"""Commit history over several lines, and changes as ranges."""

import random
import time

import pytest
from pyspark.sql import functions as F

from codewarden.functions import ordering
from codewarden.operators import custom, history
from codewarden.schemas import as_findings
from codewarden.sources import patches

FOUND = "repo string, file string, line int, title string, scanner string, project_level boolean"


def _log(spark, texts):
    return spark.createDataFrame([("r", i, t) for i, t in enumerate(texts)], "repo string, pos bigint, raw string")


TWO_LINES = [custom.CustomRule("pair", r"begin\n(?:mid\n)?end", "m", "LOW")]


@pytest.mark.parametrize("lines, halo", [(2000, 100), (1, 1), (2, 2), (3, 2), (5, 5)])
def test_a_match_over_lines_is_found_once_at_its_line(spark, lines, halo):
    log = ["COMMIT aaaa", "+++ b/x.py", "@@ -0,0 +10,2 @@", "+begin", "+end", "@@ -1 +50 @@", "+begin", "-gone", "@@ -9 +60 @@", "+end",
           "+++ b/y.py", "@@ -1 +1,4 @@", "+begin", "+begin", "+end", "+token = \"0123456789abcdef0123456789\"",
           "COMMIT bbbb", "+++ b/x.py", "@@ -1 +7 @@", "+end", "+begin"]
    found = history.secret_findings(_log(spark, log), TWO_LINES, lines, halo).collect()
    got = sorted((r.file, r.line, r.title, r.scanner, r.snippet) for r in found)
    assert got == [
        ("x.py @ aaaa", 10, "pair", "custom", "begin"), ("x.py @ aaaa", 50, "pair", "custom", "begin"),
        ("y.py @ aaaa", 2, "pair", "custom", "begin"), ("y.py @ aaaa", 4, "Generic API Key Detected", "secrets", 'token = "0123456789abcdef0123456789"'),
    ]
    with pytest.raises(ValueError):
        patches.added_texts(_log(spark, log), 2, 3)


def test_a_hostile_hunk_is_one_range(spark):
    diff = _log(spark, ["+++ b/x.py", "@@ -1 +1,2000000000 @@", "@@ -1 +5,99999999999 @@", "@@ -1 +2147483647,9 @@", "+++ b/y.py", "@@ -3 +2,0 @@"])
    start = time.time()
    ranges = patches.changed_ranges(diff)
    got = sorted(map(tuple, ranges.collect()), key=str)
    # A count that is no number of lines counts as one; a range ends with the largest line number.
    assert got == sorted([("r", "x.py", 1, 2_000_000_000), ("r", "x.py", 2147483647, 2147483647), ("r", "x.py", 5, 5), ("r", "y.py", None, None)], key=str)
    found = as_findings(spark.createDataFrame([("r", "x.py", n, "t", "s", False) for n in (1, 77, 2_000_000_000, 2_000_000_001)] + [("r", "y.py", 9, "t", "s", False)], FOUND))
    kept = sorted((r.file, r.line) for r in history.on_changed_lines(found, ranges).collect())
    assert kept == [("x.py", 1), ("x.py", 77), ("x.py", 2_000_000_000), ("y.py", 9)]
    assert time.time() - start < 60


def test_ranges_against_plain_comparison(spark):
    rnd = random.Random(11)
    ranges = [("r", f"f{rnd.randint(0, 5)}", a, a + int(2 ** rnd.uniform(0, 9)) - 1) for a in (rnd.randint(1, 3000) for _ in range(60))]
    ranges += ranges[:5] + [("r", "f9", None, None)]
    rows = [("r", f"f{rnd.choice([0, 1, 2, 3, 4, 5, 9])}", rnd.randint(1, 3500), f"t{n % 3}", "s", n % 11 == 0) for n in range(900)]
    rows += rows[:50]
    changed = spark.createDataFrame(ranges, "repo string, path string, first int, last int")
    got = history.on_changed_lines(as_findings(spark.createDataFrame(rows, FOUND)), changed).select("file", "line", "title").collect()
    hit = lambda f, n: any(p == f and (a is None or a <= n <= b) for _, p, a, b in ranges)
    assert sorted(map(tuple, got)) == sorted((f, n, t) for _, f, n, t, _, level in rows if not level and hit(f, n))
    lines = changed.where("first IS NULL OR last - first < 3").select("repo", "path", F.explode_outer(F.when(F.col("first").isNotNull(), F.sequence("first", "last"))).alias("line"))
    few = history.on_changed_lines(as_findings(spark.createDataFrame(rows, FOUND)), lines).count()
    short = [r for r in ranges if r[2] is None or r[3] - r[2] < 3]
    assert few == sum(not level and any(p == f and (a is None or a <= n <= b) for _, p, a, b in short) for _, f, n, t, _, level in rows)
    assert history.on_changed_lines(as_findings(spark.createDataFrame(rows, FOUND)), changed.where("false")).count() == 0


def test_lines_of_a_file_in_many_blocks_are_numbered_in_order(spark):
    """A commit's file goes on over blocks and comes back after others; a log without a repository has no texts."""
    rnd, log, want = random.Random(3), [], {}
    for part in range(40):
        sha, path = f"c{rnd.randrange(3)}", f"f{rnd.randrange(2)}.py"
        log += [f"COMMIT {sha}", f"+++ b/{path}", "@@ -1 +5 @@"]
        for n in range(rnd.randint(0, 9)):
            log.append(f"+line {part} {n}")
            want.setdefault((sha, path), []).append((5 + n, f"line {part} {n}"))
            log += ["-gone"] * rnd.randint(0, 2)
    both = _log(spark, log).unionByName(_log(spark, log).withColumn("repo", F.lit(None).cast("string")))
    rows = patches.added_texts(both, 4, 2, block_rows=7)
    plan = rows._jdf.queryExecution().toString()
    assert "rangepartitioning" not in plan.lower()
    got = {}
    for r in sorted(rows.collect(), key=lambda r: r.entries[0]["nth"]):
        assert r.repo == "r" and len(r.entries) - r.own <= 2
        got.setdefault((r.sha, r.path), []).extend((e["new_line"], e["text"]) for e in r.entries[: r.own])
    assert got == want


def test_block_rank_needs_no_range_partitions(spark, monkeypatch):
    """The rows are numbered where their blocks lie: one shuffle by block before, none by range and no sample."""
    written = []
    cut = ordering.cut_lineage
    monkeypatch.setattr(ordering, "cut_lineage", lambda df: (written.append(df._jdf.queryExecution().executedPlan().toString()), cut(df))[1])
    patches.added_texts(_log(spark, ["COMMIT a", "+++ b/x.py", "@@ -1 +1 @@", "+one", "+two"])).collect()
    assert not any("rangepartitioning" in plan for plan in written)
