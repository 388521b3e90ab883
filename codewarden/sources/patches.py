"""Patch text as a table ``(repo, pos, raw)``: logs of `git log -p --unified=0` and diffs against HEAD.

A patch stream is a state machine (commit, file, hunk). The state is carried forward in blocks, so
one repository's log is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codewarden.functions.ordering import BLOCK, block_rank, carry_forward, count_since, with_blocks
from codewarden.functions.text import strip
from codewarden.session import cut_lineage

COMMIT = "COMMIT "
HUNK_START = r"^@@ -\S+ \+(\d+)"
HUNK = r"^@@ -\S+ \+(\d+)(?:,(\d+))? @@"


def _target(raw: Column) -> Column:
    """New-side path of a `+++ ` line; '' where the file is deleted."""
    name = strip(F.substr(raw, F.lit(5)))
    bare = F.when(
        F.startswith(name, F.lit('"')) & F.endswith(name, F.lit('"')) & (F.length(name) > 1),
        F.substring(name, F.lit(2), F.length(name) - 2),
    ).otherwise(name)
    return F.when(F.startswith(bare, F.lit("b/")), F.substr(bare, F.lit(3))).otherwise(F.lit(""))


def added_lines(log: DataFrame, block_rows: int = 100_000) -> DataFrame:
    """(repo, sha, path, new_line, text, pos) of every line a commit adds."""
    return _added(log, block_rows).drop(BLOCK)


def _added(log: DataFrame, block_rows: int) -> DataFrame:
    """Added lines with the number of their block, each block's lines in one partition."""
    raw = F.col("raw")
    is_commit, is_file = raw.startswith(COMMIT), raw.startswith("+++ ")
    is_hunk = ~is_commit & ~is_file & raw.startswith("@@")
    states = {
        "sha": F.when(is_commit, strip(F.substr(raw, F.lit(len(COMMIT) + 1)))),
        "path": F.when(is_commit, F.lit("")).when(is_file, _target(raw)),
    }
    blocks = with_blocks(log.select("repo", "pos", "raw"), "pos", block_rows)
    carried = carry_forward(blocks, ["repo"], "pos", states)
    is_added = raw.startswith("+") & ~is_file & (F.col("path") != "") & (F.col("sha") != "")
    start = F.coalesce(F.regexp_extract(raw, HUNK_START, 1).try_cast("bigint"), F.lit(0))
    flagged = carried.withColumn("_added", F.coalesce(is_added, F.lit(False)))
    counted = flagged.where(F.col("_added") | is_hunk)  # other lines neither count nor start a count
    placed = count_since(counted, ["repo"], "pos", F.col("_added"), F.when(is_hunk, start), "_next")
    return placed.where("_added").select(
        "repo",
        "sha",
        "path",
        (F.col("_next") - 1).cast("int").alias("new_line"),
        F.substr(raw, F.lit(2)).alias("text"),
        "pos",
        BLOCK,
    )


def added_texts(log: DataFrame, lines: int = 2000, halo: int = 100, block_rows: int = 100_000) -> DataFrame:
    """(repo, sha, path, pos, own, entries): what a commit adds to a file, as stretches of lines.

    ``entries`` are (nth, new_line, text) in order: up to ``lines`` of its own, the first ``own`` of them, and then
    up to ``halo`` lines of the next stretch, which a match that begins here may run into. A commit or file of any
    size is many stretches, and no window spans one.
    """
    if not 0 <= halo <= lines:
        raise ValueError("a halo reaches into the next stretch only")
    ranked = block_rank(_added(log, block_rows).where(F.col("repo").isNotNull()), ["repo", "sha", "path"], [F.col("pos"), F.col("new_line")], "nth")
    added = ranked.withColumn("nth", F.col("nth") - 1)
    number = F.floor(F.col("nth") / lines)
    before = F.when((F.col("nth") % lines < halo) & (number > 0), F.array(number, number - 1)).otherwise(F.array(number))
    dealt = added.withColumn("_part", F.explode(before))
    entry = F.struct("nth", "new_line", "text", "pos", (number > F.col("_part")).alias("halo"))
    parts = dealt.groupBy("repo", "sha", "path", "_part").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    own = F.size(F.filter("entries", lambda e: ~e["halo"]))
    return parts.select("repo", "sha", "path", F.get("entries", 0)["pos"].alias("pos"), own.alias("own"), "entries").where("own > 0")


def changed_lines(diff: DataFrame, untracked: DataFrame | None = None, block_rows: int = 100_000) -> DataFrame:
    """(repo, path, line) of every changed line; line is NULL where the whole file counts as changed.

    For a listing: a range of a hunk becomes a row per line. What compares with changes takes ``changed_ranges``.
    """
    ranges = changed_ranges(diff, untracked, block_rows)
    one = F.explode_outer(F.when(F.col("first").isNotNull(), F.sequence("first", "last"))).alias("line")
    return ranges.select("repo", "path", one).distinct()


def changed_ranges(diff: DataFrame, untracked: DataFrame | None = None, block_rows: int = 100_000) -> DataFrame:
    """(repo, path, first, last) of changed lines, a hunk's range as one row; NULLs where the whole file counts as changed.

    A file whose hunks only delete has no changed line and counts as wholly changed, like an untracked file. Ranges
    may overlap; equal ones are one row.
    """
    raw = F.col("raw")
    is_file = raw.startswith("+++ ")
    blocks = with_blocks(diff.select("repo", "pos", "raw"), "pos", block_rows)
    carried = carry_forward(blocks, ["repo"], "pos", {"path": F.when(is_file, _target(raw))})
    start = F.regexp_extract(raw, HUNK, 1).try_cast("int")
    count = F.coalesce(F.regexp_extract(raw, HUNK, 2).try_cast("int"), F.lit(1))
    first = F.when(raw.startswith("@@") & (count > 0), start)
    end = F.least(first.cast("bigint") + count - 1, F.lit((1 << 31) - 1)).cast("int")
    marked = carried.where((F.col("path") != "") & (is_file | raw.startswith("@@"))).select("repo", "path", first.alias("first"), end.alias("last"))
    ranges = marked.where(F.col("first").isNotNull()).distinct()
    entire = marked.groupBy("repo", "path").agg(F.count("first").alias("n")).where("n = 0").select("repo", "path")
    if untracked is not None:
        extra = untracked.where(strip(F.col("path")) != "").select("repo", strip(F.col("path")).alias("path")).distinct()
        ranges = ranges.join(extra, ["repo", "path"], "left_anti")
        entire = entire.unionByName(extra).distinct()
    none = F.lit(None).cast("int")
    # A diff is small next to the files, and its ranges are read several times by what follows.
    return cut_lineage(ranges.unionByName(entire.select("repo", "path", none.alias("first"), none.alias("last"))))
