"""Secrets in the added lines of a commit history, and findings limited to changed lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codewarden import schemas
from codewarden.functions.sizes import broadcast_if_small
from codewarden.operators import custom
from codewarden.plans import file_pass
from codewarden.session import cut_lineage
from codewarden.sources.patches import added_lines, added_texts


def secret_findings(log: DataFrame, rules: Sequence[custom.CustomRule] = (), lines: int = 2000, halo: int = 100) -> DataFrame:
    """Secrets, and hits of the user's rules, that some commit added, at the line they had in that commit.

    Patterns run over what a commit adds to a file, in stretches of ``lines`` lines with the ``halo`` lines after
    them, so a match may span lines; it belongs to the stretch that it starts in. No commit or file is ever gathered
    into one task. Copies collapse in an aggregate that combines before the shuffle.
    """
    texts = added_texts(log, lines, halo).select(
        "repo", "path", F.col("pos").alias("file_seq"), F.array_join(F.transform("entries", lambda e: e["text"]), "\n").alias("content"), "sha", "own", "entries"
    )
    scanners = ("custom", "secrets") if rules else ("secrets",)
    hits = file_pass.findings(texts, scanners, rules, keep=("sha", "own", "entries")).where("line <= own")
    entry = F.get("entries", F.col("line") - 1)
    placed = hits.withColumns({"new_line": entry["new_line"], "line_text": entry["text"]})
    first = placed.groupBy("repo", "sha", "file", "new_line", "title").agg(
        F.min_by(F.struct("severity", "description", "scanner", "line_text", "fix_phase", "fix_summary", "emit_seq"), F.struct("emit_seq.file_seq", "emit_seq")).alias("f")
    )
    return schemas.as_findings(
        first.select(
            "repo",
            F.concat("file", F.lit(" @ "), F.substring("sha", 1, 12)).alias("file"),
            F.col("new_line").alias("line"),
            "f.severity",
            "title",
            F.concat(
                F.lit("Committed in "),
                "sha",
                F.lit(". "),
                F.col("f.description"),
                F.lit(" Deleting it from the current code does not un-leak it — rotate the credential."),
            ).alias("description"),
            F.col("f.scanner").alias("scanner"),
            F.col("f.line_text").alias("snippet"),
            F.col("f.fix_phase").alias("fix_phase"),
            F.col("f.fix_summary").alias("fix_summary"),
            F.col("f.line_text").alias("line_text"),
            F.col("f.emit_seq").alias("emit_seq"),
        )
    )


def diffs_scanned(log: DataFrame) -> DataFrame:
    """Distinct (commit, file) pairs with added lines, per repository."""
    pairs = added_lines(log).select("repo", "sha", "path").distinct()
    return pairs.groupBy("repo").agg(F.count(F.lit(1)).alias("files_scanned"))


def only_changed_files(files: DataFrame, changed: DataFrame) -> DataFrame:
    """The files a diff touches, taken before the scan so that nothing else is read."""
    touched = broadcast_if_small(changed.select("repo", "path").distinct())
    return files.join(touched, ["repo", "path"], "left_semi").select(*files.columns)


def _level(first: Column, last: Column) -> Column:
    """The smallest power of two that is no shorter than a range: its bins are as long, so a range meets at most two."""
    return F.ceil(F.log2((last - first + 1).cast("double"))).cast("int")


def _size(level: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), level)


def on_changed_lines(findings: DataFrame, changed: DataFrame) -> DataFrame:
    """Findings on changed lines or in wholly changed files; project-level ones are left out.

    ``changed`` has (repo, path, line) or ranges (repo, path, first, last). Ranges stay ranges: one is a row in each
    of the one or two bins of its own size, and a finding looks into one bin per size that occurs (32 at most).
    """
    if "line" in changed.columns:
        changed = changed.select("repo", "path", F.col("line").alias("first"), F.col("line").alias("last"))
    keys = changed.select("repo", F.col("path").alias("file"), "first", "last").distinct()
    whole = keys.where(F.col("first").isNull()).select("repo", "file").distinct()
    sized = keys.where(F.col("first").isNotNull()).withColumn("_level", _level(F.col("first"), F.col("last")))
    size = _size(F.col("_level"))
    bins = F.array_distinct(F.array(F.floor(F.col("first") / size), F.floor(F.col("last") / size)))
    ranges = sized.select(F.col("repo").alias("_r"), F.col("file").alias("_f"), "first", "last", "_level", F.explode(bins).alias("_bin"))
    levels = sorted(row["_level"] for row in sized.select("_level").distinct().collect())  # at most 32
    mine = findings.where(~F.col("project_level"))
    in_whole = mine.join(whole, ["repo", "file"], "left_semi").select(*findings.columns)
    if not levels:
        return in_whole
    own = mine.withColumn("_key", F.monotonically_increasing_id())
    own = cut_lineage(own)  # the number of a row must not change between its two uses
    looking = own.select("_key", "repo", "file", "line", F.explode(F.array(*map(F.lit, levels))).alias("_own"))
    looking = looking.withColumn("_at", F.floor(F.col("line") / _size(F.col("_own"))))
    meets = (F.col("repo") == F.col("_r")) & (F.col("file") == F.col("_f")) & (F.col("_own") == F.col("_level")) & (F.col("_at") == F.col("_bin"))
    hit = looking.join(ranges, meets & F.col("line").between(F.col("first"), F.col("last")), "left_semi").select("_key").distinct()
    on_line = own.join(hit, "_key", "left_semi").select(*findings.columns)
    return in_whole.unionByName(on_line)


def files_in_diff(changed: DataFrame) -> DataFrame:
    return changed.select("repo", "path").distinct().groupBy("repo").agg(F.count(F.lit(1)).alias("files_scanned"))
