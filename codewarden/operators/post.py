"""What happens to findings after the scanners: suppression, merge, order, duplicates, gate, review."""

from __future__ import annotations

import re
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codewarden.functions import text as X
from codewarden.functions.severity import severity_rank
from codewarden.functions.sizes import broadcast_if_small
from codewarden.schemas import SEVERITIES

# Word of the inline marker: "<word>: ignore" or "<word>: ignore[scanner-or-id]".
MARKER = "codewarden"

KEY = ["repo", "file", "line", "scanner", "title"]


def with_ids(findings: DataFrame) -> DataFrame:
    return findings.withColumns(
        {
            "finding_id": X.finding_id(F.col("scanner"), F.col("title")),
            "severity_rank": severity_rank(F.col("severity")),
        }
    )


def attach_line_text(findings: DataFrame, files: DataFrame) -> DataFrame:
    """``line_text`` for findings that came from elsewhere (reports); NULL for missing files or lines.

    Only the files some finding names take part, and each file is cut down to its flagged lines
    before rows meet, so file contents are not repeated per finding.
    """
    wanted = findings.where("line >= 1").select(F.col("repo").alias("_repo"), F.col("file").alias("_file"), F.col("line").alias("_line"))
    per_file = wanted.groupBy("_repo", "_file").agg(F.collect_set("_line").alias("_wanted"))
    named = files.join(
        broadcast_if_small(per_file), (files["repo"] == F.col("_repo")) & (files["path"] == F.col("_file"))
    )
    lines = named.withColumn("_lines", X.split_lines(F.col("content"))).select(
        "_repo",
        "_file",
        F.explode(
            F.transform("_wanted", lambda n: F.struct(n.alias("_line"), X.line_at(F.col("_lines"), n).alias("_text")))
        ).alias("x"),
    ).select("_repo", "_file", "x._line", "x._text")
    joined = findings.drop("line_text").join(
        lines,
        (F.col("repo") == F.col("_repo")) & (F.col("file") == F.col("_file")) & (F.col("line") == F.col("_line")),
        "left",
    )
    return joined.withColumn("line_text", F.col("_text")).drop("_repo", "_file", "_line", "_text")


def suppress(findings: DataFrame, marker: str = MARKER) -> DataFrame:
    """Drop findings whose flagged line carries the ignore marker (only its first marker counts)."""
    pattern = rf"{re.escape(marker)}:\s*ignore(?:\[([^\]]+)\])?"
    text = F.col("line_text")
    scope = X.strip(F.regexp_extract(text, pattern, 1))
    scoped = F.regexp_extract(text, pattern, 0).endswith("]")
    silenced = text.rlike(pattern) & (
        ~scoped | (scope == F.col("scanner")) | (scope == X.finding_id(F.col("scanner"), F.col("title")))
    )
    real_anchor = (F.col("line") >= 1) & ~F.col("project_level") & text.isNotNull()
    return findings.where(~F.coalesce(real_anchor & silenced, F.lit(False)))


def merge_engines(native: DataFrame, reported: DataFrame) -> DataFrame:
    """Native findings plus those reported on lines no native finding (suppressed or not) flags.

    The native side is reduced to its distinct lines first; the anti join then meets each line once.
    """
    lines = native.select("repo", "file", "line").distinct()
    fresh = reported.join(lines, ["repo", "file", "line"], "left_anti").select(*reported.columns)
    return native.unionByName(fresh, allowMissingColumns=True)


def emission() -> Column:
    """Where a finding stands among those of its repository: scanner, file (by its number, then its path), place in it."""
    return F.struct(F.col("emit_seq.scanner"), F.col("emit_seq.file_seq"), F.col("file"), F.col("emit_seq"))


def sort_key() -> list[Column]:
    """Severity first, ties in emission order."""
    return [severity_rank(F.col("severity")), emission()]


def sort(findings: DataFrame) -> DataFrame:
    return findings.orderBy("repo", *sort_key())


def dedupe(findings: DataFrame) -> DataFrame:
    """First finding in sort order per (repo, file, line, scanner, title).

    An aggregate, not a window: copies collapse before the shuffle, so a key that holds a third of
    all rows sends one row per task.
    """
    rest = [c for c in findings.columns if c not in KEY]
    first = F.min_by(F.struct(*rest), F.struct(severity_rank(F.col("severity")).alias("r"), F.col("emit_seq").alias("s")))
    return findings.groupBy(*KEY).agg(first.alias("_f")).select(*KEY, "_f.*").select(*findings.columns)


def exit_code(findings: DataFrame, fail_on: str = "high", repos: DataFrame | None = None) -> DataFrame:
    """Per repository 1 when a finding is at or above the threshold, else 0 (``never``: always 0)."""
    fail_on = fail_on.lower()
    if fail_on != "never" and fail_on.upper() not in SEVERITIES:
        raise ValueError(f"fail_on must be one of: {', '.join(s.lower() for s in SEVERITIES)}, never")
    limit = -1 if fail_on == "never" else SEVERITIES.index(fail_on.upper())
    worst = findings.groupBy("repo").agg(
        F.max(F.when(severity_rank(F.col("severity")) <= limit, F.lit(1)).otherwise(F.lit(0))).alias("exit_code")
    )
    if repos is None:
        return worst
    return repos.select("repo").distinct().join(worst, "repo", "left").fillna(0, ["exit_code"])


# Review verdicts ------------------------------------------------------------------------------


def reviewable() -> Column:
    """A snippet-only reviewer can judge it: has a snippet, is no project-level or dependency finding."""
    return (F.col("snippet") != "") & ~F.col("project_level") & (F.col("scanner") != "deps")


def review_requests(findings: DataFrame) -> DataFrame:
    """One JSON request per reviewable finding."""
    fid = X.finding_id(F.col("scanner"), F.col("title"))
    body = F.struct(
        "file", F.col("line").cast("string").alias("lines"), fid.alias("issue_type"), F.col("snippet").alias("code")
    )
    return findings.where(reviewable()).select("repo", "file", "line", fid.alias("finding_id"), F.to_json(body).alias("request"))


_VERDICT = "struct<confirmed:string,severity:string>"


def parse_verdicts(verdicts: DataFrame) -> DataFrame:
    """Adds ``parsed`` (JSON object text or NULL), ``confirmed`` and ``verdict_severity``.

    A response that is not JSON itself may carry an object inside a fenced block: from its first
    opening to its last closing brace.
    """
    raw = F.col("raw")
    fence = F.contains(raw, F.lit("```"))
    inner = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)

    def json_object(text: Column) -> Column:
        return F.when(F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT"), text)

    whole = F.try_parse_json(raw)
    parsed = F.when(whole.isNotNull(), json_object(raw)).when(fence & (inner != ""), json_object(inner))
    value = F.try_parse_json(F.col("parsed"))
    return verdicts.withColumn("parsed", parsed).withColumns(
        {
            "dismissed": F.coalesce(
                (F.schema_of_variant(F.try_variant_get(value, "$.confirmed", "variant")) == "BOOLEAN")
                & ~F.try_variant_get(value, "$.confirmed", "boolean"),
                F.lit(False),
            ),
            "verdict_severity": F.when(
                F.schema_of_variant(F.try_variant_get(value, "$.severity", "variant")) == "STRING",
                F.upper(F.try_variant_get(value, "$.severity", "string")),
            ),
        }
    )


def apply_verdicts(findings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Drop dismissed findings, mark confirmed ones, lower (never raise) their severity.

    ``verdicts(repo, file, line, finding_id, raw, error)`` has one row per reviewed finding; a missing
    verdict, an error or an unparsable answer keeps the finding as it is.
    """
    parsed = parse_verdicts(verdicts).where(F.col("error").isNull() & F.col("parsed").isNotNull())
    v = parsed.select(
        F.col("repo").alias("_repo"),
        F.col("file").alias("_file"),
        F.col("line").alias("_line"),
        F.col("finding_id").alias("_id"),
        "dismissed",
        "verdict_severity",
    )
    fid = X.finding_id(F.col("scanner"), F.col("title"))
    joined = findings.join(
        v,
        (F.col("repo") == F.col("_repo")) & (F.col("file") == F.col("_file")) & (F.col("line") == F.col("_line")) & (fid == F.col("_id")),
        "left",
    )
    judged = reviewable() & F.col("_id").isNotNull()
    lowered = F.col("verdict_severity").isin(*SEVERITIES) & (
        severity_rank(F.col("verdict_severity")) >= severity_rank(F.col("severity"))
    )
    return (
        joined.where(~F.coalesce(judged & F.col("dismissed"), F.lit(False)))
        .withColumn("severity", F.when(judged & lowered, F.col("verdict_severity")).otherwise(F.col("severity")))
        .withColumn("ai_confirmed", F.when(judged, F.lit(True)).otherwise(F.col("ai_confirmed")))
        .select(*findings.columns)
    )


# Counts ---------------------------------------------------------------------------------------


def severity_counts(findings: DataFrame) -> DataFrame:
    """Per repository: findings of each severity (zeros kept) and the total."""
    counts = [F.count_if(F.col("severity") == s).alias(s.lower()) for s in SEVERITIES]
    return findings.groupBy("repo").agg(*counts, F.count(F.lit(1)).alias("total"))


def phase_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("repo", "fix_phase").agg(F.count(F.lit(1)).alias("n"))


def files_scanned(files: DataFrame) -> DataFrame:
    return files.groupBy("repo").agg(F.count(F.lit(1)).alias("files_scanned"))


def headline(counts: DataFrame) -> DataFrame:
    """Executive summary per repository: the highest severity that occurs picks the text."""
    n = lambda name: F.col(name).cast("string")
    plural = lambda name: F.when(F.col(name) > 1, F.lit("s")).otherwise(F.lit(""))
    critical = F.concat(
        F.lit("**Your app has "),
        n("critical"),
        F.lit(" critical vulnerabilit"),
        F.when(F.col("critical") == 1, F.lit("y")).otherwise(F.lit("ies")),
        F.lit(
            ".**\nThese must be fixed before shipping — they allow attackers to steal data,\n"
            "impersonate users, or take over your server."
        ),
    )
    others = {
        "high": ("high-severity", "Your app is at serious risk. Fix these in the next release."),
        "medium": ("medium-severity", "Not immediately exploitable, but these weaken your security posture."),
        "low": ("low-severity", "Minor improvements recommended but no urgent risk."),
    }
    text = {
        name: F.concat(F.lit("**"), n(name), F.lit(f" {kind} issue"), plural(name), F.lit(f" found.**\n{advice}"))
        for name, (kind, advice) in others.items()
    }
    return counts.withColumn(
        "headline",
        F.when(F.col("critical") > 0, critical)
        .when(F.col("high") > 0, text["high"])
        .when(F.col("medium") > 0, text["medium"])
        .otherwise(text["low"]),
    )


# Languages an engine extracts, by suffix.
ENGINE_LANGUAGES = {
    "javascript": (".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs"),
    "python": (".py",),
}


def languages(files: DataFrame) -> DataFrame:
    """Sorted languages present per repository (a set of at most two values)."""
    suffix = X.suffix_of(F.col("path"))
    name = F
    for language, suffixes in ENGINE_LANGUAGES.items():
        name = name.when(suffix.isin(*suffixes), F.lit(language))
    found = files.select("repo", name.alias("language"))
    return found.groupBy("repo").agg(F.sort_array(F.collect_set("language")).alias("languages"))
