"""Header checks per file, and the one CSRF check per repository.

The per-file checks are presence/absence predicates in one pass. The CSRF check is a mergeable
aggregate (two flags and a minimum), so a repository with a third of all files is combined on the
map side and no group is ever collected.
"""

from __future__ import annotations

from functools import cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codewarden import schemas
from codewarden.functions import matching as M
from codewarden.functions import text as X
from codewarden.operators.injection import HITS_DDL
from codewarden.rules import headers as R

HITS = "_hdr_hits"
CHECKS = ("django", "helmet", "flask", "fastapi", "cors")
_LAST = (1 << 63) - 1
# The first characters of what the patterns match (see ``matching.starting``).
FRAMEWORK_START = "[rfi][erm]"
STARTS = {R.HELMET: "[rf][er]", R.FLASK_APP: "Fl", R.FASTAPI_APP: "Fa", R.WILDCARD_CORS: "[coA][orc]"}


def frameworks(content: Column) -> dict[str, Column]:
    """One flag per web framework."""
    return {name: M.has(content, name) & content.rlike(M.starting(FRAMEWORK_START, regex)) for name, regex in R.FRAMEWORKS.items()}


def any_framework(content: Column) -> Column:
    return reduce(lambda a, b: a | b, frameworks(content).values())


def placeholder(path: Column, text: str) -> Column:
    """Placeholder snippet in the comment style of the file."""
    hash_style = X.suffix_of(path).isin(*R.HASH_COMMENT_SUFFIXES)
    return F.concat(F.when(hash_style, F.lit("# ")).otherwise(F.lit("// ")), F.lit(text))


@cache
def _checks() -> Column:
    """array<struct<ord,line>> of one file."""
    content = F.col("content")

    def check(order: int, condition: Column, line: Column) -> Column:
        return F.when(condition, F.struct(F.lit(order).alias("ord"), line.alias("line")))

    def hardened(regex: str, words: str) -> Column:
        """Whether a sign of hardening is there, in whatever case: the pattern only runs where one of its words occurs."""
        return _any_word(F.col("_low"), (*words.split(), M.DOTTED_I)) & content.rlike(regex)

    web = F.col("_web")
    helmet, flask_app, fastapi_app, wildcard = (M.starting(start, regex) for regex, start in STARTS.items())
    found = [
        check(
            0,
            M.has(content, "INSTALLED_APPS")
            & content.rlike(R.DJANGO_SETTINGS)
            & content.rlike(R.DJANGO_CONTRIB)
            & ~content.rlike(R.DJANGO_HARDENED),
            M.first_match_line(content, R.DJANGO_SETTINGS),
        ),
        check(1, web & frameworks(content)["express"] & ~(M.has(content, "helmet") & content.rlike(helmet)), F.lit(1)),
        check(
            2,
            web & M.has(content, "Flask") & content.rlike(flask_app) & ~hardened(R.SECURITY_HEADERS, R.SECURITY_WORDS),
            M.first_match_line(content, flask_app),
        ),
        check(
            3,
            web & M.has(content, "FastAPI") & content.rlike(fastapi_app) & ~hardened(R.FASTAPI_SECURITY, R.FASTAPI_WORDS),
            M.first_match_line(content, fastapi_app),
        ),
        check(
            4,
            web & M.gate("content", "content", R.CORS_ANCHORS, False) & content.rlike(wildcard),
            M.first_match_line(content, wildcard),
        ),
    ]
    return F.array_compact(F.array(*found))


def before_lines() -> list[dict[str, Column]]:
    return [
        {"_web": F.col("_code") & any_framework(F.col("content"))},
        {"_checks": F.when(F.col("_code"), _checks())},
    ]


def wants_lines() -> Column:
    return F.coalesce(F.size("_checks") > 0, F.lit(False))


@cache
def after_lines() -> list[dict[str, Column]]:
    shaped = F.transform(
        "_checks",
        lambda c: F.struct(
            c["ord"].alias("rule"),
            c["line"].alias("line"),
            F.lit(0).alias("part"),
            c["ord"].cast("bigint").alias("a"),
            F.lit(0).cast("bigint").alias("b"),
            F.lit(0).cast("bigint").alias("c"),
            F.lit(None).cast("boolean").alias("reachable"),
        ),
    )
    return [{HITS: F.coalesce(shaped, F.array().cast(HITS_DDL)).cast(HITS_DDL)}]


def rule_rows() -> list[tuple]:
    return [(i, *R.TEXTS[check]) for i, check in enumerate(CHECKS)] + [(SIGNAL, SIGNAL_TITLE, "", 0, "", "")]


# Signals travel as hits of a rule of their own: its position holds the flags as bits.
SIGNAL = len(CHECKS)
SIGNAL_TITLE = "(signals)"


def signal_step() -> dict[str, Column]:
    framework = F.when(F.col("_code"), F.col("_web")).otherwise(any_framework(F.col("content")))  # known of code files
    flags = signals(F.col("content"), F.col("_low"), framework).values()
    bits = sum((F.when(flag, F.lit(1 << i)).otherwise(F.lit(0)) for i, flag in enumerate(flags)), F.lit(0))
    return {"_signals": bits}


def signal_hits() -> Column:
    hit = F.struct(
        F.lit(SIGNAL).alias("rule"),
        F.lit(0).alias("line"),
        F.lit(0).alias("part"),
        F.col("_signals").cast("bigint").alias("a"),
        F.lit(0).cast("bigint").alias("b"),
        F.lit(0).cast("bigint").alias("c"),
        F.lit(None).cast("boolean").alias("reachable"),
    )
    return F.when(F.col("_signals") > 0, F.array(hit)).otherwise(F.array().cast(HITS_DDL)).cast(HITS_DDL)


def is_signal() -> Column:
    """Rows of the signal rule; a user's rule of the same name is another scanner's."""
    return (F.col("scanner") == "headers") & (F.col("title") == SIGNAL_TITLE)


def signals_of(rows: DataFrame) -> DataFrame:
    """``file_signals`` rows back from findings rows of the signal rule (files without a signal have none)."""
    bit = lambda i: F.col("emit_seq.a").bitwiseAND(F.lit(1 << i).cast("bigint")) > 0
    flags = [bit(i).alias(name) for i, name in enumerate(("framework", "session", "csrf"))]
    return rows.where(is_signal()).select(
        "repo", F.col("file").alias("path"), F.col("emit_seq.file_seq").alias("file_seq"), *flags
    )


def _any_word(folded: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [M.has(folded, word) for word in words])


def signals(content: Column, folded: Column, framework: Column | None = None) -> dict[str, Column]:
    """What a file says about the repository's need for CSRF protection (any suffix counts)."""
    form = M.has(folded, R.FORM) & content.rlike(R.SESSION_FORM)
    return {
        "framework": any_framework(content) if framework is None else framework,
        "session": (_any_word(folded, R.SESSION_STEMS) & _any_word(folded, R.SESSION_WORDS)) | form,
        "csrf": _any_word(folded, R.CSRF_WORDS),
    }


def file_signals(files: DataFrame) -> DataFrame:
    """(repo, path, file_seq, framework, session, csrf) of every file."""
    folded = files.withColumn("_low", M.fold_case(F.col("content")))
    flags = signals(F.col("content"), F.col("_low"))
    return folded.select("repo", "path", "file_seq", *[c.alias(n) for n, c in flags.items()])


def csrf_findings(flags: DataFrame) -> DataFrame:
    """At most one project-level finding per repository, from ``file_signals`` rows.

    Flags and a minimum merge on the map side: a repository with a third of all files is one row per
    task in the shuffle.
    """
    anchor = F.when(F.col("framework"), F.struct("file_seq", "path"))
    merged = flags.groupBy("repo").agg(
        F.min(anchor).alias("anchor"), F.bool_or("session").alias("session"), F.bool_or("csrf").alias("csrf")
    )
    bare = merged.where(F.col("anchor").isNotNull() & F.col("session") & ~F.col("csrf"))
    title, severity, phase, description, fix = R.TEXTS["csrf"]
    path = F.col("anchor.path")
    order = schemas.SCANNERS.index("headers")
    return schemas.as_findings(
        bare.select(
            "repo",
            path.alias("file"),
            F.lit(1).alias("line"),
            F.lit(severity).alias("severity"),
            F.lit(title).alias("title"),
            F.lit(description).alias("description"),
            F.lit("headers").alias("scanner"),
            placeholder(path, R.CSRF_PLACEHOLDER).alias("snippet"),
            F.lit(phase).alias("fix_phase"),
            F.lit(fix).alias("fix_summary"),
            F.lit(True).alias("project_level"),
            schemas.emit_seq(order, _LAST, 1).alias("emit_seq"),
        )
    )
