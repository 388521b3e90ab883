"""User-defined rules: validation of rule rows, and matching over whole texts.

Rules are user input, so their patterns run in an Arrow-batched Python worker with Python's own
regex engine: they keep the syntax they were written in, and no pattern can overflow a JVM stack.
Only texts go there that some rule can match: of a suffix that it names, holding a literal that every match
of it must hold (``functions.literals``). All other texts are NULL for the worker.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codewarden import schemas
from codewarden.functions import text as X
from codewarden.functions.literals import Occurring, required
from codewarden.operators.injection import HITS_DDL

HITS = "_cus_hits"


@dataclass(frozen=True)
class CustomRule:
    """One validated user rule (a driver-side setting, like the other options)."""

    id: str
    pattern: str
    message: str
    severity: str
    fix_phase: int = 3
    suffixes: tuple[str, ...] | None = None
    fix: str = ""


# A rule row as loaded: every field as JSON text, so that a value of a wrong type is still a row.
RAW_RULES_DDL = (
    "source string, pos bigint, id string, pattern string, message string, severity string, "
    "fix_phase string, suffixes string, fix string"
)


def _pattern_problem(pattern: str | None) -> str | None:
    if not pattern:
        return None
    try:
        compiled = re.compile(pattern)
    except re.error:
        return "invalid regex"
    return "matches the empty string" if compiled.match("") else None


def validate(raw: DataFrame) -> DataFrame:
    """Adds ``reason``: why a rule row is rejected, NULL where it is accepted.

    Ids are unique per ``repo`` where the rows have one. A ``problem`` found while loading counts.

    The first otherwise valid row of an id wins. That row is found by an aggregate that combines on
    the map side (not a window over all rows of an id), so a much repeated id makes no hot task.
    """

    @F.pandas_udf("string")
    def _pattern_problems(patterns: pd.Series) -> pd.Series:
        return patterns.map(_pattern_problem)

    loading = F.col("problem") if "problem" in raw.columns else F.lit(None).cast("string")
    keys = [c for c in ("repo", "id") if c in raw.columns]
    phase = F.expr("try_cast(coalesce(fix_phase, '3') AS int)")
    checked = raw.withColumn("_regex", _pattern_problems("pattern")).withColumn(
        "_problem",
        F.when(F.coalesce(F.col("pattern"), F.lit("")) == "", F.coalesce(loading, F.lit("missing pattern")))
        .when(F.col("_regex").isNotNull(), F.col("_regex"))
        .when(F.coalesce(X.strip(F.col("message")), F.lit("")) == "", F.lit("missing message"))
        .when(~F.coalesce(F.upper("severity").isin(*schemas.SEVERITIES), F.lit(False)), F.lit("bad severity"))
        .when(
            ~F.coalesce(F.coalesce(F.col("fix_phase"), F.lit("3")).rlike(r"^[0-9]+$") & phase.between(1, 5), F.lit(False)),
            F.lit("bad fix_phase"),
        )
        .when(
            F.col("suffixes").isNotNull() & F.from_json("suffixes", "array<string>").isNull(), F.lit("bad suffixes")
        )
        .otherwise(loading),
    ).withColumn("_no_id", F.coalesce(X.strip(F.col("id")), F.lit("")) == "")
    first = (
        checked.where(F.col("_problem").isNull() & ~F.col("_no_id"))
        .groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys])
        .agg(F.min(F.struct("source", "pos")).alias("_first"))
    )
    here = F.struct("source", "pos")
    return (
        checked.join(first, [checked[k] == first[f"_k_{k}"] for k in keys], "left")
        .withColumn(
            "reason",
            F.when(F.col("_no_id"), F.coalesce(loading, F.lit("missing id")))
            .when(F.col("_first").isNotNull() & (here > F.col("_first")), F.lit("duplicate id"))
            .otherwise(F.col("_problem")),
        )
        .drop("_regex", "_problem", "_no_id", "_first", *[f"_k_{k}" for k in keys])
    )


def _matches(text: str, patterns) -> list[tuple[int, int, int]]:
    """(rule, line, n-th match) of every match of ``(rule, compiled pattern)`` pairs, in rule order."""
    hits = []
    for rule, pattern in patterns:
        line, at = 1, 0
        for nth, found in enumerate(pattern.finditer(text)):
            line, at = line + text.count("\n", at, found.start()), found.start()
            hits.append((rule, line, nth))
    return hits


# Up to so many literals are looked for in the JVM before a text is sent; of more, the worker's automaton decides.
MAX_GATE = 64


def can_match(rules: Sequence[CustomRule], suffix: str = "_suffix", content: str = "content") -> Column:
    """Whether some rule names the suffix, or none, and has one of its necessary literals in the text."""
    by_suffixes: dict[tuple[str, ...] | None, list[CustomRule]] = {}
    for rule in rules:
        by_suffixes.setdefault(None if rule.suffixes is None else tuple(sorted(set(rule.suffixes))), []).append(rule)
    conditions = []
    for suffixes, mine in by_suffixes.items():
        needs = [required(rule.pattern) for rule in mine]
        literals = {(literal, folded) for group, folded in needs if group for literal in group}
        met = F.lit(True)
        if all(group for group, _ in needs) and len(literals) <= MAX_GATE:
            met = F.lit(False)
            for folded in (False, True):
                wanted = sorted(literal for literal, low in literals if low == folded)
                text = F.lower(F.col(content)) if folded else F.col(content)
                for literal in wanted:
                    met = met | F.contains(text, F.lit(literal))
        conditions.append(met if suffixes is None else F.col(suffix).isin(*suffixes) & met if suffixes else F.lit(False))
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def before_lines(rules: Sequence[CustomRule]) -> list[dict[str, Column]]:
    """Hits of the user's rules in rule order; comment lines are *not* skipped."""
    compiled = [(r.pattern, set(r.suffixes) if r.suffixes is not None else None) for r in rules]

    @F.pandas_udf(HITS_DDL)
    def match(suffix: pd.Series, content: pd.Series) -> pd.Series:
        patterns = [(i, re.compile(p), only, *required(p)) for i, (p, only) in enumerate(compiled)]
        plain = Occurring({x for _, _, _, group, folded in patterns if group and not folded for x in group})
        lower = Occurring({x for _, _, _, group, folded in patterns if group and folded for x in group})

        def one(name: str, text: str | None) -> list[dict]:
            if text is None:
                return []
            there, there_low = plain.of(text), lower.of(text.lower()) if lower.literals else set()
            wanted = [
                (i, p) for i, p, only, group, folded in patterns
                if (only is None or name in only) and (group is None or not group.isdisjoint(there_low if folded else there))
            ]
            return [
                {"rule": i, "line": line, "part": 0, "a": i, "b": nth, "c": 0, "reachable": None}
                for i, line, nth in _matches(text, wanted)
            ]

        return pd.Series([one(s, t) for s, t in zip(suffix, content)], dtype=object)

    return [{HITS: match("_suffix", F.when(can_match(rules), F.col("content")))}]


def wants_lines() -> Column:
    return F.size("_cus_hits") > 0


def rule_rows(rules: Sequence[CustomRule]) -> list[tuple]:
    return [(i, r.id, r.severity.upper(), r.fix_phase, r.message, r.fix) for i, r in enumerate(rules)]



def with_needs(rules: DataFrame) -> DataFrame:
    """Adds ``needs`` to rule rows: literals of which a match must hold one, as they are and in lower case, or ``open``."""

    @F.pandas_udf("struct<open:boolean,plain:array<string>,low:array<string>>")
    def needs(patterns: pd.Series) -> pd.DataFrame:
        found = [required(p) for p in patterns]
        sides = {name: [sorted(group) if group and folded == low else [] for group, low in found] for name, folded in (("plain", False), ("low", True))}
        return pd.DataFrame({"open": [group is None for group, _ in found], **sides})

    return rules.withColumn("needs", needs("pattern"))


def rules_per_row(files: DataFrame) -> DataFrame:
    """Findings of files that carry their own rules in ``_rules`` (an array of rule structs, see :func:`with_needs`).

    A file is sent to the worker when the suffix and a literal of one of its own rules let it match.
    """
    suffix, content = X.suffix_of(F.col("path")), F.col("content")

    def possible(r: Column) -> Column:
        fits = r["suffixes"].isNull() | F.array_contains(r["suffixes"], suffix)
        plain = F.exists(r["needs"]["plain"], lambda x: F.contains(content, x))
        return fits & (r["needs"]["open"] | plain | F.exists(r["needs"]["low"], lambda x: F.contains(F.lower(content), x)))

    files = files.withColumn("_sent", F.when(F.exists("_rules", possible), content))

    @F.pandas_udf("array<struct<rule:int,line:int,nth:int>>")
    def match(suffix: pd.Series, content: pd.Series, rules: pd.Series) -> pd.Series:
        compiled = lru_cache(maxsize=4096)(re.compile)

        def one(name: str, text: str, mine) -> list[dict]:
            wanted = [
                (i, compiled(r["pattern"]))
                for i, r in enumerate(mine)
                if r["suffixes"] is None or name in list(r["suffixes"])
            ]
            return [{"rule": i, "line": line, "nth": nth} for i, line, nth in _matches(text, wanted)]

        return pd.Series([[] if t is None else one(s, t, r) for s, t, r in zip(suffix, content, rules)], dtype=object)

    scanned = (
        files.withColumn("_hits", match(X.suffix_of(F.col("path")), "_sent", "_rules"))
        .withColumn("_lines", F.when(F.size("_hits") > 0, X.split_lines(F.col("content"))))
    )
    rows = scanned.select(
        "repo",
        F.col("path").alias("file"),
        "file_seq",
        F.explode(
            F.transform(
                "_hits",
                lambda h: F.struct(
                    h["line"].alias("line"),
                    h["rule"].alias("nr"),
                    h["nth"].alias("nth"),
                    F.get("_rules", h["rule"]).alias("r"),
                    X.snippet_at(F.col("_lines"), h["line"]).alias("snippet"),
                    X.line_at(F.col("_lines"), h["line"]).alias("line_text"),
                ),
            )
        ).alias("x"),
    )
    order = schemas.SCANNERS.index("custom")
    return schemas.as_findings(
        rows.select(
            "repo",
            "file",
            "x.line",
            "x.r.severity",
            F.col("x.r.id").alias("title"),
            F.col("x.r.message").alias("description"),
            F.lit("custom").alias("scanner"),
            "x.snippet",
            "x.r.fix_phase",
            F.col("x.r.fix").alias("fix_summary"),
            "x.line_text",
            schemas.emit_seq(order, F.col("file_seq"), 0, F.col("x.nr"), F.col("x.nth")).alias("emit_seq"),
        )
    )
