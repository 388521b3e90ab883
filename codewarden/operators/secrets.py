"""Secrets scanner: every collected file, any language, minified bundles included.

Comment lines, placeholder values and environment lookups never fire; the literal that a lookup falls
back to does, since the flagged value is judged and not its line. Like the other per-file
scanners it is a list of columns for the file pass: a whole text is matched inside its own row.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from codewarden.functions import matching as M
from codewarden.functions import text as X
from codewarden.operators.injection import HITS_DDL
from codewarden.rules import secrets as R


HITS = "_sec_hits"


def _line(h: Column) -> Column:
    return F.coalesce(X.line_at(F.col("_lines"), h["line"]), F.lit(""))


def _value(h: Column) -> Column:
    """Assigned value of a hit of the value rules, '' for the others."""
    rest = F.substr(_line(h), h["col"] + 1)
    out = F.lit("")
    for i in R.VALUE_INDEXES:
        out = F.when(h["rule"] == i, F.regexp_extract(rest, R.RULES[i].regex, 1)).otherwise(out)
    return out


def _matched(h: Column) -> Column:
    """Text judged against the placeholder and lookup lists: the value, or what follows a token's start."""
    rest = F.regexp_extract(F.substr(_line(h), h["col"] + 1), r"^[^\s'\"]+", 0)
    return F.lower(F.when(h["rule"].isin(*R.VALUE_INDEXES), _value(h)).otherwise(rest))


def is_placeholder(value: Column) -> Column:
    return F.lower(value).rlike(R.PLACEHOLDER)


def before_lines() -> list[dict[str, Column]]:
    return [{"_sec_marked": M.marked_lines("content", "_low", list(enumerate(R.RULES)), "true")}]


def wants_lines() -> Column:
    return F.size("_sec_marked") > 0


@cache
def after_lines() -> list[dict[str, Column]]:
    hits = F.filter(
        M.hits_of(F.col("_sec_marked")),
        lambda h: ~X.is_comment(_line(h)) & ~_matched(h).rlike(f"{R.LOOKUP}|{R.PLACEHOLDER}"),
    )
    shaped = F.transform(
        hits,
        lambda h: F.struct(
            h["rule"].alias("rule"),
            h["line"].alias("line"),
            F.lit(1).alias("part"),
            h["rule"].cast("bigint").alias("a"),
            h["line"].cast("bigint").alias("b"),
            h["nth"].cast("bigint").alias("c"),
            F.lit(None).cast("boolean").alias("reachable"),
        ),
    )
    none = F.array().cast(HITS_DDL)
    return [{HITS: F.coalesce(F.when(F.size("_sec_marked") > 0, shaped), none).cast(HITS_DDL)}]


def rule_rows() -> list[tuple]:
    return [(i, r.title, r.severity, r.fix_phase, r.description, R.FIX_SUMMARY) for i, r in enumerate(R.RULES)]

