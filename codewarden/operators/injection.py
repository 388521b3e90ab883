"""Injection scanner: pattern rules, weak randomness, JavaScript and Python sinks.

The scanner is a list of columns for the file pass (``plans.file_pass``): each step reads earlier
ones, so Catalyst keeps every expensive value in its own projection instead of repeating it. Nothing
here shuffles: the scan of a file needs only the file.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codewarden.functions import matching as M
from codewarden.functions import text as X
from codewarden.operators import facts_py, taint_js, taint_py
from codewarden.rules import injection as R
from codewarden.rules import taint as T

HITS = "_inj_hits"
HITS_DDL = "array<struct<rule:int,line:int,part:int,a:bigint,b:bigint,c:bigint,reachable:boolean>>"


def _empty(ddl: str) -> Column:
    return F.array().cast(ddl)


def named_bundle(path: Column) -> Column:
    """Generated bundle by its name: the lexical rules leave it out (see ``skipped``)."""
    return X.file_name(path).rlike(R.MINIFIED_NAME)


def looks_minified(path: Column, lines: Column) -> Column:
    """Generated bundle, by its name or by a very long line: a flag, which by itself skips nothing."""
    return named_bundle(path) | F.exists(lines, lambda t: F.length(t) > R.MINIFIED_MAX_LINE)


def skipped(files: DataFrame) -> DataFrame:
    """(repo, path, reason) of code files that the lexical rules do not read."""
    code = X.suffix_of(F.col("path")).isin(*T.CODE_SUFFIXES) & (X.suffix_of(F.col("path")) != ".py")
    return files.where(code & named_bundle(F.col("path"))).select("repo", "path", F.lit("generated bundle").alias("reason"))


def _weak_random_hits(lines: Column) -> Column:
    keyword = M.java_regex(R.SECURITY_KEYWORD, ignore_case=True)
    numbered = F.transform(lines, lambda t, i: F.struct(t.alias("t"), (i + 1).alias("line")))
    weak = F.filter(
        numbered,
        lambda x: F.contains(x["t"], F.lit("andom"))
        & x["t"].rlike(M.java_regex(R.WEAK_RANDOM_CALL))
        & x["t"].rlike(keyword)
        & ~X.is_comment(x["t"]),
    )
    return F.transform(
        weak,
        lambda x: F.struct(
            F.lit(R.INDEX["Weak randomness for security value"]).alias("rule"),
            x["line"].alias("line"),
            F.lit(2).alias("part"),
            x["line"].cast("bigint").alias("a"),
            F.lit(0).cast("bigint").alias("b"),
            F.lit(0).cast("bigint").alias("c"),
            F.lit(None).cast("boolean").alias("reachable"),
        ),
    )


def taint_columns(files: DataFrame) -> DataFrame:
    """Adds suffix, lines, definitions and the taint environment of JavaScript files."""
    js = F.col("_suffix").isin(*T.JS_SUFFIXES)
    return (
        files.withColumn("_suffix", X.suffix_of(F.col("path")))
        .withColumn("_lines", X.split_lines(F.col("content")))
        .withColumn("_defs", F.when(js, taint_js.definitions(F.col("_lines"))))
        .withColumn("_tainted", taint_js.tainted_names(F.col("_defs")))
        .withColumn("_constants", taint_js.constant_names(F.col("_defs"), F.col("_tainted")))
    )


@cache
def before_lines() -> list[dict[str, Column]]:
    return [
        {"_syntax": facts_py.facts(F.when(F.col("_suffix") == ".py", F.col("content")))},
        {"_facts": taint_py.judged(F.col("_syntax"))},
        {"_parsed": F.col("_facts").isNotNull()},
    ]


def wants_lines() -> Column:
    return F.col("_code")


@cache
def after_lines() -> list[dict[str, Column]]:
    """The scan's columns, level by level; ``_inj_hits`` holds the hits of a file in emission order."""
    content = F.col("content")
    js = F.col("_suffix").isin(*T.JS_SUFFIXES)
    numbered = list(enumerate(R.PATTERN_RULES))
    regex_rules = [(i, rule) for i, rule in numbered if i not in R.XSS_INDEXES]
    xss_rules = [(i, rule) for i, rule in numbered if i in R.XSS_INDEXES]
    no_names = _empty("array<string>")
    pattern_hits = F.filter(
        F.transform(
            M.hits_of(F.col("_marked")),
            lambda h: F.struct(
                h["rule"].alias("rule"),
                h["line"].alias("line"),
                F.lit(1).alias("part"),
                h["rule"].cast("bigint").alias("a"),
                h["line"].cast("bigint").alias("b"),
                h["nth"].cast("bigint").alias("c"),
                _pattern_verdict(h, js).alias("reachable"),
            ),
        ),
        lambda h: ~_on_comment(h) & ~(h["reachable"].eqNullSafe(F.lit(False)) & h["rule"].isin(*R.XSS_INDEXES)),
    )

    def where(condition: Column, hits: Column) -> Column:
        return F.coalesce(F.when(condition, hits), _empty(HITS_DDL)).cast(HITS_DDL)

    py = F.col("_parsed")
    marked = F.size("_marked") > 0
    return [
        {
            # Files whose text the lexical rules read: code that is no generated bundle.
            "_open": F.col("_code") & ((F.col("_suffix") == ".py") | ~named_bundle(F.col("path"))),
            "_py_tainted": taint_py.reached(F.col("_facts")),
        },
        {
            "_marked": F.concat(
                M.marked_lines("content", "_low", regex_rules, "_open AND NOT _parsed"),
                M.marked_lines("content", "_low", xss_rules, "_open"),
            ),
            "_source": F.col("_open") & js & taint_js.source_gate("content", "_low") & taint_js.has_source(content),
            "_py_constants": F.when(py, taint_py.constant_names(F.col("_facts"), F.col("_py_tainted"))),
        },
        # The environment is only needed where a source occurs or where a hit asks for its verdict.
        {"_defs": F.when(js & (F.col("_source") | marked), taint_js.definitions(F.col("_lines")))},
        {"_tainted": F.coalesce(taint_js.tainted_names(F.when(F.col("_source"), F.col("_defs"))), no_names)},
        {
            "_constants": F.coalesce(
                F.when(marked, taint_js.constant_names(F.col("_defs"), F.col("_tainted"))), no_names
            )
        },
        {
            HITS: F.concat(
                where(py, taint_py.sink_hits(F.col("_facts"), F.col("_py_tainted"), F.col("_py_constants"))),
                where(marked, pattern_hits),
                where((F.col("_open") | py) & M.has(content, "andom"), _weak_random_hits(F.col("_lines"))),
                where(F.col("_source"), taint_js.sink_hits(F.col("_lines"), F.col("_tainted"))),
            )
        },
    ]


def _flagged_line(h: Column) -> Column:
    return F.coalesce(X.line_at(F.col("_lines"), h["line"]), F.lit(""))


def _on_comment(h: Column) -> Column:
    return X.is_comment(_flagged_line(h))


def _pattern_verdict(h: Column, js: Column) -> Column:
    """Verdict on the text from the match to its line's end (JavaScript)."""
    rest = F.substr(_flagged_line(h), h["col"] + 1)
    return F.when(js, taint_js.reachable(rest, F.col("_tainted"), F.col("_constants")))


def rule_rows() -> list[tuple]:
    """(rule, title, severity, fix_phase, description, fix_summary) of every rule."""
    return [(i, r.title, r.severity, r.fix_phase, r.description, R.FIX_SUMMARY) for i, r in enumerate(R.RULES)]

