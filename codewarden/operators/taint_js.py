"""Lexical taint of JavaScript/TypeScript files, as expressions inside the file's row.

The environment is one forward pass over the file's definitions, with the tainted names in a hash set
(``closure.forward``): linear in the definitions, in the file's row, without a join, a shuffle or a
fixpoint loop. Definitions, sources, literals and uses are columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from codewarden.functions.matching import gate, starting
from codewarden.functions.text import is_comment
from codewarden.operators.closure import forward_names
from codewarden.rules import taint as T
from codewarden.rules.injection import INDEX

_NO_TEXTS = "array<string>"
SOURCE = starting("[rcwldp][etior][qxnco][u.dac]", T.JS_SOURCE)
HITS_DDL = "array<struct<rule:int,line:int,part:int,a:bigint,b:bigint,c:bigint,reachable:boolean>>"


def identifiers(text: Column) -> Column:
    """Root identifiers of an expression without language words (words in strings count too)."""
    found = F.regexp_extract_all(text, F.lit(T.JS_IDENT), F.lit(0))
    return F.array_except(found, F.array(*[F.lit(w) for w in T.JS_KEYWORDS]))


def has_source(text: Column) -> Column:
    return text.rlike(SOURCE)


def source_gate(content: str, folded: str) -> Column:
    return gate(content, folded, T.JS_SOURCE_ANCHORS, False)


def _bound_name(part: Column) -> Column:
    """Name bound by one element of a destructuring: the last identifier before a default."""
    names = F.regexp_extract_all(F.substring_index(part, "=", 1), F.lit(T.JS_IDENT), F.lit(0))
    return F.element_at(F.when(F.size(names) > 0, names), -1)


_CUT = "\ufdd3"


def definition(line: Column, number: Column) -> Column:
    """struct<line,names,rhs>: what a line defines; no names where it defines nothing.

    One run of one pattern yields all its groups: the line is replaced by them and cut again. No inner function
    reads a variable of an outer one: Spark would not take such a value to Python.
    """
    groups = F.regexp_replace(line, T.JS_DEFINITION, _CUT + _CUT.join(f"${i}" for i in range(1, 7)))

    def bound(cut: Column) -> Column:
        parts = cut["parts"]
        group = lambda i: F.get(parts, i)
        destructured = F.array_compact(F.transform(F.split(group(1), ","), _bound_name))
        names = (
            F.when(F.size(parts) < 7, F.array().cast(_NO_TEXTS))
            .when(group(2) != "", destructured)
            .otherwise(F.array(F.concat(group(3), group(5))))
        )
        return F.struct(cut["line"].alias("line"), names.alias("names"), F.concat(group(2), group(4), group(6)).alias("rhs"))

    cut = F.struct(number.alias("line"), F.split(groups, _CUT, -1).alias("parts"))
    return F.get(F.transform(F.array(cut), bound), 0)


def definitions(lines: Column) -> Column:
    """array<struct<line,names,src,const,uses>> of a file, in line order."""
    numbered = F.transform(lines, lambda t, i: F.struct(t.alias("t"), (i + 1).alias("n")))
    usable = F.filter(numbered, lambda x: F.contains(x["t"], F.lit("=")))
    found = F.filter(F.transform(usable, lambda x: definition(x["t"], x["n"])), lambda d: F.size(d["names"]) > 0)
    return F.transform(
        found,
        lambda d: F.struct(
            d["line"].alias("line"),
            d["names"].alias("names"),
            has_source(d["rhs"]).alias("src"),
            d["rhs"].rlike(T.JS_CONST_RHS).alias("const"),
            identifiers(d["rhs"]).alias("uses"),
        ),
    )


def tainted_names(defs: Column) -> Column:
    """Names that a source reached by the end of the file; taint is sticky."""
    return forward_names(defs)


def constant_names(defs: Column, tainted: Column) -> Column:
    """Names all of whose definitions are literals."""

    def names(keep) -> Column:
        return F.flatten(F.transform(F.filter(defs, keep), lambda d: d["names"]))

    return F.array_except(F.array_except(names(lambda d: d["const"]), names(lambda d: ~d["const"])), tainted)


def reachable(text: Column, tainted: Column, constants: Column) -> Column:
    """True: a source or tainted name occurs; False: constants only; NULL: undetermined."""
    # One evaluation of the identifiers, bound through a one-element array.
    return F.get(
        F.transform(
            F.array(identifiers(text)),
            lambda names: F.when(has_source(text) | F.arrays_overlap(names, tainted), F.lit(True)).when(
                (F.size(names) > 0) & (F.size(F.array_except(names, constants)) == 0), F.lit(False)
            ),
        ),
        0,
    )


# Sinks in the order in which one line reports them: title, pattern, argument groups.
SINKS = [
    ("NoSQL query with user-controlled value", T.JS_NOSQL_SINK, 1, "find delete update"),
    ("SQL query with user-controlled string", T.JS_QUERY_IDENT_SINK, 1, "query execute"),
    ("exec() with user-controlled command", T.JS_EXEC_IDENT_SINK, 1, "exec"),
    ("Path traversal", T.JS_PATH_SINK, 1, ""),
    ("Server-side request forgery (SSRF)", T.JS_SSRF_SINK, 2, "fetch axios got superagent http request"),
    ("Insecure deserialization", T.JS_DESERIALIZE_SINK, 1, "unserialize"),
    ("Open redirect", T.JS_REDIRECT_SINK, 1, "redirect"),
]
_BARE_NAME_SINKS = {"SQL query with user-controlled string", "exec() with user-controlled command"}


def _arguments(line: Column, pattern: str, groups: int) -> Column:
    """Argument text of every sink call on a line."""
    first = F.regexp_extract_all(line, F.lit(pattern), F.lit(1))
    if groups == 1:
        return first
    second = F.regexp_extract_all(line, F.lit(pattern), F.lit(2))
    return F.transform(first, lambda a, i: F.when(a != "", a).otherwise(F.get(second, i)))


def sink_hits(lines: Column, tainted: Column) -> Column:
    """array<struct<rule,line,part,a,b,c,reachable>> of sinks an untrusted value reaches."""

    def reaches(title: str, arg: Column) -> Column:
        if title in _BARE_NAME_SINKS:
            return F.array_contains(tainted, arg)
        if title.startswith("NoSQL"):
            arg = F.regexp_replace(arg, T.JS_OBJECT_KEY, "")
        return F.coalesce(has_source(arg) | F.arrays_overlap(identifiers(arg), tainted), F.lit(False))

    def sink_on_line(text: Column, i: Column, order: int) -> Column:
        title, pattern, groups, words = SINKS[order]

        def hit(arg: Column, k: Column) -> Column:
            return F.when(
                reaches(title, arg),
                F.struct(
                    F.lit(INDEX[title]).alias("rule"),
                    (i + 1).alias("line"),
                    F.lit(3).alias("part"),
                    (i + 1).cast("bigint").alias("a"),
                    F.lit(order).cast("bigint").alias("b"),
                    k.cast("bigint").alias("c"),
                    F.lit(True).alias("reachable"),
                ),
            )

        hits = F.array_compact(F.transform(_arguments(text, pattern, groups), hit))
        if not words:
            return hits
        seen = reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words.split()])
        return F.coalesce(F.when(seen, hits), F.array().cast(HITS_DDL))

    def on_line(text: Column, i: Column) -> Column:
        return F.concat(*[sink_on_line(text, i, order) for order in range(len(SINKS))])

    eligible = F.filter(
        F.transform(lines, lambda t, i: F.struct(t.alias("t"), i.alias("i"))),
        lambda x: F.contains(x["t"], F.lit("(")) & ~is_comment(x["t"]),
    )
    return F.flatten(F.transform(eligible, lambda x: on_line(x["t"], x["i"])))
