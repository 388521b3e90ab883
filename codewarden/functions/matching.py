"""Regular-expression matching with line attribution, inside one row and without a UDF.

A rule's pattern runs once over the whole text: each match gets a mark put in front of it, the
marked text is cut at "\\n", and only lines that hold a mark are kept. The line number is then the
position in that cut and the column is what stands before the mark, so nothing is counted twice and
no row leaves its partition.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Three noncharacters in a row: text that is valid for interchange never holds them.
MARK = "\ufdd0\ufdd1\ufdd2"

# Matches "i" where case is ignored, but lower case makes two characters of it.
DOTTED_I = "\u0130"


def java_regex(pattern: str, ignore_case: bool = False, multiline: bool = False) -> str:
    """Flags under which the JVM engine reads a pattern as a Unicode pattern with "\\n" line ends."""
    return f"(?dU{'iu' if ignore_case else ''}{'m' if multiline else ''}){pattern}"


def fold_case(text: Column) -> Column:
    """Lower case, with the two letters that match ASCII letters only when case is ignored."""
    low = F.lower(text)  # of no other letter lower case makes one of the two
    two = F.contains(text, F.lit("\u017f")) | F.contains(text, F.lit("\u0131"))
    return F.when(two, F.replace(F.replace(low, F.lit("\u017f"), F.lit("s")), F.lit("\u0131"), F.lit("i"))).otherwise(low)


def sql_text(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


# Letters of texts and programs, the frequent ones first; all other characters are rare.
_FREQUENT = " etaoinsrhldcumpfgwyb.,v_()kxjqz"


def _tail(literal: str) -> str:
    """The end of a literal, of three characters at least, that begins with the rarest character."""
    starts = range(max(1, len(literal) - 2))
    rank = lambda i: _FREQUENT.find(literal[i]) % (len(_FREQUENT) + 1)
    return literal[max(starts, key=lambda i: (rank(i), -i)) :]


def has_sql(hay: str, literal: str) -> str:
    """Whether a literal occurs. It is compared wherever its first byte stands, so an end of it that begins with a rarer
    letter is looked for first: a text without that end does not have the whole."""
    found, tail = f"contains({hay}, {sql_text(literal)})", _tail(literal)
    return found if tail == literal else f"(contains({hay}, {sql_text(tail)}) AND {found})"


def has(hay: Column, literal: str) -> Column:
    """:func:`has_sql` of a column."""
    found, tail = F.contains(hay, F.lit(literal)), _tail(literal)
    return found if tail == literal else F.contains(hay, F.lit(tail)) & found


def starting(start: str, regex: str) -> str:
    """``regex``, at whose matches' start another pattern matches: a few character classes (with both cases of a letter
    where case is ignored), which are quick to fail, so that the engine tries nothing else at most characters."""
    return f"(?={start}){regex}" if start else regex


def gate_sql(text: str, folded: str, anchors, ignore_case: bool) -> str:
    """Cheap necessary condition of a match: for each group, one of its literals occurs."""
    hay = folded if ignore_case else text
    groups = [" OR ".join(has_sql(hay, x) for x in group) for group in anchors]
    return " AND ".join(f"({g})" for g in groups) or "true"


def gate(text: str, folded: str, anchors, ignore_case: bool) -> Column:
    return F.expr(gate_sql(text, folded, anchors, ignore_case))


def marked_sql(content: str, rule: int, regex: str) -> str:
    """array<struct<rule,line,marked>>: every "\\n"-line in which a match starts.

    The text is only cut into lines when there is a match. Written as one SQL expression per rule, so
    that a plan of many rules is one parse and not thousands of calls into the JVM.
    """
    marked = f"array(regexp_replace({content}, {sql_text(regex)}, {sql_text(MARK + '$0')}))"
    lines = (
        f"filter(transform(split(m, '\\n', -1), (t, i) -> named_struct('rule', {rule}, 'line', i + 1, 'marked', t)), "
        f"x -> contains(x.marked, {sql_text(MARK)}))"
    )
    return f"flatten(transform(filter({marked}, m -> contains(m, {sql_text(MARK)})), m -> {lines}))"


def marked_lines(content: str, folded: str, rules, wanted: str) -> Column:
    """Marked lines of ``(index, rule)`` pairs; a pattern only runs where its literals occur."""
    none = "cast(array() as array<struct<rule:int,line:int,marked:string>>)"
    parts = [
        f"CASE WHEN ({wanted}) AND {gate_sql(content, folded, rule.anchors, rule.ignore_case)} "
        f"THEN {marked_sql(content, index, rule.regex)} ELSE {none} END"
        for index, rule in rules
    ]
    return F.expr(f"concat({', '.join(parts)})")


def hits_of(marked: Column) -> Column:
    """array<struct<rule,line,col,nth>>: one entry per match, col counts characters from 0."""

    def per_line(x):
        pieces = F.split(x["marked"], MARK, -1)
        return F.transform(
            F.sequence(F.lit(1), F.size(pieces) - 1),
            lambda k: F.struct(
                x["rule"].alias("rule"),
                x["line"].alias("line"),
                F.length(F.array_join(F.slice(pieces, F.lit(1), k), "")).alias("col"),
                k.alias("nth"),
            ),
        )

    return F.flatten(F.transform(marked, per_line))


def first_match_line(content: Column, regex: str) -> Column:
    """1-based line of the first match (call it only where there is one)."""
    newlines = lambda before: F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit("")))
    return F.get(F.transform(F.array(F.get(F.split(content, regex, 2), 0)), newlines), 0) + 1  # what stands before is cut off once
