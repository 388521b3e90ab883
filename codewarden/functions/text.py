"""Column functions on paths, lines and identifiers (all built-in expressions)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every separator that ends a line when a text is cut into lines; line *numbers* count "\n" only.
LINE_BREAK = r"\r\n|[\n\x0B\f\r\x1C\x1D\x1E\x85\u2028\u2029]"
TRAILING_BREAK = r"(?:" + LINE_BREAK + r")\z"

# Line starts that mark a comment line.
COMMENT_START = r"^[\s\x1C-\x1F\x85\xA0]*+(?:#|//|\*|/\*)"


# Those of them that files seldom hold.
RARE_BREAKS = "\x0b\f\x1c\x1d\x1e\x85\u2028\u2029"


def split_lines(content: Column) -> Column:
    """Lines without their separators; a final separator adds no empty line, '' has no lines.

    A text whose only separators are "\\n" and "\\r\\n" is cut at a fixed text: no pattern is tried at each of its characters.
    """
    returns, crlf, lf = F.contains(content, F.lit("\r")), F.lit("\r\n"), F.lit("\n")
    alone = returns & F.contains(F.replace(content, crlf, F.lit("")), F.lit("\r"))
    rare = reduce(lambda a, b: a | b, [F.contains(content, F.lit(c)) for c in RARE_BREAKS]) | alone
    ended = F.when(F.endswith(content, crlf), F.left(content, F.length(content) - 2)).when(F.endswith(content, lf), F.left(content, F.length(content) - 1))
    whole = ended.otherwise(content)
    plain = F.split(F.when(returns, F.replace(whole, crlf, lf)).otherwise(whole), "\n", -1)
    by_pattern = F.split(F.regexp_replace(content, TRAILING_BREAK, ""), LINE_BREAK, -1)
    return F.when(F.length(content) == 0, F.array().cast("array<string>")).when(rare, by_pattern).otherwise(plain)


def newline_count(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def line_at(lines: Column, line: Column) -> Column:
    """Text of the 1-based line, NULL outside the file."""
    return F.when(line >= 1, F.get(lines, line - 1))


def snippet_at(lines: Column, line: Column) -> Column:
    """The flagged line with one neighbour on each side, clipped to the file."""
    start = F.greatest(line - 2, F.lit(0))
    end = F.least(F.size(lines), line + 1)
    return F.when(start < end, F.array_join(F.slice(lines, start + 1, end - start), "\n")).otherwise(F.lit(""))


def is_comment(line_text: Column) -> Column:
    return line_text.rlike(COMMENT_START)


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix_of(path: Column) -> Column:
    """Lower-cased last suffix with its dot; '' for `.env`, `Dockerfile` or a trailing dot."""
    return F.lower(F.regexp_extract(file_name(path), r"(?s)^.+(\.[^.]+)$", 1))


def slug(text: Column) -> Column:
    body = F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "_")
    trimmed = F.regexp_replace(body, r"^_+|_+$", "")
    return F.when(trimmed == "", F.lit("finding")).otherwise(trimmed)


def finding_id(scanner: Column, title: Column) -> Column:
    """Stable id of a finding: scanner and slug of the title."""
    return F.concat_ws("/", scanner, slug(title))


# Code-fence language of a file suffix.
LANGUAGE_BY_SUFFIX = {
    ".py": "python",
    ".js": "javascript",
    ".jsx": "javascript",
    ".mjs": "javascript",
    ".cjs": "javascript",
    ".ts": "typescript",
    ".tsx": "typescript",
    ".java": "java",
    ".go": "go",
    ".rb": "ruby",
    ".php": "php",
    ".rs": "rust",
    ".c": "c",
    ".cpp": "cpp",
    ".h": "c",
    ".sh": "bash",
    ".bash": "bash",
    ".yml": "yaml",
    ".yaml": "yaml",
    ".json": "json",
}


def lookup(key: Column, table: dict, default) -> Column:
    """Value of a small literal map, or the default."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.coalesce(F.get(F.array(F.create_map(*pairs)[key]), 0), F.lit(default))


def language_of(path: Column) -> Column:
    return lookup(suffix_of(path), LANGUAGE_BY_SUFFIX, "")


def strip(text: Column) -> Column:
    """Remove leading and trailing white space of every kind, not only blanks."""
    return F.regexp_replace(text, r"(?U)^[\s\x1C-\x1F]++|[\s\x1C-\x1F]++$", "")
