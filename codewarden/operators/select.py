"""File selection as predicates on paths: suffixes, names, skipped directories, excludes, .gitignore."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codewarden.functions import text as X
from codewarden.functions.sizes import BROADCAST_LIMIT, broadcast_if_small, measured_bytes

# Suffixes of scannable files.
SUFFIXES = (
    ".py .js .ts .jsx .tsx .mjs .cjs .java .go .rb .php .rs .c .cpp .h .yml .yaml .toml .json .env "
    ".cfg .ini .sh .bash .zsh .ps1 .bat .cmd .dockerfile .tf .hcl"
).split()
# Directories that never hold source.
SKIP_DIRS = (
    "node_modules .git __pycache__ .venv venv .tox .mypy_cache .pytest_cache dist build .next .nuxt coverage"
).split()


def is_named(path: Column) -> Column:
    """Security-relevant names that no suffix check catches: .env*, Dockerfile*, docker-compose*."""
    name = F.lower(X.file_name(path))
    return (
        name.isin(".env", "dockerfile")
        | name.startswith(".env.")
        | name.startswith("dockerfile.")
        | name.startswith("docker-compose")
    )


def is_scannable(path: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    return X.suffix_of(path).isin(*suffixes) | is_named(path)


def in_skipped_dir(path: Column) -> Column:
    """Some part of the repository-relative path is a skipped directory."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(d) for d in SKIP_DIRS]))


def _glob(segment: str, star: str, one: str, escapes: bool = False) -> str:
    """Regular expression of a shell glob; ``star`` and ``one`` say what the wildcards cross.

    With ``escapes`` a backslash takes the next character as it is.
    """
    out, i = [], 0
    while i < len(segment):
        ch = segment[i]
        i += 1
        if escapes and ch == "\\" and i < len(segment):
            out.append(re.sub(r"([^\w/ -])", r"\\\1", segment[i]))
            i += 1
        elif ch == "*":
            out.append(star)
        elif ch == "?":
            out.append(one)
        elif ch == "[" and (end := segment.find("]", i + (2 if segment[i : i + 1] in "!^" and segment[i:] else 1))) > 0:
            body = segment[i:end]
            negated = body[:1] in ("!", "^")
            body = body[1:] if negated else body
            body = body.replace("\\", "\\\\").replace("[", "\\[").replace("]", "\\]").replace("&&", "&\\&").replace("^", "\\^")
            out.append(f"[{'^' if negated else ''}{body}]")
            i = end + 1
        else:
            out.append(re.sub(r"([^\w/ -])", r"\\\1", ch))
    return "".join(out)


def exclude_regex(patterns: Sequence[str]) -> str | None:
    """One regular expression for all exclude patterns (exact path, directory prefix, or glob)."""
    parts = []
    for raw in patterns:
        pattern = raw.replace("\\", "/").strip("/")
        if pattern:
            literal = re.sub(r"([^\w/ -])", r"\\\1", pattern)
            parts.append(f"{literal}(?:/.*)?|{_glob(pattern, '.*', '.')}")
    return f"(?s)^(?:{'|'.join(parts)})\\z" if parts else None


def is_excluded(path: Column, patterns: Sequence[str]) -> Column:
    regex = exclude_regex(patterns)
    return F.lit(False) if regex is None else path.rlike(regex)


def gitignore_line(line: str) -> tuple[str, bool] | None:
    """(path regex, negated) of one .gitignore line; None where the line is no pattern."""
    pattern = line if line.endswith("\\ ") else line.rstrip()
    if not pattern or pattern.startswith("#"):
        return None
    negated = pattern.startswith("!")
    pattern = pattern[1:] if negated else pattern
    pattern = pattern[1:] if pattern[:2] in ("\\#", "\\!") else pattern
    if pattern in ("", "/"):
        return None
    anchored = "/" in pattern.rstrip("/")
    inside_only = pattern.endswith("/")
    segments = [s for s in pattern.strip("/").split("/")]
    regex = "^" if anchored and segments[0] != "**" else "^(?:.+/)?"
    segments = segments[1:] if segments[0] == "**" and len(segments) > 1 else segments
    slash = False
    for i, segment in enumerate(segments):
        last = i == len(segments) - 1
        if segment == "**":
            regex += "/.*" if last and slash else ".*" if last else "(?:/.+)?"
            inside_only = inside_only and not last
            if last:
                return regex + "$", negated
        else:
            body = "[^/]+" if segment == "*" else _glob(segment, "[^/]*", "[^/]", escapes=True)
            regex += ("/" if slash else "") + body
        slash = True
    return regex + ("/.*$" if inside_only else "(?:/.*)?$"), negated


def _parse_gitignore(text: str | None) -> list[dict]:
    found = (gitignore_line(line) for line in (text or "").splitlines())
    return [{"regex": f"(?s){f[0]}", "negated": f[1]} for f in found if f]


def gitignore_patterns(files: DataFrame) -> DataFrame:
    """One row per repository: the ordered patterns of its root .gitignore."""

    @F.pandas_udf("array<struct<regex:string,negated:boolean>>")
    def _gitignore_patterns(contents: pd.Series) -> pd.Series:
        return contents.map(_parse_gitignore)

    return files.where(F.col("path") == ".gitignore").select(
        F.col("repo").alias("_repo"), _gitignore_patterns("content").alias("_patterns")
    )


def _ignored(path: Column, patterns: Column) -> Column:
    """The last matching pattern decides; a negated pattern takes the path back in."""
    return F.aggregate(
        patterns,
        F.lit(False),
        lambda state, p: F.when(F.regexp_like(path, p["regex"]), ~p["negated"]).otherwise(state),
    )


def by_path(files: DataFrame, exclude: Sequence[str] = (), suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """Files that their path alone lets in: a filter of the scan, which moves nothing."""
    path = F.col("path")
    return files.where(is_scannable(path, suffixes) & ~in_skipped_dir(path) & ~is_excluded(path, exclude))


def _without(keep: DataFrame, patterns: DataFrame) -> DataFrame:
    joined = keep.join(patterns, keep["repo"] == patterns["_repo"], "left")
    kept = joined.where(F.col("_patterns").isNull() | ~_ignored(F.col("path"), F.col("_patterns")))
    return kept.select(*keep.columns)


def collect(
    files: DataFrame,
    exclude: Sequence[str] = (),
    suffixes: Sequence[str] = SUFFIXES,
    gitignore: bool = True,
    ignore_files: DataFrame | None = None,
) -> DataFrame:
    """Scannable files of each repository.

    Everything but .gitignore is a predicate on the path. The patterns are one row per repository:
    broadcast when measured small, so that file contents do not move; else the join moves the columns of ``files``
    (a scan goes by ``Selection``, which moves no contents). ``ignore_files`` may hold the .gitignore rows where the
    caller has them apart.
    """
    keep = by_path(files, exclude, suffixes)
    if not gitignore:
        return keep
    return _without(keep, broadcast_if_small(gitignore_patterns(files if ignore_files is None else ignore_files)))


class Selection:
    """The files of a scan, without moving contents however large the .gitignore patterns of all repositories are.

    Patterns that are measured small are broadcast, and ``files`` leaves ignored files out before they are scanned.
    Larger ones never meet the contents: ``files`` is then all that paths let in, and ``rows`` drops what was found
    in ignored files, by a join of the distinct paths of those rows with their repository's patterns.
    """

    def __init__(self, files: DataFrame, exclude: Sequence[str], ignore_files: DataFrame, limit: int = BROADCAST_LIMIT):
        self._exclude = exclude
        self._patterns = gitignore_patterns(ignore_files)
        self._small = measured_bytes(self._patterns) <= limit
        self.files = self.of(files)

    def of(self, files: DataFrame) -> DataFrame:
        """Those of ``files`` that are selected; with large patterns, ignored ones are still among them."""
        keep = by_path(files, self._exclude)
        return _without(keep, F.broadcast(self._patterns)) if self._small else keep

    def rows(self, found: DataFrame, path: str = "file") -> DataFrame:
        """``found`` (with repo and a path) without rows of ignored files."""
        if self._small:
            return found
        named = found.select("repo", F.col(path).alias("_path")).distinct()
        met = named.join(self._patterns, named["repo"] == self._patterns["_repo"]).where(_ignored(F.col("_path"), F.col("_patterns")))
        gone = met.select(F.col("repo").alias("_gone"), "_path")
        return found.join(gone, (F.col("repo") == F.col("_gone")) & (F.col(path) == F.col("_path")), "left_anti")

    def paths(self, *more: str) -> DataFrame:
        """(repo, path, file_seq) of the selected files, and columns named besides; only these columns are read."""
        return self.rows(self.files.select("repo", "path", "file_seq", *more), "path")


def single(files: DataFrame, path: str, repo: str | None = None) -> DataFrame:
    """One named file: excludes and .gitignore do not apply, the suffix or name rule does."""
    named = files.where((F.col("path") == path) & is_scannable(F.col("path")))
    return named if repo is None else named.where(F.col("repo") == repo)
