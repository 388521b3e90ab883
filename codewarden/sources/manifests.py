"""Readers of dependency manifests held in a ``files`` table."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codewarden.functions import text as X
from codewarden.functions.versions import CONCRETE

# Files that mark a project root, and lockfiles in order of preference.
ROOT_MANIFESTS = ("requirements.txt", "pyproject.toml", "package.json", "Pipfile")
LOCKFILES = ("package-lock.json", "npm-shrinkwrap.json")
GITIGNORE = ".gitignore"
PIN = r"^([A-Za-z0-9][A-Za-z0-9._-]*)\s*(?:\[[^\]]*\])?\s*==\s*([^\s;#]+)"

# A JSON key with its colon, and the brace that may open its value.
KEY = r'"(?:[^"\\]++|\\.)*+":(?: \{)?'


def special_files(files: DataFrame, paths: Sequence[str] = ()) -> DataFrame:
    """Manifests, lockfiles, .gitignore and rule files: the few files read as a whole besides the scan.

    Callers materialize this once; otherwise each use would read the contents of all files again.
    """
    return files.where(is_special(F.col("path"), paths))


def is_special(path: Column, paths: Sequence[str] = ()) -> Column:
    named = X.file_name(path).isin(*ROOT_MANIFESTS, *LOCKFILES, GITIGNORE)
    return named | path.isin(*paths) if paths else named


def directory(path: Column) -> Column:
    """Directory of a repository-relative path, '' at the top."""
    return F.regexp_replace(path, r"(?s)/?[^/]*\z", "")


def _moved(side: DataFrame) -> DataFrame:
    """A side with rows for every repository: joined by moving both sides, never broadcast.

    Its rows are alike, so the shuffled bytes that a broadcast is chosen by can be few where the rows are millions.
    """
    return side.hint("merge")


def project_roots(files: DataFrame, collected: DataFrame) -> DataFrame:
    """Per repository the nearest ancestor directory of its first collected file that holds a manifest.

    Mergeable aggregates and equi-joins on (repo, directory); only paths take part.
    """
    first = collected.groupBy("repo").agg(F.min(F.struct("file_seq", "path")).alias("f"))
    parts = F.split(directory(F.col("f.path")), "/")
    depths = F.sequence(F.lit(0), F.when(directory(F.col("f.path")) == "", F.lit(0)).otherwise(F.size(parts)))
    ancestors = first.select(
        "repo",
        F.explode(
            F.transform(depths, lambda d: F.struct(d.alias("depth"), F.array_join(F.slice(parts, F.lit(1), d), "/").alias("dir")))
        ).alias("a"),
    ).select("repo", "a.*")
    manifests = (
        files.where(X.file_name(F.col("path")).isin(*ROOT_MANIFESTS))
        .select("repo", directory(F.col("path")).alias("dir"))
        .distinct()
    )
    return ancestors.join(_moved(manifests), ["repo", "dir"]).groupBy("repo").agg(F.max_by("dir", "depth").alias("root"))


def _at_root(files: DataFrame, roots: DataFrame, names) -> DataFrame:
    named = files.where(X.file_name(F.col("path")).isin(*names))
    return named.withColumn("root", directory(F.col("path"))).join(_moved(roots), ["repo", "root"])


def pins(manifests: DataFrame) -> DataFrame:
    """Exact pins of requirement files ``(repo, path, content)``: one row per pinned line."""
    lines = manifests.select("repo", "path", F.posexplode(X.split_lines(F.col("content"))).alias("pos", "raw"))
    raw = lines.withColumn("raw", X.strip(F.col("raw")))
    name = F.regexp_extract("raw", PIN, 1)
    return raw.where((name != "") & ~F.col("raw").rlike(r"^[#-]")).select(
        "repo",
        "path",
        (F.col("pos") + 1).alias("line"),
        name.alias("name"),
        F.regexp_extract("raw", PIN, 2).alias("version"),
        "raw",
        F.lit("PyPI").alias("ecosystem"),
        F.col("pos").cast("bigint").alias("ord"),
    )


def _walk(document: dict):
    """(name, version, anchor) of a lockfile's entries in document order: the flat layout, else the nested one."""
    packages = document.get("packages")
    if isinstance(packages, dict):
        for key, meta in packages.items():
            if key and isinstance(meta, dict) and not meta.get("link"):
                yield key.rpartition("node_modules/")[2], meta.get("version"), f'"{key}":'
        return
    todo = [document]
    while todo:
        node = todo.pop()
        if isinstance(node, tuple):
            name, meta = node
            yield name, meta.get("version"), f'"{name}": {{'
            node = meta
        inner = node.get("dependencies")
        if isinstance(inner, dict):
            todo.extend((name, meta) for name, meta in reversed(inner.items()) if isinstance(meta, dict))


def _entries(text: str | None) -> list[dict]:
    """Name, version (where it is a text) and anchor of every entry of a lockfile, in document order."""
    try:
        document = json.loads(text or "")
    except (ValueError, RecursionError):
        return []
    if not isinstance(document, dict):
        return []
    return [{"name": name, "version": version if isinstance(version, str) else None, "anchor": anchor} for name, version, anchor in _walk(document)]


def _parse_lock(text: str | None) -> list[dict]:
    """The plain form of :func:`lock_entries` for one text: what its joins and aggregates are compared with."""
    found: dict[tuple[str, str], str] = {}
    for e in _entries(text):
        if e["version"] is not None and re.match(CONCRETE, e["version"]):
            found.setdefault((e["name"], e["version"]), e["anchor"])
    at: dict[str, tuple[int, str]] = {}
    for number, line in enumerate(text.splitlines() if found else [], start=1):
        for key in re.findall(KEY, line):
            for anchor in (key, key.removesuffix(" {")):
                at.setdefault(anchor, (number, line.strip()))
    places = {pair: at.get(anchor, (1, anchor)) for pair, anchor in found.items()}
    return [{"name": name, "version": version, "line": line, "raw": raw} for (name, version), (line, raw) in places.items()]


def lock_entries(lockfiles: DataFrame) -> DataFrame:
    """Concrete entries of npm lockfiles ``(repo, path, content)``, first occurrence per name and version.

    Nested JSON in document order has no built-in operator, so an Arrow-batched helper lists what stands in a lockfile;
    the rest are columns, aggregates and a join: which versions are concrete, which occurrence is the first, and the
    first line of each key. Entries and lines are rows, so a lockfile of any size is no group.
    """

    @F.pandas_udf("array<struct<name:string,version:string,anchor:string>>")
    def entries(contents: pd.Series) -> pd.Series:
        return contents.map(_entries)

    rows = lockfiles.select("repo", "path", F.posexplode(entries("content")).alias("ord", "e")).select("repo", "path", "ord", "e.*")
    concrete = rows.where(F.col("version").rlike(CONCRETE)).groupBy("repo", "path", "name", "version")
    firsts = concrete.agg(F.min("ord").alias("ord"), F.min_by("anchor", "ord").alias("anchor"))
    at = anchor_lines(lockfiles).select(F.col("repo").alias("_r"), F.col("path").alias("_p"), F.col("anchor").alias("_a"), "at")
    met = firsts.join(_moved(at), (F.col("repo") == F.col("_r")) & (F.col("path") == F.col("_p")) & (F.col("anchor") == F.col("_a")), "left")
    return met.select(
        "repo", "path", F.coalesce("at.line", F.lit(1)).alias("line"), "name", "version", F.coalesce("at.raw", "anchor").alias("raw"),
        F.lit("npm").alias("ecosystem"), F.col("ord").cast("bigint").alias("ord"),
    )


def anchor_lines(lockfiles: DataFrame) -> DataFrame:
    """(repo, path, anchor, at): the first line of each JSON key with its colon, and of each key that a brace follows."""
    lines = lockfiles.select("repo", "path", F.posexplode(X.split_lines(F.col("content"))).alias("i", "text")).where(F.contains("text", F.lit('":')))
    keys = lines.withColumn("anchor", F.explode(F.regexp_extract_all("text", F.lit(KEY), F.lit(0))))
    # A key that a brace follows is an anchor with the brace and without it.
    both = F.when(F.col("anchor").endswith(" {"), F.array("anchor", F.expr("substr(anchor, 1, length(anchor) - 2)"))).otherwise(F.array("anchor"))
    place = F.struct((F.col("i") + 1).alias("line"), X.strip(F.col("text")).alias("raw"))
    return keys.select("repo", "path", F.explode(both).alias("anchor"), place.alias("at")).groupBy("repo", "path", "anchor").agg(F.min("at").alias("at"))


def broken_lockfiles(lockfiles: DataFrame) -> DataFrame:
    """(repo, path, reason) of lockfiles ``(repo, path, content)`` that hold no entries to read: a warning per file."""
    parsed = F.try_parse_json("content")
    kind = F.schema_of_variant(parsed)
    reason = F.when(F.trim(F.coalesce("content", F.lit(""))) == "", F.lit("empty file")).when(parsed.isNull(), F.lit("invalid JSON"))
    reason = reason.when(~kind.startswith("OBJECT"), F.lit("not an object"))
    return lockfiles.select("repo", "path", reason.alias("reason")).where("reason IS NOT NULL")


def preferred_lockfiles(files: DataFrame) -> DataFrame:
    """One lockfile per directory: package-lock.json before npm-shrinkwrap.json."""
    name = X.file_name(F.col("path"))
    rank = F.when(name == LOCKFILES[0], F.lit(0)).otherwise(F.lit(1))
    locks = files.where(name.isin(*LOCKFILES))
    return (
        locks.groupBy("repo", directory(F.col("path")).alias("root"))
        .agg(F.min_by(F.struct("path", "content"), rank).alias("l"))
        .select("repo", "root", "l.path", "l.content")
    )


def missing_lockfiles(files: DataFrame) -> DataFrame:
    """Directories that hold a package.json but no lockfile (a warning, not a finding)."""
    name = X.file_name(F.col("path"))
    where = directory(F.col("path")).alias("root")
    seen = files.where(name.isin("package.json", *LOCKFILES)).groupBy("repo", where).agg(
        F.bool_or(name == "package.json").alias("package"), F.bool_or(name.isin(*LOCKFILES)).alias("lock")
    )
    return seen.where("package AND NOT lock").select(
        "repo",
        "root",
        F.lit(
            "package.json without a lockfile; npm dependencies not scanned "
            "(generate one with `npm install --package-lock-only`)"
        ).alias("warning"),
    )


def requirement_files(files: DataFrame, roots: DataFrame) -> DataFrame:
    return _at_root(files, roots, ("requirements.txt",)).select("repo", "path", "content")


def lockfiles_at(files: DataFrame, roots: DataFrame) -> DataFrame:
    chosen = preferred_lockfiles(files)
    return chosen.join(_moved(roots), ["repo", "root"]).select("repo", "path", "content")
