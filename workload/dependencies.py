"""Queries of dependency analysis, over manifests and advisories derived from parts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from codewarden.operators import deps, fix
from codewarden.session import shared_dir
from codewarden.sources import manifests as M
from workload import corpus
from workload.corpus import quoted as q

NL = "\n"
# Texts with {column} parts, used to build each manifest on both sides.
REQUIREMENTS = (
    "# pinned" + NL + "-r base.txt" + NL + "{under}==1.{size}.{patch}" + NL
    + "  Flask[async] == 0.{size}; python_version > '3'" + NL + "My_Pkg.Name==1.{patch}.0rc1" + NL + "loose>=1.0" + NL + "{under}[x]==9.0.0 # twice" + NL
)
LOCK_FLAT = """{
  "name": "app",
  "lockfileVersion": 3,
  "packages": {
    "": {"name": "app", "version": "1.0.0"},
    "node_modules/{dash}": {
      "version": "1.{size}.0"
    },
    "node_modules/a/node_modules/{dash}": {
      "version": "1.{size}.0"
    },
    "node_modules/@s/lib": { "version": "2.0.{patch}" },
    "node_modules/git": { "version": "git+ssh://x" },
    "node_modules/ws": { "link": true, "version": "1.1.1" }
  }
}
"""
LOCK_NESTED = """{
  "dependencies": {
    "{dash}": {
      "version": "1.{size}.0",
      "requires": {"deep": "^0.1.0"},
      "dependencies": {
        "deep": {
          "version": "0.1.{size}"
        },
        "{dash}": {
          "version": "1.{size}.0"
        }
      }
    },
    "local": {
      "version": "file:../x"
    }
  }
}
"""
PARTS = {
    "dir": "CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'src/' WHEN 2 THEN 'src/app/' ELSE 'other/' END",
    "under": "replace(p_name, ' ', '_')",
    "dash": "replace(p_name, ' ', '-')",
    "size": "CAST(p_size AS {text})",
    "patch": "CAST(p_partkey % 3 AS {text})",
}
# name, which parts have it, text
MANIFESTS = [
    ("requirements.txt", "p_partkey % 3 <> 0", REQUIREMENTS),
    ("package-lock.json", "p_partkey % 2 = 0", LOCK_FLAT),
    ("npm-shrinkwrap.json", "p_partkey % 3 = 0", LOCK_NESTED),
    ("package.json", "p_partkey % 5 <> 0", "{}"),
]


def _fill_sql(text: str) -> str:
    out = q(text)
    for name in ("under", "dash", "size", "patch"):
        out = f"replace({out}, '{{{name}}}', {name})"
    return out


def files(spark, sf):
    part = corpus.table(spark, sf, "part", "p_partkey").select("p_partkey", "p_name", "p_size")
    base = part.selectExpr("p_partkey", *[f"{sql.format(text='string')} AS {name}" for name, sql in PARTS.items()])

    def fill(text):
        out = F.lit(text)
        for name in ("under", "dash", "size", "patch"):
            out = F.replace(out, F.lit("{" + name + "}"), F.col(name))
        return out

    entries = [
        F.when(F.expr(cond), F.struct(F.concat("dir", F.lit(name)).alias("path"), fill(text).alias("content"), F.lit(i + 2).alias("i")))
        for i, (name, cond, text) in enumerate(MANIFESTS)
    ]
    source = F.struct(F.lit("src/app/main.py").alias("path"), F.lit("x = 1\n").alias("content"), F.lit(1).alias("i"))
    rows = base.select("p_partkey", F.explode(F.array_compact(F.array(source, *entries))).alias("f"))
    return rows.select(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("repo"),
        "f.path",
        F.col("f.i").cast("bigint").alias("file_seq"),
        "f.content",
    )


def collected(spark, sf):
    return files(spark, sf).where(F.col("path").endswith(".py") | F.col("path").endswith(".json"))


def advisories(spark, sf, named=True):
    part = spark.read.parquet(f"{sf}/part.parquet").select("p_name")
    names = part.distinct().withColumn("n", F.length("p_name"))
    event = lambda i, f, a="null": f"named_struct('introduced', {i}, 'fixed', {f}, 'last_affected', cast({a} as string))"
    none = "cast(null as string)"
    q1 = lambda v: f"'{v}'"
    span = lambda kind, *events: f"named_struct('type', '{kind}', 'events', array({', '.join(events)}))"
    entry = lambda eco, name, versions, *ranges: (
        f"named_struct('package', named_struct('ecosystem', '{eco}', 'name', {name}), 'versions', {versions}, 'ranges', array({', '.join(ranges)}))"
    )
    # Two ranges that overlap, one of commits that must not count, a pre-release and a last affected version.
    pypi = entry(
        "PyPI", "upper(replace(p_name, ' ', '.'))", "cast(array() as array<string>)",
        span("ECOSYSTEM", event(q1("1.10.0.dev1"), none), event(none, q1("1.25.0"))),
        span("GIT", event(q1("0"), none), event(none, q1("ffff"))),
    )
    npm = entry(
        "npm", "replace(p_name, ' ', '-')", "array('1.30.0')",
        span("SEMVER", event(q1("0"), none), event(none, q1("1.5.0-rc.1"))),
        span("SEMVER", event(q1("1.40.0-rc.1"), none), event(none, none, q1("1.45.9"))),
        span("SEMVER", event(q1("1.42.0"), none), event(none, q1("1.43.0"))),
    )
    return names.selectExpr(
        "concat('GHSA-', replace(p_name, ' ', '-')) AS id",
        "CASE n % 3 WHEN 0 THEN cast(null AS string) WHEN 1 THEN ' Bad thing\\nmore' ELSE '' END AS summary",
        "CASE n % 2 WHEN 0 THEN 'Details first\\nsecond' END AS details",
        "CASE n % 5 WHEN 0 THEN 'MODERATE' WHEN 1 THEN 'low' WHEN 2 THEN 'weird' WHEN 3 THEN 'CRITICAL' END AS label",
        f"array({pypi}, {npm}) AS affected",
    ).withColumn("database_specific", F.struct(F.col("label").alias("severity")))


def found(spark, sf):
    return deps.findings(files(spark, sf), collected(spark, sf), advisories(spark, sf))


COLUMNS = ["repo", "file", "line", "severity", "title", "description", "snippet", "fix_summary"]


def deps_no_details(spark, sf):
    everything = deps.dependencies(files(spark, sf), collected(spark, sf))
    known = advisories(spark, sf)
    matches = deps.match(everything, known)
    return deps.findings_of(everything, matches, known.where("length(id) % 2 = 0")).select(*COLUMNS)


def deps_read_advisories(spark, sf):
    """The advisories as published files, one object each, and what the reader takes from them."""
    path = f"{shared_dir(spark)}/advisories-{uuid.uuid4().hex}"
    extra = F.struct(F.lit("1.6.0").alias("schema_version"), F.array(F.lit("CVE-1")).alias("aliases"))
    advisories(spark, sf).withColumn("_more", extra).write.option("maxRecordsPerFile", 1).json(path)
    read = deps.read_advisories(spark, path)
    entries = deps.affected_packages(read)
    return entries.groupBy("vuln_id").agg(
        F.count(F.lit(1)).alias("packages"), F.sum(F.size("ranges")).alias("ranges"), F.sum(F.coalesce(F.size("versions"), F.lit(0))).alias("versions")
    )


def deps_first_fix(spark, sf):
    a = advisories(spark, sf)
    rows = a.select("id", "affected", F.explode(F.array(F.lit("PyPI"), F.lit("npm"))).alias("ecosystem"))
    name = F.regexp_replace("id", "^GHSA-", "")
    return rows.select("id", "ecosystem", deps.first_fixed(F.col("affected"), F.col("ecosystem"), name).alias("fixed"))


def lock(name):
    def query(spark, sf):
        rows = files(spark, sf).where(F.col("path").endswith(name))
        return M.lock_entries(rows).select("repo", "path", "line", "name", "version", "raw")

    return query


_BROKEN = "CASE p_partkey % 7 WHEN 1 THEN substr(content, 1, length(content) - 3) WHEN 2 THEN ' ' WHEN 3 THEN concat('[', content, ']') ELSE content END"


def broken(spark, sf):
    """The lockfiles, some of them cut short, blank, or inside a list."""
    number = F.expr("cast(substr(repo, 2) AS bigint)").alias("p_partkey")
    locks = files(spark, sf).where(F.col("path").rlike("(package-lock|npm-shrinkwrap)[.]json$"))
    return locks.select("repo", "path", "content", number).withColumn("content", F.expr(_BROKEN))


def deps_rejects(spark, sf):
    return M.broken_lockfiles(broken(spark, sf))


def deps_broken_entries(spark, sf):
    """What the readable ones among them give."""
    return M.lock_entries(broken(spark, sf)).select("repo", "path", "line", "name", "version", "raw")


def fix_pin(spark, sf):
    return fix.pin_fixes(found(spark, sf), files(spark, sf)).select("repo", "file", "line", "title", "old_line", "new_line", "new_content", "summary")


def fix_pin_verify(spark, sf):
    """Pins as raised, and as they would be with a release of their own name only: a line that stays is not fixed."""
    fixes = fix.pin_fixes(found(spark, sf), files(spark, sf))
    kept = F.expr("length(repo) % 2 = 0")
    some = fixes.withColumn("new_content", F.when(kept, F.replace("new_content", F.concat("new_line", F.lit(NL)), F.concat("old_line", F.lit(NL)))).otherwise(F.col("new_content")))
    return fix.verify_pin_fixes(some).select("repo", "file", "line", "title", "fixed")


def fix_pin_composed(spark, sf):
    all_files = files(spark, sf)
    return fix.compose(fix.line_edits(found(spark, sf), all_files), all_files).select("repo", "path", "new_content")


QUERIES = {
    "deps_root": lambda spark, sf: M.project_roots(files(spark, sf), collected(spark, sf)),
    "deps_pins": lambda spark, sf: M.pins(files(spark, sf).where(F.col("path").endswith("requirements.txt"))).select("repo", "path", "line", "name", "version", "raw"),
    "deps_lock_v3": lock("package-lock.json"),
    "deps_lock_v1": lock("npm-shrinkwrap.json"),
    "deps_rejects": deps_rejects,
    "deps_broken_entries": deps_broken_entries,
    "deps_missing_lock": lambda spark, sf: M.missing_lockfiles(files(spark, sf)),
    "deps_vulns": lambda spark, sf: found(spark, sf).select(*COLUMNS),
    "deps_first_fix": deps_first_fix,
    "deps_read_advisories": deps_read_advisories,
    "deps_no_details": deps_no_details,
    "fix_pin": fix_pin,
    "fix_pin_verify": fix_pin_verify,
    "fix_pin_composed": fix_pin_composed,
}

# --- DuckDB side ----------------------------------------------------------------------------------

_P = f"WITH p AS (SELECT 'p' || CAST(p_partkey AS VARCHAR) AS repo, p_partkey, p_name, p_size, {', '.join(f'{sql.format(text=chr(86) + chr(65) + chr(82) + chr(67) + chr(72) + chr(65) + chr(82))} AS {name}' for name, sql in PARTS.items())} FROM part)"
_REQ, _FLAT, _NEST, _PKG = (cond for _, cond, _ in MANIFESTS)
_PINS = f"""SELECT repo, dir || 'requirements.txt' AS path, line, name, version, raw, p_size, p_name, dir, p_partkey, 'PyPI' AS eco FROM (
  SELECT *, 3 AS line, under AS name, '1.' || size || '.' || patch AS version, under || '==1.' || size || '.' || patch AS raw FROM p
  UNION ALL SELECT *, 4, 'Flask', '0.' || size, 'Flask[async] == 0.' || size || '; python_version > ''3''' FROM p
  UNION ALL SELECT *, 5, 'My_Pkg.Name', '1.' || patch || '.0rc1', 'My_Pkg.Name==1.' || patch || '.0rc1' FROM p
  UNION ALL SELECT *, 7, under, '9.0.0', under || '[x]==9.0.0 # twice' FROM p) WHERE {_REQ}"""
_V3 = f"""SELECT repo, dir || 'package-lock.json' AS path, line, name, version, raw, p_size, p_name, dir, p_partkey, 'npm' AS eco FROM (
  SELECT *, 6 AS line, dash AS name, '1.' || size || '.0' AS version, '"node_modules/' || dash || '": {{' AS raw FROM p
  UNION ALL SELECT *, 12, '@s/lib', '2.0.' || patch, '"node_modules/@s/lib": {{ "version": "2.0.' || patch || '" }},' FROM p) WHERE {_FLAT}"""
_V1 = f"""SELECT repo, dir || 'npm-shrinkwrap.json' AS path, line, name, version, raw, p_size, p_name, dir, p_partkey, 'npm' AS eco FROM (
  SELECT *, 3 AS line, dash AS name, '1.' || size || '.0' AS version, '"' || dash || '": {{' AS raw FROM p
  UNION ALL SELECT *, 7, 'deep', '0.1.' || size, '"deep": {{' FROM p) WHERE {_NEST}"""
# A root holds requirements.txt or package.json in an ancestor of src/app/main.py.
_ROOTED = f"p_partkey % 4 <> 3 AND ({_REQ} OR {_PKG})"
_DEPS = f"""{_P}, dep AS (SELECT * FROM ({_PINS}) UNION ALL SELECT * FROM ({_V3}) UNION ALL SELECT * FROM ({_V1}) WHERE NOT ({_FLAT})),
rooted AS (SELECT dep.* FROM dep WHERE {_ROOTED}),
hit AS (SELECT *, length(p_name) AS n, 'GHSA-' || replace(p_name, ' ', '-') AS id FROM rooted
  WHERE (eco = 'PyPI' AND line = 3 AND p_size >= 10 AND p_size < 25) OR (eco = 'npm' AND name = replace(p_name, ' ', '-')
    AND (p_size = 30 OR p_size < 5 OR (p_size >= 40 AND p_size <= 45))))"""
_TITLE = "'Vulnerable package: ' || name || CASE eco WHEN 'npm' THEN '@' ELSE '==' END || version || ' (' || id || ')'"
_SEVERITY = "CASE n % 5 WHEN 0 THEN 'MEDIUM' WHEN 1 THEN 'LOW' WHEN 2 THEN 'HIGH' WHEN 3 THEN 'CRITICAL' ELSE 'HIGH' END"
_SUMMARY = "CASE WHEN n % 3 = 1 THEN 'Bad thing' WHEN n % 2 = 0 THEN 'Details first' ELSE 'Known vulnerability.' END"
_FIXED = "CASE eco WHEN 'PyPI' THEN '1.25.0' ELSE '1.5.0-rc.1' END"
_ENTRY = "repo, path, CAST(line AS INTEGER) AS line, name, version, raw"

ORACLES = {
    "deps_root": f"{_P} SELECT repo, regexp_replace(dir, '/$', '') AS root FROM p WHERE {_ROOTED}",
    "deps_pins": f"{_P} SELECT {_ENTRY} FROM ({_PINS})",
    "deps_lock_v3": f"{_P} SELECT {_ENTRY} FROM ({_V3})",
    "deps_lock_v1": f"{_P} SELECT {_ENTRY} FROM ({_V1})",
    "deps_rejects": f"""{_P} SELECT repo, dir || file AS path, CASE p_partkey % 7 WHEN 1 THEN 'invalid JSON' WHEN 2 THEN 'empty file' ELSE 'not an object' END AS reason
FROM (SELECT *, 'package-lock.json' AS file FROM p WHERE {_FLAT} UNION ALL SELECT *, 'npm-shrinkwrap.json' FROM p WHERE {_NEST}) WHERE p_partkey % 7 IN (1, 2, 3)""",
    "deps_broken_entries": f"{_P} SELECT {_ENTRY} FROM (SELECT * FROM ({_V3}) UNION ALL SELECT * FROM ({_V1})) WHERE p_partkey % 7 NOT IN (1, 2, 3)",
    "deps_missing_lock": f"{_P} SELECT repo, regexp_replace(dir, '/$', '') AS root, 'package.json without a lockfile; npm dependencies not scanned (generate one with `npm install --package-lock-only`)' AS warning FROM p WHERE {_PKG} AND NOT ({_FLAT}) AND NOT ({_NEST})",
    "deps_vulns": f"{_DEPS} SELECT repo, path AS file, CAST(line AS INTEGER) AS line, {_SEVERITY} AS severity, {_TITLE} AS title, {_SUMMARY} || ' (source: OSV.dev)' AS description, raw AS snippet, 'Upgrade ' || name || ' to >=' || {_FIXED} AS fix_summary FROM hit",
    "deps_read_advisories": "SELECT DISTINCT 'GHSA-' || replace(p_name, ' ', '-') AS vuln_id, 2 AS packages, 4 AS ranges, 1 AS versions FROM part",
    "deps_first_fix": "SELECT 'GHSA-' || replace(p_name, ' ', '-') AS id, eco AS ecosystem, CASE eco WHEN 'PyPI' THEN '1.25.0' ELSE '1.5.0-rc.1' END AS fixed FROM (SELECT DISTINCT p_name FROM part), (VALUES ('PyPI'), ('npm')) AS e(eco)",
    "deps_no_details": f"{_DEPS} SELECT repo, path AS file, CAST(line AS INTEGER) AS line, CASE WHEN length(id) % 2 = 0 THEN {_SEVERITY} ELSE 'HIGH' END AS severity, {_TITLE} AS title, CASE WHEN length(id) % 2 = 0 THEN {_SUMMARY} ELSE 'Known vulnerability (details unavailable).' END || ' (source: OSV.dev)' AS description, raw AS snippet, 'Upgrade ' || name || CASE WHEN length(id) % 2 = 0 THEN ' to >=' || {_FIXED} ELSE ' to a patched release' END AS fix_summary FROM hit",
    "fix_pin_verify": f"{_DEPS} SELECT repo, path AS file, CAST(line AS INTEGER) AS line, {_TITLE} AS title, length(repo) % 2 <> 0 AS fixed FROM hit WHERE eco = 'PyPI'",
    "fix_pin_composed": f"""{_DEPS} SELECT repo, path, replace({_fill_sql(REQUIREMENTS)}, raw || chr(10), name || '==1.25.0' || chr(10)) AS new_content
  FROM (SELECT h.*, p.under, p.dash, p.size, p.patch FROM hit h JOIN p ON p.repo = h.repo) WHERE eco = 'PyPI'""",
    "fix_pin": f"""{_DEPS} SELECT repo, path AS file, CAST(line AS INTEGER) AS line, {_TITLE} AS title, raw AS old_line, name || '==1.25.0' AS new_line,
  replace({_fill_sql(REQUIREMENTS)}, raw || chr(10), name || '==1.25.0' || chr(10)) AS new_content, {_TITLE} || ': pin ' || name || '==1.25.0 (first fixed release)' AS summary
  FROM (SELECT h.*, p.under, p.dash, p.size, p.patch FROM hit h JOIN p ON p.repo = h.repo) WHERE eco = 'PyPI'""",
}
