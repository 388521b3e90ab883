"""Queries of commit history and diffs, over patch text derived from orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from codewarden.operators import custom, history
from codewarden.sources import patches
from workload import corpus


BLOCK = 500

LOG = [
    "CASE WHEN o_orderkey % 3 <> 1 THEN concat('COMMIT ', md5(CAST(o_orderkey AS {text}))) ELSE 'diff --git a/x b/x' END",
    "CASE o_orderkey % 5 WHEN 0 THEN '+++ /dev/null' WHEN 1 THEN concat('+++ \"b/dir a/f', CAST(o_custkey % 7 AS {text}), '.py\"') ELSE concat('+++ b/src/f', CAST(o_custkey % 7 AS {text}), '.py') END",
    "CASE WHEN o_orderkey % 4 = 3 THEN '@@ odd @@' ELSE concat('@@ -1 +', CAST(o_custkey % 90 + 1 AS {text}), CASE WHEN o_orderkey % 2 = 0 THEN ',2' ELSE '' END, ' @@') END",
    "concat('+token = \"', md5(CAST(o_custkey AS {text})), '\"')",
    "CASE WHEN o_orderkey % 6 = 0 THEN concat('+# token = \"', md5(CAST(o_custkey AS {text})), '\"') ELSE concat('+password = \"pw-', CAST(o_orderkey AS {text}), '-x\"') END",
    "'-old'",
    "'+'",
]
DIFF = [
    "concat('+++ b/src/m', CAST(o_orderkey % 60 AS {text}), '.py')",
    "concat('@@ -1,2 +', CAST(o_custkey % 7 + 1 AS {text}), ',', CAST(o_orderkey % 3 AS {text}), ' @@')",
    "'+code'",
    "CASE WHEN o_orderkey % 4 = 0 THEN concat('@@ -9 +', CAST(o_custkey % 5 + 1 AS {text}), ' @@') ELSE '-code' END",
]


def _stream(spark, sf, lines, repos):
    orders = corpus.table(spark, sf, "orders", "o_orderkey").select("o_orderkey", "o_custkey")
    raw = F.array(*[F.expr(x.format(text="string")) for x in lines])
    rows = orders.select(
        F.concat(F.lit("r"), F.expr(f"cast(o_custkey % {repos} as string)")).alias("repo"), "o_orderkey", F.posexplode(raw).alias("i", "raw")
    )
    return rows.select("repo", F.expr("o_orderkey * 8 + i").alias("pos"), "raw")


def log(spark, sf):
    return _stream(spark, sf, LOG, 10)


def diff(spark, sf):
    return _stream(spark, sf, DIFF, 20)


def untracked(spark, sf):
    s = spark.read.parquet(f"{sf}/supplier.parquet")
    return s.selectExpr("concat('r', cast(s_suppkey % 20 as string)) AS repo", "concat(' src/m', cast(s_suppkey * 7 % 50 as string), '.py') AS path").distinct()


def changed(spark, sf):
    return patches.changed_lines(diff(spark, sf), untracked(spark, sf), BLOCK)


def hist_secrets(spark, sf):
    return history.secret_findings(log(spark, sf)).select("repo", "file", "line", "severity", "title", "snippet", "description")


RULES = [
    custom.CustomRule("token-then-password", r'token = "[0-9a-f]{32}"\npassword = ', "Two in a row.", "HIGH"),
    custom.CustomRule("empty-then-token", r"\n(?=token = )", "A line before a token.", "LOW", 2, (".py",), "Look."),
]


def hist_rules(spark, sf):
    """Rules over several added lines, with stretches so short that matches run over their ends."""
    found = history.secret_findings(log(spark, sf), RULES, lines=3, halo=2).where("scanner = 'custom'")
    return found.select("repo", "file", "line", "severity", "title", "snippet", "fix_phase", "fix_summary")


def ranges(spark, sf):
    return patches.changed_ranges(diff(spark, sf), untracked(spark, sf), BLOCK)


def diff_filter(spark, sf):
    rows = corpus.findings(spark, sf).withColumn("file", F.regexp_replace("file", "^/work/r/", ""))
    kept = history.on_changed_lines(rows, ranges(spark, sf))
    return kept.select("repo", "file", "line", "title", F.col("emit_seq.file_seq").alias("e2"))


QUERIES = {
    "hist_added_lines": lambda spark, sf: patches.added_lines(log(spark, sf), BLOCK),
    "hist_secrets": hist_secrets,
    "hist_rules": hist_rules,
    "hist_files": lambda spark, sf: history.diffs_scanned(log(spark, sf)),
    "diff_changed_lines": changed,
    "diff_changed_ranges": ranges,
    "diff_files": lambda spark, sf: history.files_in_diff(ranges(spark, sf)),
    "diff_filter": diff_filter,
}

# --- DuckDB side ----------------------------------------------------------------------------------


def _rows(lines, repos) -> str:
    return " UNION ALL ".join(
        f"SELECT 'r' || CAST(o_custkey % {repos} AS VARCHAR) AS repo, o_orderkey * 8 + {i} AS pos, {x.format(text='VARCHAR')} AS raw FROM orders"
        for i, x in enumerate(lines)
    )


_TARGET = "trim(substr(raw, 5), ' \"')"
_W = "OVER (PARTITION BY repo ORDER BY pos)"
_ADDED = f"""WITH log AS ({_rows(LOG, 10)}),
state AS (SELECT *, last_value(CASE WHEN raw LIKE 'COMMIT %' THEN substr(raw, 8) END IGNORE NULLS) {_W} AS sha,
  last_value(CASE WHEN raw LIKE 'COMMIT %' THEN '' WHEN raw LIKE '+++ %' THEN CASE WHEN {_TARGET} LIKE 'b/%' THEN substr({_TARGET}, 3) ELSE '' END END IGNORE NULLS) {_W} AS path FROM log),
flagged AS (SELECT *, CASE WHEN raw LIKE '+%' AND raw NOT LIKE '+++ %' AND path <> '' AND sha IS NOT NULL THEN 1 ELSE 0 END AS added FROM state),
hunked AS (SELECT *, sum(CASE WHEN raw LIKE '@@%' THEN 1 ELSE 0 END) {_W} AS hunk FROM flagged),
numbered AS (SELECT *, coalesce(TRY_CAST(first_value(CASE WHEN raw LIKE '@@%' THEN regexp_extract(raw, '^@@ -\\S+ \\+(\\d+)(?:,\\d+)? @@', 1) END) OVER (PARTITION BY repo, hunk ORDER BY pos) AS BIGINT), 0)
  + sum(added) OVER (PARTITION BY repo, hunk ORDER BY pos) - 1 AS new_line FROM hunked),
added AS (SELECT repo, sha, path, CAST(new_line AS INTEGER) AS new_line, substr(raw, 2) AS text, pos FROM numbered WHERE added = 1)"""
_CHANGED = f"""diff AS ({_rows(DIFF, 20)}),
state AS (SELECT *, last_value(CASE WHEN raw LIKE '+++ %' THEN substr(raw, 7) END IGNORE NULLS) {_W} AS path FROM diff),
hunks AS (SELECT repo, path, raw, TRY_CAST(regexp_extract(raw, '\\+(\\d+)', 1) AS INTEGER) AS start,
  CASE WHEN raw LIKE '@@%' THEN coalesce(TRY_CAST(nullif(regexp_extract(raw, '\\+\\d+,(\\d+)', 1), '') AS INTEGER), 1) ELSE 0 END AS n FROM state WHERE path IS NOT NULL),
lines AS (SELECT DISTINCT repo, path, unnest(range(start, start + n)) AS line FROM hunks WHERE raw LIKE '@@%'),
extra AS (SELECT DISTINCT 'r' || CAST(s_suppkey % 20 AS VARCHAR) AS repo, 'src/m' || CAST(s_suppkey * 7 % 50 AS VARCHAR) || '.py' AS path FROM supplier),
changed AS (SELECT repo, path, CAST(line AS INTEGER) AS line FROM lines l WHERE NOT EXISTS (SELECT 1 FROM extra e WHERE e.repo = l.repo AND e.path = l.path)
  UNION SELECT repo, path, CAST(NULL AS INTEGER) FROM extra
  UNION SELECT repo, path, CAST(NULL AS INTEGER) FROM hunks GROUP BY repo, path HAVING sum(n) = 0)"""
_PLACEHOLDER = "your|example|placeholder|changeme|change_me|change-me|dummy|sample|insert|replace|redacted|xxxx|todo"

ORACLES = {
    "hist_added_lines": f"{_ADDED} SELECT * FROM added",
    "hist_secrets": f"""{_ADDED}, hits AS (
  SELECT *, 'Generic API Key' AS kind, regexp_extract(text, '^token = "([0-9a-f]{{32}})"', 1) AS v FROM added
  UNION ALL SELECT *, 'Hardcoded Password', regexp_extract(text, '^password = "([^"]{{6,}})"', 1) FROM added)
SELECT DISTINCT repo, path || ' @ ' || substr(sha, 1, 12) AS file, new_line AS line, 'CRITICAL' AS severity, kind || ' Detected' AS title, text AS snippet,
  'Committed in ' || sha || '. ' || kind || ' found in the source. Anyone who can read this file can use the credential. Deleting it from the current code does not un-leak it — rotate the credential.' AS description
FROM hits WHERE v <> ''
QUALIFY row_number() OVER (PARTITION BY repo, sha, path, new_line, kind ORDER BY pos) = 1""",
    "hist_rules": f"""{_ADDED}, pairs AS (SELECT *, lead(text) OVER (PARTITION BY repo, sha, path ORDER BY pos) AS next FROM added), hits AS (
  SELECT *, 'token-then-password' AS title, 'HIGH' AS severity, 3 AS fix_phase, '' AS fix_summary FROM pairs WHERE regexp_matches(text, 'token = "[0-9a-f]{{32}}"$') AND starts_with(next, 'password = ')
  UNION ALL SELECT *, 'empty-then-token', 'LOW', 2, 'Look.' FROM pairs WHERE starts_with(next, 'token = '))
SELECT repo, path || ' @ ' || substr(sha, 1, 12) AS file, new_line AS line, severity, title, text AS snippet, CAST(fix_phase AS INTEGER) AS fix_phase, fix_summary FROM hits
QUALIFY row_number() OVER (PARTITION BY repo, sha, path, new_line, title ORDER BY pos) = 1""",
    "hist_files": f"{_ADDED} SELECT repo, count(DISTINCT sha || path) AS files_scanned FROM added GROUP BY repo",
    "diff_changed_ranges": f"""WITH {_CHANGED} SELECT DISTINCT repo, path, start AS first, CAST(start + n - 1 AS INTEGER) AS last FROM hunks h WHERE raw LIKE '@@%' AND n > 0
  AND NOT EXISTS (SELECT 1 FROM extra e WHERE e.repo = h.repo AND e.path = h.path) UNION ALL SELECT repo, path, NULL, NULL FROM changed WHERE line IS NULL""",
    "diff_changed_lines": f"WITH {_CHANGED} SELECT * FROM changed",
    "diff_files": f"WITH {_CHANGED} SELECT repo, count(DISTINCT path) AS files_scanned FROM changed GROUP BY repo",
    "diff_filter": f"""WITH {_CHANGED}, found AS (SELECT * REPLACE (replace(file, '/work/r/', '') AS file) FROM ({corpus.findings_sql()}))
SELECT repo, file, line, title, e2 FROM found f WHERE NOT project_level
  AND EXISTS (SELECT 1 FROM changed c WHERE c.repo = f.repo AND c.path = f.file AND (c.line IS NULL OR c.line = f.line))""",
}

