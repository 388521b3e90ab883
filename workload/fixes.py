"""Queries of fix proposals for hard-coded secrets, over the derived files."""

from __future__ import annotations

from pyspark.sql import functions as F

from codewarden.operators import fix
from codewarden.plans import file_pass
from workload import corpus


def secret_findings(spark, sf):
    return file_pass.findings(corpus.files(spark, sf), ("secrets",))


def proposals(spark, sf):
    return fix.secret_fixes(secret_findings(spark, sf), corpus.files(spark, sf))


def ignore_files(spark, sf):
    sources = spark.read.parquet(f"{sf}/documents.parquet").select("source").distinct()
    return sources.select(
        F.col("source").alias("repo"),
        F.lit(".gitignore").alias("path"),
        F.lit(0).cast("bigint").alias("file_seq"),
        F.when(F.length("source") == 4, F.lit("*.log\n .env \n")).otherwise(F.lit("*.env\n")).alias("content"),
    )


def fix_secret_env(spark, sf):
    fixes = proposals(spark, sf)
    env = fix.env_entries(fixes).select("repo", "path", "entry")
    return env.unionByName(fix.gitignore_entries(fixes, ignore_files(spark, sf)).select("repo", "path", "entry"))


def two_secrets(spark, sf):
    """The Python files with a secret, with a second one at their end; in those of template 9 the two are neighbours."""
    documents = corpus.table(spark, sf, "documents", "doc_id").where(F.expr(f"{corpus.template_no()} IN (8, 9)"))
    second = F.when(
        F.col("path").isNotNull() & (F.col("file_seq") % corpus.N == 8), F.concat(F.lit('\ndb_password = "pw'), "file_seq", F.lit('second"\n'))
    ).otherwise(F.concat(F.lit('\naccess_token = "'), F.md5(F.concat(F.lit("x"), "file_seq")), F.lit('"')))
    return corpus.files_of(documents.select("doc_id", "source", "text")).withColumn("content", F.concat("content", second))


def side_files(spark, sf):
    """.gitignore files, and a .env without a line end in some repositories."""
    env = ignore_files(spark, sf).where(F.length("repo") == 5)
    return ignore_files(spark, sf).unionByName(env.withColumns({"path": F.lit(".env"), "content": F.lit("A=1\r\nB=2")}))


def all_edits(spark, sf):
    files = two_secrets(spark, sf).unionByName(side_files(spark, sf))
    return fix.line_edits(file_pass.findings(two_secrets(spark, sf), ("secrets",)), files), files


def fix_edits(spark, sf):
    edits, _ = all_edits(spark, sf)
    return edits.select("repo", "path", "line", "action", "old_text", "new_text")


def fix_composed(spark, sf):
    return fix.compose(*all_edits(spark, sf))


def fix_composed_verify(spark, sf):
    edits, files = all_edits(spark, sf)
    return fix.verify_composed(edits, fix.compose(edits, files), lambda f: file_pass.findings(f, ("secrets",)))


def fix_verify(spark, sf):
    """One proposal per finding: the fix of the second neighbour leaves the first one on its line."""
    files = two_secrets(spark, sf)
    fixes = fix.secret_fixes(file_pass.findings(files, ("secrets",)), files)
    checked = fix.verify_secret_fixes(fixes, lambda f: file_pass.findings(f, ("secrets",)))
    return checked.select("repo", "file", "line", "title", "fixed")


QUERIES = {
    "fix_secret": lambda spark, sf: proposals(spark, sf).select("repo", "file", "line", "title", "old_line", "new_line", "import_at", "env_name", "env_value", "new_content", "summary"),
    "fix_secret_env": fix_secret_env,
    "fix_verify": fix_verify,
    "fix_edits": fix_edits,
    "fix_composed": fix_composed,
    "fix_composed_verify": fix_composed_verify,
    "fix_diff": lambda spark, sf: fix.diff_lines(proposals(spark, sf)),
}

# The Python files with a plain assignment of a secret are those of templates 8 and 9.
_HEX = "md5(CAST(doc_id AS VARCHAR))"
_FIX = f"""WITH files AS (SELECT *, file_seq AS doc_id FROM ({corpus.files_sql()})),
fix AS (SELECT repo, path AS file, k, content, t, CAST(k + CASE t WHEN 8 THEN 5 ELSE 8 END AS INTEGER) AS line,
  CASE t WHEN 8 THEN 'Hardcoded Password Detected' ELSE 'Generic API Key Detected' END AS title,
  CASE t WHEN 8 THEN 'password' ELSE 'token' END AS name,
  CASE t WHEN 8 THEN 'hunter' || CAST(doc_id AS VARCHAR) || 'secret' ELSE {_HEX} END AS env_value,
  CAST(CASE t WHEN 8 THEN k + 1 ELSE 1 END AS INTEGER) AS import_at FROM files WHERE t IN (8, 9)),
full_fix AS (SELECT *, name || ' = "' || env_value || '"' AS old_line, name || ' = os.environ["' || upper(name) || '"]' AS new_line FROM fix)"""
_NEW = """CASE t WHEN 8 THEN replace(replace(content, old_line, new_line), 'from flask import', 'import os' || chr(10) || 'from flask import')
  ELSE 'import os' || chr(10) || replace(content, chr(10) || old_line, chr(10) || new_line) END"""

# Files with two secrets: (line, title, name, value) of each; the import goes before the first import.
_TWO = f"""{_FIX}, second AS (SELECT repo, file, k, t, doc_id, import_at, CAST(k + CASE t WHEN 8 THEN 7 ELSE 9 END AS INTEGER) AS line, title,
  CASE t WHEN 8 THEN 'db_password' ELSE 'access_token' END AS name, CASE t WHEN 8 THEN 'pw' || doc_id || 'second' ELSE md5('x' || doc_id) END AS env_value,
  content || chr(10) || CASE t WHEN 8 THEN 'db_password = "pw' || doc_id || 'second"' || chr(10) ELSE 'access_token = "' || md5('x' || doc_id) || '"' END AS content
  FROM (SELECT *, CAST(regexp_extract(file, 'f(\\d+)\\.', 1) AS BIGINT) AS doc_id FROM fix)),
both_ AS (SELECT repo, file, t, doc_id, line, title, name, env_value FROM second UNION ALL
  SELECT f.repo, f.file, f.t, s.doc_id, f.line, f.title, f.name, f.env_value FROM fix f JOIN second s USING (repo, file)),
two AS (SELECT *, name || ' = "' || env_value || '"' AS old_line, name || ' = os.environ["' || upper(name) || '"]' AS new_line FROM both_),
entries AS (SELECT repo, string_agg(upper(name) || '=' || env_value, chr(10) ORDER BY doc_id, line) AS text, count(*) AS n FROM two GROUP BY repo),
fixed AS (SELECT s.repo, s.file, s.t, replace(replace(s.content, chr(10) || a.old_line, chr(10) || a.new_line), chr(10) || b.old_line, chr(10) || b.new_line) AS text
  FROM second s JOIN two a ON a.repo = s.repo AND a.file = s.file AND a.line = s.line JOIN two b ON b.repo = s.repo AND b.file = s.file AND b.line < s.line)"""

ORACLES = {
    "fix_secret": f"""{_FIX} SELECT repo, file, line, title, old_line, new_line, import_at, upper(name) AS env_name, env_value, {_NEW} AS new_content,
  title || ': move `' || name || '` to the environment (.env entry `' || upper(name) || '`, gitignored)' AS summary FROM full_fix""",
    "fix_secret_env": f"""{_FIX} SELECT repo, '.env' AS path, upper(name) || '=' || env_value AS entry FROM full_fix
UNION ALL SELECT DISTINCT repo, '.gitignore', '.env' FROM fix WHERE length(repo) <> 4""",
    "fix_verify": f"{_TWO} SELECT repo, file, line, title, NOT (t = 9 AND name = 'access_token') AS fixed FROM two",
    "fix_edits": f"""{_TWO} SELECT repo, file AS path, line, 'replace' AS action, old_line AS old_text, new_line AS new_text FROM two
UNION ALL SELECT repo, file, import_at, 'insert', NULL, 'import os' FROM second UNION ALL SELECT repo, '.env', line, 'append', NULL, upper(name) || '=' || env_value FROM two
UNION ALL SELECT DISTINCT repo, '.gitignore', 1, 'append', NULL, '.env' FROM second WHERE length(repo) <> 4""",
    "fix_composed": f"""{_TWO} SELECT repo, file AS path, CASE t WHEN 8 THEN replace(text, 'from flask import', 'import os' || chr(10) || 'from flask import') ELSE 'import os' || chr(10) || text END AS new_content, 3 AS edits FROM fixed
UNION ALL SELECT repo, '.env', CASE WHEN length(repo) = 5 THEN 'A=1' || chr(13) || chr(10) || 'B=2' || chr(13) || chr(10) || replace(text, chr(10), chr(13) || chr(10)) || chr(13) || chr(10) ELSE text || chr(10) END, CAST(n AS INTEGER) FROM entries
UNION ALL SELECT DISTINCT repo, '.gitignore', '*.env' || chr(10) || '.env' || chr(10), 1 FROM second WHERE length(repo) <> 4""",
    "fix_composed_verify": f"SELECT repo, file AS path, line, CAST(line + 1 AS INTEGER) AS new_line, title, true AS fixed FROM ({_TWO} SELECT * FROM two)",
    "fix_diff": f"""{_FIX} SELECT repo, file, line, title, '-' AS sign, line AS line_no, old_line AS text FROM full_fix
UNION ALL SELECT repo, file, line, title, '+', line + 1, new_line FROM full_fix UNION ALL SELECT repo, file, line, title, '+', import_at, 'import os' FROM full_fix""",
}
