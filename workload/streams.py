"""Streaming queries: file versions arrive as a stream of the given tables' rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from codewarden.operators import baseline
from codewarden.plans.scan import Options, scan
from codewarden.session import cut_lineage, shared_dir
from codewarden.streaming import watch
from workload import checks, corpus, dependencies


def event_versions(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.select(
        F.concat(F.lit("r"), F.expr("cast(user_id % 10 as string)")).alias("repo"),
        F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("path"),
        F.col("props").alias("content"),
        F.col("ts").alias("mtime"),
        (F.col("event_type") == "error").alias("deleted"),
    )


def _versions(documents, wave):
    """A wave of saves: all files, then a second version, then the last one again.

    In the second wave even documents become empty and some files go; the third delivers the first
    versions once more (they are old by then) and takes every fifth file to a text and back.
    """
    files = corpus.files_of(documents)
    second = wave == 1
    text = F.when(F.col("file_seq") % 2 == 0, F.lit("")).otherwise(F.col("content")) if second else F.col("content")
    gone = (F.col("file_seq") % 17 == 0) if second else F.lit(False)
    rows = files.select(
        "repo", "path", "file_seq", text.alias("content"), F.timestamp_seconds(F.col("file_seq") * 10 + int(second)).alias("mtime"), gone.alias("deleted")
    )
    if wave < 2:
        return rows
    some = rows.where("file_seq % 5 = 0 AND file_seq % 2 = 1 AND file_seq % 17 <> 0")
    there = some.withColumns({"content": F.lit("eval(x)"), "mtime": F.timestamp_seconds(F.col("file_seq") * 10 + 2)})
    back = some.withColumn("mtime", F.timestamp_seconds(F.col("file_seq") * 10 + 3))
    return rows.unionByName(there).unionByName(back)


def _run(spark, sf, known=None, **settings):
    """Three waves, each a micro-batch or more, with the whole scan of the repositories they touch."""
    out = f"{shared_dir(spark)}/watch-{uuid.uuid4().hex}"
    documents = corpus.table(spark, sf, "documents", "doc_id").select("doc_id", "source", "text")
    for wave in range(3):
        _versions(documents, wave).write.mode("append").options(**watch.STORED).parquet(f"{out}/in")
        stream = spark.readStream.schema(watch.VERSIONS_DDL).parquet(f"{out}/in")
        watch.watch(stream, f"{out}/state", f"{out}/checkpoint", known, availableNow=True, **settings).awaitTermination()
    return watch.current_findings(spark, f"{out}/state")


def stream_scan(spark, sf):
    return _run(spark, sf).select("repo", "file", "line", "scanner", "title", "severity")


def stream_new(spark, sf):
    before = scan(corpus.files(spark, sf), Options(scanners=("injection",)))
    known = cut_lineage(baseline.entries(before.where(F.col("title").isin("eval() usage", "Path traversal"))))  # one for all waves
    return _run(spark, sf, known).select("repo", "file", "line", "scanner", "title", "severity")


def stream_options(spark, sf):
    """With excluded paths, files that are not watched, chosen scanners, rules, and advisories for the manifests."""
    options = Options(exclude=("*.min.js", "src/f*1.py"), scanners=("custom", "injection", "headers", "deps"), rules=tuple(checks.RULES))
    found = _run(spark, sf, options=options, skip_paths=("src/f3.js",), advisories=dependencies.advisories(spark, sf))
    return found.select("repo", "file", "line", "scanner", "title", "severity")


def stream_latest(spark, sf):
    rows = watch.latest_versions(event_versions(spark, sf))
    return rows.select("repo", "path", "content", "deleted")


QUERIES = {"stream_scan": stream_scan, "stream_new": stream_new, "stream_options": stream_options, "stream_latest": stream_latest}

# The batch scan of what is left in the end: odd documents, without those that are gone.
_FILES = corpus.files_sql()
_LIVE_FILES = f"SELECT * FROM ({_FILES}) WHERE file_seq % 2 = 1 AND file_seq % 17 <> 0"
_LIVE = "SELECT repo, file, line, scanner, title, severity FROM " + checks._DISTINCT.replace(_FILES, _LIVE_FILES)
# What is left out is no file of its repository: the project check must not see it either.
_SOME = f"SELECT * FROM ({_LIVE_FILES}) WHERE path NOT LIKE '%.min.js' AND NOT regexp_matches(path, '^src/f.*1\\.py$') AND path <> 'src/f3.js'"
_OPTIONS = " UNION ALL ".join(f"SELECT repo, file, line, scanner, title, severity FROM ({sql.replace(_FILES, _SOME)})" for sql in checks._KINDS)

ORACLES = {
    "stream_scan": _LIVE,
    "stream_new": f"SELECT * FROM ({_LIVE}) WHERE title NOT IN ('eval() usage', 'Path traversal')",
    "stream_options": f"SELECT * FROM ({_OPTIONS}) WHERE scanner <> 'secrets' AND NOT (scanner = 'custom' AND {checks._SILENCED})",
    "stream_latest": """SELECT 'r' || CAST(user_id % 10 AS VARCHAR) AS repo, 'f' || CAST(user_id AS VARCHAR) AS path, props AS content, event_type = 'error' AS deleted
FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) = 1""",
}
