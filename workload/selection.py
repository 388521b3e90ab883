"""Queries of file selection, over the tree of paths derived from line items."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from codewarden.functions import text as X
from codewarden.functions.ordering import range_rank
from codewarden.operators import post, select
from codewarden.rules import taint as T
from codewarden.session import cut_lineage, shared_dir
from codewarden.sources.files import file_seq, read_tree
from workload import corpus
from workload.corpus import quoted as q

EXCLUDE = ["*.min.JS", "a\\b/", "env/app.d.ts", "tests/[ef]*/READ?E.py", ""]
COLUMNS = ["repo", "path", "file_seq"]


def paths(spark, sf):
    return corpus.tree(spark, sf).where(F.col("path") != ".gitignore")


def where(condition):
    return lambda spark, sf: paths(spark, sf).where(condition()).select(*COLUMNS)


def collected(spark, sf):
    return select.collect(corpus.tree(spark, sf), EXCLUDE)


def src_path_order(spark, sf):
    """The collected files of each repository in the order that readers of file trees give them."""
    numbered = collected(spark, sf).withColumn("seq", file_seq(F.col("path"))).select("repo", "path", "seq").distinct()
    return range_rank(numbered, ["repo"], [F.col("seq"), F.col("path")], "nth").select("repo", "path", "nth")


def src_read_tree(spark, sf):
    """A note per supplier as a file of a tree, read back: their repositories, order and texts.

    File names are the writer's, so texts tell the files apart.
    """
    path = f"{shared_dir(spark)}/tree-{uuid.uuid4().hex}"
    s = corpus.table(spark, sf, "supplier", "s_suppkey").select(F.concat(F.lit("s"), F.col("s_nationkey").cast("string")).alias("repo"), "s_suppkey", "s_name")
    text = F.concat("s_name", F.lit("\n"), F.expr("cast(unhex('c3a9') AS string)"), F.lit(" "), F.col("s_suppkey").cast("string"))
    s.select("repo", text.alias("value")).write.partitionBy("repo").option("maxRecordsPerFile", 1).option("lineSep", "\n").text(path)
    read = read_tree(spark, path).where(F.col("path").endswith(".txt")).select(F.regexp_replace("repo", "^repo=", "").alias("repo"), "path", "content", "file_seq")
    rows = cut_lineage(read)  # every file is opened once: both orders, and the samples that their ranges are cut by, read this
    ordered = range_rank(rows, ["repo"], [F.col("file_seq"), F.col("path")], "nth")
    by_path = range_rank(rows, ["repo"], [F.col("path")], "by_path").select(F.col("repo").alias("_r"), F.col("path").alias("_p"), "by_path")
    both = ordered.join(by_path, (F.col("repo") == F.col("_r")) & (F.col("path") == F.col("_p")))
    return both.select("repo", "content", (F.col("nth") == F.col("by_path")).alias("in_path_order"))


QUERIES = {
    "src_read_tree": src_read_tree,
    "src_path_order": src_path_order,
    "src_collect": lambda spark, sf: collected(spark, sf).select(*COLUMNS),
    "src_named": where(lambda: select.is_named(F.col("path"))),
    "src_skipdirs": where(lambda: ~select.in_skipped_dir(F.col("path"))),
    "src_exclude": where(lambda: ~select.is_excluded(F.col("path"), EXCLUDE)),
    "src_gitignore": lambda spark, sf: select.collect(corpus.tree(spark, sf)).select(*COLUMNS),
    "src_single": lambda spark, sf: select.single(paths(spark, sf), "node_modules/lib/app.py").select(*COLUMNS),
    "scan_scope": lambda spark, sf: collected(spark, sf).select(
        *COLUMNS, X.suffix_of(F.col("path")).isin(*T.CODE_SUFFIXES).alias("code"), X.suffix_of(F.col("path")).alias("suffix")
    ),
    "agg_files": lambda spark, sf: post.files_scanned(collected(spark, sf)),
    "agg_languages": lambda spark, sf: post.languages(collected(spark, sf)).select("repo", F.array_join("languages", ",").alias("languages")),
    "fn_language": lambda spark, sf: paths(spark, sf).select(*COLUMNS, X.language_of(F.col("path")).alias("language")),
}

_SUFFIX = "lower(regexp_extract(name, '^.+(\\.[^.]+)$', 1))"
_NAMED = "(lower(name) IN ('.env', 'dockerfile') OR lower(name) LIKE '.env.%' OR lower(name) LIKE 'dockerfile.%' OR lower(name) LIKE 'docker-compose%')"
_SKIP = "(" + " OR ".join(f"('/' || path) LIKE '%/{d}/%' OR name = '{d}'" for d in ("node_modules", "dist", "venv")) + ")"
_EXCLUDED = "(path LIKE '%.min.JS' OR path = 'a/b' OR path LIKE 'a/b/%' OR path = 'env/app.d.ts' OR regexp_matches(path, '^tests/[ef].*/READ.E\\.py$'))"
_IGNORED = """CASE g WHEN 0 THEN path LIKE 'env/%' OR (name LIKE '%.py' AND name <> 'keep.py')
  WHEN 1 THEN path LIKE 'a/b/%' OR regexp_matches(path, '(^|/)fixtures/[^/]*\\.toml$')
  ELSE path NOT LIKE 'src/%' AND (name LIKE 'docker%' OR regexp_matches(name, '^[kl].*\\.tsx$')) END"""
_SCANNABLE = f"(suffix IN ({', '.join(q(s) for s in select.SUFFIXES)}) OR {_NAMED})"
_TREE = f"WITH named AS (SELECT *, string_split(path, '/')[-1] AS name FROM ({corpus.tree_sql('repo, path, file_seq, g')})), tree AS (SELECT *, {_SUFFIX} AS suffix FROM named)"
_COLLECTED = f"{_TREE}, collected AS (SELECT * FROM tree WHERE {_SCANNABLE} AND NOT {_SKIP} AND NOT {_EXCLUDED} AND NOT ({_IGNORED}))"
_OUT = "repo, path, file_seq"
_LANGUAGE = "CASE suffix " + " ".join(f"WHEN {q(s)} THEN {q(v)}" for s, v in X.LANGUAGE_BY_SUFFIX.items()) + " ELSE '' END"

ORACLES = {
    "src_read_tree": """SELECT 's' || CAST(s_nationkey AS VARCHAR) AS repo, s_name || chr(10) || 'é ' || CAST(s_suppkey AS VARCHAR) || chr(10) AS content, true AS in_path_order FROM supplier""",
    "src_path_order": f"{_COLLECTED}, paths AS (SELECT DISTINCT repo, path FROM collected) SELECT repo, path, row_number() OVER (PARTITION BY repo ORDER BY path) AS nth FROM paths",
    "src_collect": f"{_COLLECTED} SELECT {_OUT} FROM collected",
    "src_named": f"{_TREE} SELECT {_OUT} FROM tree WHERE {_NAMED}",
    "src_skipdirs": f"{_TREE} SELECT {_OUT} FROM tree WHERE NOT {_SKIP}",
    "src_exclude": f"{_TREE} SELECT {_OUT} FROM tree WHERE NOT {_EXCLUDED}",
    "src_gitignore": f"{_TREE} SELECT {_OUT} FROM tree WHERE {_SCANNABLE} AND NOT {_SKIP} AND NOT ({_IGNORED})",
    "src_single": f"{_TREE} SELECT {_OUT} FROM tree WHERE path = 'node_modules/lib/app.py'",
    "scan_scope": f"{_COLLECTED} SELECT {_OUT}, suffix IN ('.py', '.js', '.ts', '.jsx', '.tsx', '.mjs', '.cjs') AS code, suffix FROM collected",
    "agg_files": f"{_COLLECTED} SELECT repo, count(*) AS files_scanned FROM collected GROUP BY repo",
    "agg_languages": f"""{_COLLECTED} SELECT repo, concat_ws(',', CASE WHEN bool_or(suffix IN ('.js', '.jsx', '.ts', '.tsx', '.mjs', '.cjs')) THEN 'javascript' END,
  CASE WHEN bool_or(suffix = '.py') THEN 'python' END) AS languages FROM collected GROUP BY repo""",
    "fn_language": f"{_TREE} SELECT {_OUT}, {_LANGUAGE} AS language FROM tree",
}
