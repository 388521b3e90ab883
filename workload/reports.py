"""Queries of report ingestion, over JSON documents derived from orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from codewarden.sources import reports
from workload import corpus

# One document per order; some are broken or no object, and results hold malformed entries.
SEMGREP = (
    "CASE WHEN o_orderkey % 7 = 0 THEN '{{broken' WHEN o_orderkey % 11 = 0 THEN '[]' ELSE concat('{{\"results\": [{{\"check_id\": \"py.lang.rule-', o_orderstatus, "
    "'\", \"path\": \"./src//m', CAST(o_custkey % 9 AS {text}), '.py\", \"start\": {{\"line\": ', CASE WHEN o_orderkey % 5 = 0 THEN '\"x\"' ELSE CAST(o_custkey % 40 AS {text}) END, "
    "'}}, \"extra\": {{\"message\": \" m ', o_orderpriority, '\\\\n\", \"severity\": \"', CASE o_orderkey % 4 WHEN 0 THEN 'error' WHEN 1 THEN 'INFO' WHEN 2 THEN 'odd' ELSE 'WARNING' END, "
    "'\", \"fix\": ', CASE WHEN o_orderkey % 2 = 0 THEN '\"y\"' ELSE '\"\"' END, ', \"metadata\": {{\"references\": [\"a\", 3, \"b\", \"c\", \"d\"]}}}}}}, 5, {{\"check_id\": null, \"extra\": []}}]}}') END"
)
SARIF = (
    "CASE WHEN o_orderkey % 7 = 0 THEN '{{broken' ELSE concat('{{\"runs\": [{{\"tool\": {{\"driver\": {{\"rules\": [{{\"id\": \"js/a\", \"helpUri\": \"https://h\", \"properties\": {{\"security-severity\": \"', "
    "CASE o_orderkey % 6 WHEN 0 THEN '9.1' WHEN 1 THEN '7.0' WHEN 2 THEN '4.5' WHEN 3 THEN '0.1' WHEN 4 THEN 'n/a' ELSE '6.9' END, '\"}}}}, {{\"id\": \"js/b\"}}, 7]}}}}, \"results\": ["
    "{{\"ruleId\": \"js/a\", \"level\": \"error\", \"message\": {{\"text\": \"t ', o_orderstatus, '\"}}, \"locations\": [{{\"physicalLocation\": {{\"artifactLocation\": {{\"uri\": \"src/m', CAST(o_custkey % 9 AS {text}), "
    "'.js\"}}, \"region\": {{\"startLine\": ', CAST(o_custkey % 30 AS {text}), ', \"snippet\": {{\"text\": \" s \"}}}}}}}}, {{}}]}}, "
    "{{\"ruleId\": \"js/b\", \"level\": \"Note\"}}, null, {{\"ruleId\": \"js/c\", \"locations\": []}}]}}]}}') END"
)


def docs(template):
    def table(spark, sf):
        orders = corpus.table(spark, sf, "orders", "o_orderkey")
        return orders.select(
            F.concat(F.lit("r"), F.expr("cast(o_custkey % 10 as string)")).alias("repo"),
            F.col("o_orderkey").alias("doc"),
            F.expr(template.format(text="string")).alias("json"),
        )

    return table


COLUMNS = ["repo", "file", "line", "severity", "title", "description", "scanner", "snippet", "fix_phase", "fix_summary"]


def ingest(reader, template):
    return lambda spark, sf: reader(docs(template)(spark, sf)).select(
        *COLUMNS, F.array_join("references", ",").alias("refs"), F.col("emit_seq.file_seq").alias("doc")
    )


QUERIES = {
    "ingest_semgrep": ingest(reports.semgrep, SEMGREP),
    "ingest_sarif": ingest(reports.sarif, SARIF),
    "ingest_rejects": lambda spark, sf: reports.documents(docs(SEMGREP)(spark, sf))[1],
}

_BASE = "SELECT 'r' || CAST(o_custkey % 10 AS VARCHAR) AS repo, o_orderkey AS doc, * FROM orders"

ORACLES = {
    "ingest_semgrep": f"""WITH o AS ({_BASE} WHERE o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0)
SELECT repo, 'src/m' || CAST(o_custkey % 9 AS VARCHAR) || '.py' AS file, CAST(CASE WHEN o_orderkey % 5 = 0 OR o_custkey % 40 = 0 THEN 1 ELSE o_custkey % 40 END AS INTEGER) AS line,
  CASE o_orderkey % 4 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'LOW' ELSE 'MEDIUM' END AS severity, 'rule-' || o_orderstatus AS title, 'm ' || o_orderpriority AS description, 'semgrep' AS scanner,
  '' AS snippet, CAST(CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 3 END AS INTEGER) AS fix_phase, 'See semgrep rule py.lang.rule-' || o_orderstatus || '.' AS fix_summary, 'a,b,c,d' AS refs, doc FROM o
UNION ALL SELECT repo, '.', 1, 'MEDIUM', 'semgrep-rule', 'Semgrep rule semgrep-rule matched.', 'semgrep', '', 3, 'See semgrep rule semgrep-rule.', '', doc FROM o""",
    "ingest_sarif": f"""WITH o AS ({_BASE} WHERE o_orderkey % 7 <> 0)
SELECT repo, 'src/m' || CAST(o_custkey % 9 AS VARCHAR) || '.js' AS file, CAST(greatest(1, o_custkey % 30) AS INTEGER) AS line,
  CASE o_orderkey % 6 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'LOW' WHEN 4 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, 'js/a' AS title, 't ' || o_orderstatus AS description,
  'codeql' AS scanner, 's' AS snippet, CAST(3 AS INTEGER) AS fix_phase, 'See CodeQL rule js/a.' AS fix_summary, 'https://h' AS refs, doc FROM o
UNION ALL SELECT repo, '.', 1, 'LOW', 'js/b', 'CodeQL rule js/b matched.', 'codeql', '', 3, 'See CodeQL rule js/b.', '', doc FROM o
UNION ALL SELECT repo, '.', 1, 'MEDIUM', 'js/c', 'CodeQL rule js/c matched.', 'codeql', '', 3, 'See CodeQL rule js/c.', '', doc FROM o""",
    "ingest_rejects": f"SELECT repo, doc, CASE WHEN o_orderkey % 7 = 0 THEN 'invalid JSON' ELSE 'not an object' END AS reason FROM ({_BASE}) WHERE o_orderkey % 7 = 0 OR o_orderkey % 11 = 0",
}
