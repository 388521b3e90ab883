"""Queries on findings (synthetic, one per line item): order, copies, merge, review, baseline, reports, scores."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from codewarden.functions import text as X
from codewarden.operators import baseline, evaluate, fix, post, report
from codewarden.session import shared_dir
from workload import corpus
from workload.corpus import quoted as q

ROOT = "/work/r"
GATES = {"critical": 0, "HIGH": 1, "medium": 2, "low": 3, "never": -1}


def found(spark, sf):
    return corpus.findings(spark, sf)


def seq():
    return F.col("emit_seq.file_seq").alias("e2")


def post_sort(spark, sf):
    """The rank every finding has in its repository's sorted list."""
    return report.numbered(found(spark, sf)).select("repo", "file", "line", "title", "severity", "seq")


def post_dedupe(spark, sf):
    return post.dedupe(found(spark, sf)).select("repo", "file", "line", "scanner", "title", "severity", seq())


def merge_engines(spark, sf):
    all_of_them = found(spark, sf)
    merged = post.merge_engines(
        all_of_them.where("scanner <> 'semgrep'"), all_of_them.where(F.col("scanner") == "semgrep")
    )
    return merged.select("repo", "file", "line", "scanner", "title", seq())


def ai_requests(spark, sf):
    return post.review_requests(found(spark, sf))


def ai_parse(spark, sf):
    e = corpus.table(spark, sf, "events", "event_id")
    raw = F.expr(
        "CASE event_id % 7 WHEN 0 THEN concat('{\"confirmed\": false, \"k\": ', cast(user_id as string), '}') "
        "WHEN 1 THEN concat('```json\\n{\"confirmed\": true, \"severity\": \"', event_type, '\"}\\n```') "
        "WHEN 2 THEN 'not json' WHEN 3 THEN '[1, 2]' WHEN 4 THEN concat('so: ', props) WHEN 5 THEN '``` {broken} ```' ELSE props END"
    )
    parsed = post.parse_verdicts(e.select("event_id", raw.alias("raw")))
    return parsed.select("event_id", F.col("parsed").isNotNull().alias("parsed"), "dismissed", "verdict_severity")


_CASE = "(line + length(file) + length(title)) % 6"
_RAW = (
    f"CASE {_CASE} WHEN 0 THEN '{{\"confirmed\": false}}' WHEN 1 THEN '{{\"confirmed\": true, \"severity\": \"LOW\"}}' "
    f"WHEN 2 THEN '{{\"confirmed\": true, \"severity\": \"critical\"}}' WHEN 3 THEN 'nonsense' ELSE '{{\"confirmed\": true}}' END"
)


def ai_apply(spark, sf):
    rows = found(spark, sf)
    keys = rows.select("repo", "file", "line", "title", X.finding_id(F.col("scanner"), F.col("title")).alias("finding_id")).distinct()
    verdicts = keys.withColumn("raw", F.expr(_RAW)).withColumn("error", F.expr(f"CASE WHEN {_CASE} = 5 THEN 'timeout' END"))
    applied = post.apply_verdicts(rows, verdicts.drop("title"))
    return applied.select("repo", "file", "line", "title", "severity", "ai_confirmed", seq())


def gate_exit_code(spark, sf):
    """The gate of every repository at each level, those without findings included."""
    rows, everyone = found(spark, sf), repos(spark, sf)
    by_level = [post.exit_code(rows, level, everyone).select("repo", F.lit(level).alias("level"), "exit_code") for level in GATES]
    return reduce(lambda a, b: a.unionByName(b), by_level)


def baseline_keys(spark, sf):
    return baseline.with_keys(found(spark, sf), ROOT).select("repo", "id", "file", "line", "hash")


def knfound(spark, sf):
    return baseline.entries(found(spark, sf).where("severity IN ('LOW', 'HIGH')"), ROOT)


def baseline_write(spark, sf):
    path = f"{shared_dir(spark)}/baseline-{spark.sparkContext.applicationId}"
    baseline.write(found(spark, sf), path, ROOT)
    return baseline.read(spark, path)


def baseline_filter(spark, sf):
    kept = baseline.filter_known(found(spark, sf), knfound(spark, sf), ROOT)
    return kept.select("repo", "file", "line", "title", "severity", seq())


def documents_of(document):
    """Document rows of all findings, collapsed to one row per key so that their order is total."""

    def query(spark, sf):
        unique = post.dedupe(found(spark, sf))
        return document(unique)

    return query


def files_scanned(spark, sf):
    return found(spark, sf).groupBy("repo").agg(F.count_distinct("file").alias("files_scanned"))


def repos(spark, sf):
    """Every repository, and one per region that has no findings."""
    clean = spark.read.parquet(f"{sf}/region.parquet").select(F.concat(F.lit("clean-"), F.lower("r_name")).alias("repo"))
    return found(spark, sf).select("repo").distinct().unionByName(clean)


def report_json(spark, sf):
    return report.json_document(post.dedupe(found(spark, sf)), files_scanned(spark, sf), ROOT, repos(spark, sf))


def report_sarif(spark, sf):
    unique = post.dedupe(found(spark, sf))
    return report.sarif_results(unique).select("repo", "seq", "rule_id", "rule_index", "result")


def report_sarif_rules(spark, sf):
    rules = report.sarif_rules(post.dedupe(found(spark, sf)))
    return rules.select("repo", "rule_id", "rule_index", "title", "severity")


def report_sarif_document(spark, sf):
    return report.sarif_document(post.dedupe(found(spark, sf)), files_scanned(spark, sf), repos(spark, sf))


def report_written(spark, sf):
    """The SARIF documents as files: written by the sink, and their lines read back."""
    path = f"{shared_dir(spark)}/reports-{uuid.uuid4().hex}"
    report.write_documents(report_sarif_document(spark, sf), path)
    return spark.read.schema("value string, repo string").text(path).select("repo", F.col("value").alias("text"))


def report_markdown(spark, sf):
    return report.markdown_document(post.dedupe(found(spark, sf)), files_scanned(spark, sf), "2024-01-01 00:00 UTC", repos(spark, sf))


def report_prompts(spark, sf):
    return report.prompt_document(post.dedupe(found(spark, sf)), repos(spark, sf))


def case_findings(spark, sf):
    rows = found(spark, sf)
    return rows.select(
        F.col("repo").alias("cve"),
        "file",
        (F.col("line") * 3).alias("line"),
        F.concat_ws("-", F.col("emit_seq.file_seq").cast("string"), F.col("emit_seq.a").cast("string"), F.col("emit_seq.b").cast("string"), F.col("emit_seq.c").cast("string")).alias("finding_id"),
        evaluate.categories_of(F.col("scanner"), F.col("title")).alias("cats"),
        "title",
        "scanner",
    )


def case_labels(spark, sf):
    orders = corpus.table(spark, sf, "orders", "o_orderkey")
    rows = orders.selectExpr(
        "concat('r', cast(o_custkey % 25 as string)) AS cve",
        "concat('/work/r/src/m', cast(o_orderkey % 60 as string), '.py') AS file",
        "cast(o_orderkey % 25 as int) AS line",
        "o_orderkey AS weakness_id",
        "o_custkey % 25 AS c",
    )
    return rows.select("cve", "file", "line", "weakness_id", _case_categories().alias("categories"))


def _case_categories():
    return F.when(F.col("c") % 3 == 0, F.array(F.lit("codei"))).when(
        F.col("c") % 3 == 1, F.array(F.lit("pathtrav"), F.lit("xss"))
    ).otherwise(F.array(F.lit("cmdi"), F.lit("sqli")))


def eval_match(spark, sf):
    return evaluate.matches(case_findings(spark, sf), case_labels(spark, sf))


def eval_scores(spark, sf):
    labels = case_labels(spark, sf)
    return evaluate.scores(case_findings(spark, sf), labels, labels.select("cve", "categories").distinct())


def eval_categories(spark, sf):
    rows = case_findings(spark, sf)
    return rows.groupBy("scanner", "title", F.array_join("cats", ",").alias("categories")).agg(F.count(F.lit(1)).alias("n"))


def names(spark, sf):
    part = spark.read.parquet(f"{sf}/part.parquet")
    return part.select(
        "p_partkey",
        X.finding_id(F.lit("deps"), F.concat(F.lit("  "), "p_name", F.lit(": "), "p_brand", F.lit(" — é! "))).alias("finding_id"),
        X.finding_id(F.col("p_brand"), F.expr("CASE WHEN p_size % 2 = 0 THEN '--' ELSE p_type END")).alias("short_id"),
    )


QUERIES = {
    "post_sort": post_sort,
    "post_dedupe": post_dedupe,
    "gate_exit_code": gate_exit_code,
    "agg_phase": lambda spark, sf: post.phase_counts(found(spark, sf)),
    "agg_headline": lambda spark, sf: post.headline(post.severity_counts(found(spark, sf))).select("repo", "critical", "high", "medium", "low", "headline"),
    "merge_engines": merge_engines,
    "ai_reviewable": lambda spark, sf: found(spark, sf).where(post.reviewable()).select("repo", "file", "line", "title", seq()),
    "ai_requests": ai_requests,
    "ai_parse": ai_parse,
    "ai_apply": ai_apply,
    "baseline_keys": baseline_keys,
    "baseline_write": baseline_write,
    "baseline_filter": baseline_filter,
    "fix_candidates": lambda spark, sf: fix.candidates(found(spark, sf)).select("repo", "file", "line", "title", seq()),
    "report_json": report_json,
    "report_sarif": report_sarif,
    "report_sarif_document": report_sarif_document,
    "report_sarif_rules": report_sarif_rules,
    "report_written": report_written,
    "report_markdown": report_markdown,
    "report_prompts": report_prompts,
    "report_diagnostics": lambda spark, sf: report.diagnostics(found(spark, sf), "/ws"),
    "report_by_file": lambda spark, sf: report.by_file(report.diagnostics(found(spark, sf), "/ws").distinct()).select("repo", "path", "nth", "line", "severity", "message", "code"),
    "fn_finding_id": names,
    "eval_categories": eval_categories,
    "eval_match": eval_match,
    "eval_scores": eval_scores,
}

# --- DuckDB side ----------------------------------------------------------------------------------

_F = f"WITH found AS ({corpus.findings_sql()})"
_ORDER = "srank, e1, e2, file, e3, e4, e5"
_ID = corpus.finding_id_sql()
_UNIQUE = f"""{_F}, uniq AS (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY repo, file, line, scanner, title ORDER BY {_ORDER}) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY {_ORDER}, file, line, title) AS seq FROM uniq),
scanned AS (SELECT repo, count(DISTINCT file) AS files_scanned FROM found GROUP BY repo UNION ALL SELECT 'clean-' || lower(r_name), NULL FROM region),
counts AS (SELECT repo, count(title) AS total, count(*) FILTER (WHERE severity = 'CRITICAL') AS critical, count(*) FILTER (WHERE severity = 'HIGH') AS high,
  count(*) FILTER (WHERE severity = 'MEDIUM') AS medium, count(*) FILTER (WHERE severity = 'LOW') AS low,
  {', '.join(f'count(*) FILTER (WHERE fix_phase = {p}) AS phase{p}' for p, _, _ in report.PHASES)} FROM (SELECT * FROM uniq UNION ALL BY NAME SELECT 'clean-' || lower(r_name) AS repo FROM region) GROUP BY repo)"""
_REVIEWABLE = "snippet <> '' AND NOT project_level AND scanner <> 'deps'"
_HASH_TEXT = "CASE WHEN line >= 1 AND NOT project_level AND line_text IS NOT NULL THEN line_text ELSE snippet END"
_KEYED = f"""{_F}, keyed AS (SELECT *, {_ID} AS id, substr(sha256(regexp_replace({_HASH_TEXT}, '^\\s+|\\s+$', '', 'g')), 1, 16) AS hash,
  replace(file, '{ROOT}/', '') AS rel FROM found)"""
_KNOWN = "SELECT DISTINCT repo, id, rel AS file, hash FROM keyed WHERE severity IN ('LOW', 'HIGH')"


def _case(column, table, default):
    return f"CASE {column} " + " ".join(f"WHEN {q(str(k))} THEN {q(str(v))}" for k, v in table.items()) + f" ELSE {q(str(default))} END"


_REFS = f"""CASE WHEN has_ref THEN '"https://e.example/1"' ELSE coalesce('"' || nullif({_case('scanner', report.DEFAULT_REFERENCES, '')}, '') || '"', '') END"""
_JSON = f"""'{{"id":' || to_json({_ID}) || ',"scanner":' || to_json(scanner) || ',"file":' || to_json(replace(file, '{ROOT}/', '')) || ',"line":' || line
  || ',"severity":' || to_json(severity) || ',"fix_phase":' || fix_phase || ',"code_snippet":' || to_json(snippet) || ',"title":' || to_json(title)
  || ',"explanation":' || to_json(description) || ',"fix_guidance":' || to_json(fix_summary) || ',"references":[' || {_REFS}
  || '],"reachable":' || coalesce(CAST(reachable AS VARCHAR), 'null') || '}}'"""
_END = report._END
_HEADLINE = """CASE WHEN critical > 0 THEN '**Your app has ' || critical || ' critical vulnerabilit' || CASE WHEN critical = 1 THEN 'y' ELSE 'ies' END ||
  '.**' || chr(10) || 'These must be fixed before shipping — they allow attackers to steal data,' || chr(10) || 'impersonate users, or take over your server.'
 WHEN high > 0 THEN '**' || high || ' high-severity issue' || CASE WHEN high > 1 THEN 's' ELSE '' END || ' found.**' || chr(10) || 'Your app is at serious risk. Fix these in the next release.'
 WHEN medium > 0 THEN '**' || medium || ' medium-severity issue' || CASE WHEN medium > 1 THEN 's' ELSE '' END || ' found.**' || chr(10) || 'Not immediately exploitable, but these weaken your security posture.'
 ELSE '**' || low || ' low-severity issue' || CASE WHEN low > 1 THEN 's' ELSE '' END || ' found.**' || chr(10) || 'Minor improvements recommended but no urgent risk.' END"""
NL = "' || chr(10) || '"


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", NL) + "'"


_MD_HEAD = " || ".join(
    [
        _lit("# Security Report — "), "repo", _lit("\n\n**Scanned:** 2024-01-01 00:00 UTC\n**Files scanned:** "), "coalesce(CAST(files_scanned AS VARCHAR), '—')",
        _lit("\n**Total issues:** "), "total", _lit("\n\n---\n\n## Executive Summary\n\n"), f"({_HEADLINE})",
        _lit("\n\n| Severity | Count |\n|----------|-------|\n| 🔴 Critical | "), "critical", _lit(" |\n| 🟠 High | "), "high",
        _lit(" |\n| 🟡 Medium | "), "medium", _lit(" |\n| 🔵 Low | "), "low",
        _lit(" |\n\n---\n\n## Fix Plan (Phased)\n\n| Phase | What | Risk | Issues |\n|-------|------|------|--------|\n"),
        *[part for p, what, risk in report.PHASES for part in (_lit(f"| {p} | {what} | {risk} | "), f"phase{p}", _lit(" |\n"))],
        _lit(
            "\n**How to apply:** Turn the issues below into fix prompts with the prompt report. "
            "Start with Phase 1 — those fixes are zero-risk.\n\n---\n\n## Issues\n\n"
        ),
    ]
)
_BADGE = _case("severity", report.BADGES, "⚪")
_MD_BODY = " || ".join(
    [
        "'### '", "seq", "'. '", _BADGE, "' '", "title", _lit("\n\n**File:** `"), "file", "':'", "line", _lit("`\n**Phase:** "), "fix_phase",
        "' | **Scanner:** '", "scanner",
        "CASE WHEN reachable THEN ' | ⚡ **Reachable from untrusted input**' WHEN NOT reachable THEN ' | 🧊 Not fed by untrusted input (this file)' ELSE '' END",
        _lit("\n\n"), "description", _lit("\n\n"),
        f"CASE WHEN snippet <> '' THEN {_lit(chr(96) * 3 + chr(10))} || snippet || {_lit(chr(10) + chr(96) * 3 + chr(10) * 2)} ELSE '' END",
        "'**Fix:** '", "fix_summary", _lit("\n\n---\n\n"),
    ]
)
_MD_TAIL = _lit(
    "## Next Steps\n\n1. Review this report\n2. Write the prompt report for ready-to-paste fix prompts "
    "(start with Phase 1 — zero-risk)\n3. Apply the fixes\n4. Test your app\n5. Scan again to verify the issues are gone\n"
)
_PROMPT = " || ".join(
    [
        _lit("I have a security vulnerability in my code. Please fix it.\n\nFILE: "), "file", _lit("\nLINE: "), "line", _lit("\nISSUE: "), "title",
        _lit("\n\nTHE CODE:\n```python\n"), "CASE WHEN snippet = '' THEN '(snippet unavailable)' ELSE snippet END",
        _lit("\n```\n\nWHY IT'S DANGEROUS:\n"), "description", _lit("\n\nWHAT TO DO:\n"), "fix_summary", _lit(report._PROMPT_TAIL),
    ]
)
_SARIF_LEVEL = _case("severity", report.SARIF_LEVELS, "warning")
_SARIF = f"""{_UNIQUE}, seen AS (SELECT *, {_ID} AS rule_id FROM ranked),
firsts AS (SELECT repo, rule_id, min(seq) AS first FROM seen GROUP BY ALL),
rules AS (SELECT repo, rule_id, CAST(row_number() OVER (PARTITION BY repo ORDER BY first) - 1 AS INTEGER) AS rule_index, first FROM firsts)"""
_CASES = f"""{_F}, own_categories(scanner_kind, title, cat) AS (VALUES {', '.join(f"('injection', {q(t)}, '{c}')" for c, ts in evaluate.CATEGORY_TITLES.items() for t in ts)}),
words(word, cat) AS (VALUES {', '.join(f"({q(w)}, '{c}')" for c, ws in evaluate.ENGINE_WORDS.items() for w in ws)}),
kinds AS (SELECT DISTINCT scanner, title FROM found),
cats AS (SELECT k.scanner, k.title, list_sort(list(DISTINCT cat) FILTER (WHERE cat IS NOT NULL)) AS cats FROM (
  SELECT k.scanner, k.title, o.cat FROM kinds k LEFT JOIN own_categories o ON o.title = k.title WHERE k.scanner = 'injection'
  UNION ALL SELECT k.scanner, k.title, w.cat FROM kinds k LEFT JOIN words w ON contains(lower(k.title), w.word) WHERE k.scanner <> 'injection') k GROUP BY ALL),
cf AS (SELECT f.repo AS cve, f.file, f.line * 3 AS line, concat_ws('-', e2, e3, e4, e5) AS finding_id, coalesce(c.cats, []) AS cats, f.title, f.scanner
  FROM found f JOIN cats c ON c.scanner = f.scanner AND c.title = f.title),
labels_cve AS (SELECT 'r' || CAST(o_custkey % 25 AS VARCHAR) AS cve, '/work/r/src/m' || CAST(o_orderkey % 60 AS VARCHAR) || '.py' AS file,
  o_orderkey % 25 AS line, o_orderkey AS weakness_id,
  CASE WHEN o_custkey % 25 % 3 = 0 THEN ['codei'] WHEN o_custkey % 25 % 3 = 1 THEN ['pathtrav', 'xss'] ELSE ['cmdi', 'sqli'] END AS categories FROM orders),
pairs AS (SELECT l.cve, l.weakness_id, f.finding_id FROM labels_cve l JOIN cf f ON f.cve = l.cve AND f.file = l.file AND abs(f.line - l.line) <= 2 AND list_has_any(f.cats, l.categories))"""

_SARIF_RESULT = f"""'{{"ruleId":' || to_json(rule_id) || ',"ruleIndex":' || rule_index || ',"level":"' || {_SARIF_LEVEL}
  || '","message":{{"text":' || to_json(title || ': ' || description) || '}},"locations":[{{"physicalLocation":{{"artifactLocation":{{"uri":' || to_json(file)
  || ',"uriBaseId":"%SRCROOT%"}},"region":{{"startLine":' || greatest(1, line) || '}}}}}}]}}'"""
_SARIF_HEAD = (
    f'{{"$schema":"{report.SARIF_SCHEMA}","version":"2.1.0","runs":[{{"tool":{{"driver":{{"name":"{report.TOOL}","version":"{report.VERSION}","rules":['
)

ORACLES = {
    "post_sort": f"{_F} SELECT repo, file, line, title, severity, row_number() OVER (PARTITION BY repo ORDER BY {_ORDER}, file, line, title) AS seq FROM found",
    "post_dedupe": f"{_F} SELECT repo, file, line, scanner, title, severity, e2 FROM found QUALIFY row_number() OVER (PARTITION BY repo, file, line, scanner, title ORDER BY {_ORDER}) = 1",
    "gate_exit_code": f"""{_F}, levels(level, most) AS (VALUES {', '.join(f"('{k}', {v})" for k, v in GATES.items())}),
everyone AS (SELECT repo, min(srank) AS worst FROM found GROUP BY repo UNION ALL SELECT 'clean-' || lower(r_name), 99 FROM region)
SELECT repo, level, CAST(CASE WHEN worst <= most THEN 1 ELSE 0 END AS INTEGER) AS exit_code FROM everyone, levels""",
    "agg_phase": f"{_F} SELECT repo, fix_phase, count(*) AS n FROM found GROUP BY ALL",
    "agg_headline": f"""{_F}, counts AS (SELECT repo, count(*) FILTER (WHERE severity = 'CRITICAL') AS critical, count(*) FILTER (WHERE severity = 'HIGH') AS high,
  count(*) FILTER (WHERE severity = 'MEDIUM') AS medium, count(*) FILTER (WHERE severity = 'LOW') AS low FROM found GROUP BY repo)
SELECT *, {_HEADLINE} AS headline FROM counts""",
    "merge_engines": f"""{_F}, native AS (SELECT * FROM found WHERE scanner <> 'semgrep')
SELECT repo, file, line, scanner, title, e2 FROM native UNION ALL SELECT repo, file, line, scanner, title, e2 FROM found f
WHERE scanner = 'semgrep' AND NOT EXISTS (SELECT 1 FROM native n WHERE n.repo = f.repo AND n.file = f.file AND n.line = f.line)""",
    "ai_reviewable": f"{_F} SELECT repo, file, line, title, e2 FROM found WHERE {_REVIEWABLE}",
    "ai_requests": f"""{_F} SELECT repo, file, line, {_ID} AS finding_id, '{{"file":' || to_json(file) || ',"lines":"' || line || '","issue_type":' || to_json({_ID}) || ',"code":' || to_json(snippet) || '}}' AS request
FROM found WHERE {_REVIEWABLE}""",
    "ai_parse": "SELECT event_id, event_id % 7 IN (0, 1, 6) AS parsed, event_id % 7 = 0 AS dismissed, CASE WHEN event_id % 7 = 1 THEN upper(event_type) END AS verdict_severity FROM events",
    "ai_apply": f"""{_F}, judged AS (SELECT *, {_REVIEWABLE} AS reviewed, {_CASE} AS c FROM found)
SELECT repo, file, line, title, CASE WHEN reviewed AND c = 1 AND srank <= 3 THEN 'LOW' WHEN reviewed AND c = 2 AND srank = 0 THEN 'CRITICAL' ELSE severity END AS severity,
  CASE WHEN reviewed AND c IN (0, 1, 2, 4) THEN true END AS ai_confirmed, e2 FROM judged WHERE NOT (reviewed AND c = 0)""",
    "baseline_keys": f"{_KEYED} SELECT repo, id, rel AS file, line, hash FROM keyed",
    "baseline_write": f"{_KEYED} SELECT DISTINCT repo, id, rel AS file, hash FROM keyed",
    "baseline_filter": f"""{_KEYED}, known AS ({_KNOWN}) SELECT repo, rel AS file, line, title, severity, e2 FROM keyed k
WHERE NOT EXISTS (SELECT 1 FROM known n WHERE n.repo = k.repo AND n.id = k.id AND n.file = k.rel AND n.hash = k.hash)""",
    "fix_candidates": f"{_F} SELECT repo, file, line, title, e2 FROM found WHERE fix_phase = 1 AND NOT project_level AND scanner IN ('secrets', 'deps')",
    "report_json": f"""{_UNIQUE} SELECT repo, CAST(0 AS BIGINT) AS seq, '{{"tool":"{report.TOOL}","version":"{report.VERSION}","project":' || to_json(repo) || ',"files_scanned":' || coalesce(CAST(files_scanned AS VARCHAR), 'null')
  || ',"total_issues":' || total || ',"severity_counts":{{' || concat_ws(',', CASE WHEN critical > 0 THEN '"CRITICAL":' || critical END, CASE WHEN high > 0 THEN '"HIGH":' || high END,
  CASE WHEN medium > 0 THEN '"MEDIUM":' || medium END, CASE WHEN low > 0 THEN '"LOW":' || low END) || '}},"findings":[' AS text FROM counts JOIN scanned USING (repo)
UNION ALL SELECT repo, seq, CASE WHEN seq > 1 THEN ',' ELSE '' END || {_JSON} FROM ranked
UNION ALL SELECT repo, {_END}, ']}}' FROM counts""",
    "report_sarif": f"""{_SARIF} SELECT repo, seq, rule_id, rule_index, {_SARIF_RESULT} AS result FROM seen JOIN rules USING (repo, rule_id)""",
    "report_sarif_document": f"""{_SARIF}, texts AS (
SELECT repo, -1 AS seq, {_lit(_SARIF_HEAD)} AS text FROM counts
UNION ALL SELECT r.repo, rule_index, CASE WHEN rule_index > 0 THEN ',' ELSE '' END || '{{"id":' || to_json(r.rule_id) || ',"name":' || to_json(title) || ',"shortDescription":{{"text":' || to_json(title)
  || '}},"fullDescription":{{"text":' || to_json(description) || '}},"defaultConfiguration":{{"level":"' || {_SARIF_LEVEL} || '"}},"properties":{{"tags":["security"],"security-severity":"'
  || {_case('severity', report.SARIF_SCORES, '5.5')} || '"}},"help":{{"text":' || to_json(fix_summary) || '}}' || coalesce(',"helpUri":' || nullif({_REFS}, ''), '') || '}}'
  FROM rules r JOIN seen s ON s.repo = r.repo AND s.seq = r.first
UNION ALL SELECT repo, {1 << 40}, ']}}}},"results":[' FROM counts
UNION ALL SELECT repo, seq + {1 << 40}, CASE WHEN seq > 1 THEN ',' ELSE '' END || {_SARIF_RESULT} FROM seen JOIN rules USING (repo, rule_id)
UNION ALL SELECT repo, {_END}, ']' || coalesce(',"properties":{{"filesScanned":' || files_scanned || '}}', '') || '}}]}}' FROM counts JOIN scanned USING (repo))
SELECT repo, CAST(seq AS BIGINT) AS seq, text FROM texts""",
    "report_by_file": f"""{_F}, d AS (SELECT DISTINCT repo, file AS path, CAST(greatest(0, line - 1) AS INTEGER) AS line, CAST({_case('severity', report.DIAGNOSTIC_RANK, 1)} AS INTEGER) AS severity,
  title || CASE WHEN reachable THEN ' [reachable from user input]' ELSE '' END || ' — ' || description AS message, {_ID} AS code FROM found)
SELECT *, row_number() OVER (PARTITION BY repo, path ORDER BY line, severity, message, code) AS nth FROM d""",
    "report_sarif_rules": f"{_SARIF} SELECT r.repo, r.rule_id, r.rule_index, s.title, s.severity FROM rules r JOIN seen s ON s.repo = r.repo AND s.seq = r.first",
    "report_markdown": f"""{_UNIQUE} SELECT repo, CAST(0 AS BIGINT) AS seq, {_MD_HEAD} AS text FROM counts JOIN scanned USING (repo)
UNION ALL SELECT repo, seq, {_MD_BODY} FROM ranked UNION ALL SELECT repo, {_END}, {_MD_TAIL} FROM counts""",
    "report_prompts": f"""{_UNIQUE} SELECT repo, CAST(0 AS BIGINT) AS seq, CASE WHEN total = 0 THEN {_lit(f"# {report.TOOL} — AI Fix Prompts" + chr(10) * 2 + "Paste each block below into your AI assistant. Each prompt is self-contained." + chr(10) * 2 + "No vulnerabilities found. Nothing to fix." + chr(10))} ELSE {_lit(f"# {report.TOOL} — AI Fix Prompts" + chr(10) * 2 + "Paste each block below into your AI assistant. Each prompt is self-contained." + chr(10))} END AS text FROM counts
UNION ALL SELECT repo, seq, CASE WHEN seq > 1 THEN {_lit(chr(10) * 2 + '---' + chr(10) * 2)} ELSE {_lit(chr(10) + '---' + chr(10) * 2)} END || '## ' || seq || '. ' || {_BADGE} || ' ' || severity || ' — ' || title || {_lit(chr(10) * 2)} || {_PROMPT} FROM ranked""",
    "report_diagnostics": f"""{_F} SELECT repo, file AS path, CAST(greatest(0, line - 1) AS INTEGER) AS line, CAST({_case('severity', report.DIAGNOSTIC_RANK, 1)} AS INTEGER) AS severity,
  title || CASE WHEN reachable THEN ' [reachable from user input]' ELSE '' END || ' — ' || description AS message, {_ID} AS code FROM found""",
    "fn_finding_id": f"SELECT p_partkey, {corpus.finding_id_sql(q('deps'), chr(39) + '  ' + chr(39) + ' || p_name || ' + q(': ') + ' || p_brand || ' + q(' — é! '))} AS finding_id, {corpus.finding_id_sql('p_brand', '(CASE WHEN p_size % 2 = 0 THEN ' + q('--') + ' ELSE p_type END)')} AS short_id FROM part",
    "eval_categories": f"{_CASES} SELECT scanner, title, array_to_string(cats, ',') AS categories, count(*) AS n FROM cf GROUP BY ALL",
    "eval_match": f"{_CASES} SELECT cve, weakness_id, count(DISTINCT finding_id) AS n FROM pairs GROUP BY ALL",
    "eval_scores": f"""{_CASES}, judged AS (SELECT unnest(categories) AS category, EXISTS (SELECT 1 FROM pairs p WHERE p.cve = l.cve AND p.weakness_id = l.weakness_id) AS hit FROM labels_cve l),
unmatched AS (SELECT * FROM cf f WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.cve = f.cve AND p.finding_id = f.finding_id)),
shared AS (SELECT unnest(list_intersect(u.cats, e.categories)) AS category FROM unmatched u JOIN (SELECT DISTINCT cve, categories FROM labels_cve) e USING (cve)),
parts AS (SELECT category, CASE WHEN hit THEN 1 ELSE 0 END AS tp, 0 AS fp, CASE WHEN hit THEN 0 ELSE 1 END AS fn FROM judged UNION ALL SELECT category, 0, 1, 0 FROM shared),
sums AS (SELECT coalesce(category, 'all') AS category, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM parts GROUP BY ROLLUP (category))
SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS recall FROM sums""",
}
ORACLES["report_written"] = f"SELECT repo, text FROM ({ORACLES['report_sarif_document']})"
