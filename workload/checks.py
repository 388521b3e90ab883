"""Queries of the secrets, header and custom-rule scanners, and of the whole scan."""

from __future__ import annotations

from pyspark.sql import functions as F

from codewarden.operators import baseline, custom, headers, post
from codewarden.plans import file_pass
from codewarden.plans.scan import Options, scan, scan_diff
from codewarden.rules import headers as H
from codewarden.rules import secrets as S
from codewarden.sources import patches
from codewarden.sources.files import from_texts
from workload import corpus, dependencies, injection
from workload.corpus import quoted as q

COLUMNS = ["repo", "file", "line", "severity", "title", "fix_phase", "snippet"]
TOKENS = [r.title for r in S.TOKEN_RULES]
GENERIC, PASSWORD = (r.title for r in S.VALUE_RULES)


def texts(spark, sf):
    """Documents, pages and conversation turns as files, with their whole texts."""
    read = lambda name, *keys: corpus.table(spark, sf, name, *keys)
    number = lambda c: F.col(c).cast("string")
    documents = from_texts(read("documents", "doc_id"), F.lit("documents"), number("doc_id"), F.col("doc_id"), F.col("text"))
    pages = from_texts(read("pages", "page_id"), F.lit("pages"), number("page_id"), F.col("page_id"), F.col("html"))
    turns = from_texts(
        read("conversations", "conv_id", "turn"), F.lit("conversations"), F.concat_ws("/", number("conv_id"), number("turn")), F.col("conv_id"), F.col("text")
    )
    return documents.unionByName(pages).unionByName(turns)


def secret_findings(spark, sf):
    return file_pass.findings(corpus.files(spark, sf), ("secrets",))


def secrets_titled(*titles):
    return lambda spark, sf: secret_findings(spark, sf).where(F.col("title").isin(*titles)).select(*COLUMNS)


def sec_generic(spark, sf):
    return file_pass.findings(texts(spark, sf), ("secrets",)).select(*COLUMNS)


def sec_placeholder(spark, sf):
    found = secret_findings(spark, sf).groupBy("repo", F.col("file").alias("path")).agg(F.count(F.lit(1)).alias("n"))
    files = corpus.files(spark, sf).select("repo", "path")
    return files.join(found, ["repo", "path"], "left").select("repo", "path", F.coalesce("n", F.lit(0)).alias("n"))


def header(check):
    title = H.TEXTS[check][0]
    return lambda spark, sf: (
        file_pass.findings(corpus.files(spark, sf), ("headers",)).where(F.col("title") == title).select(*COLUMNS)
    )


def hdr_frameworks(spark, sf):
    flags = headers.frameworks(F.col("content"))
    return corpus.files(spark, sf).select("repo", "path", *[c.alias(name) for name, c in flags.items()])


def hdr_csrf(spark, sf):
    return headers.csrf_findings(headers.file_signals(corpus.files(spark, sf))).select(*COLUMNS, "project_level")


RULES = [
    custom.CustomRule("no-const", r"\bconst \w+", "Avoid it.", "low", 2, (".js", ".ts"), "Rename."),
    custom.CustomRule("hex-value", r'(?P<quote>")[0-9a-f]{32,40}(?P=quote)', "Looks like a digest.", "HIGH"),
    custom.CustomRule("run-on", r"que(?=que)", "Repeated syllable.", "MEDIUM", 5),
]


def custom_scan(spark, sf):
    found = file_pass.findings(corpus.files(spark, sf), ("custom",), RULES)
    return found.select(*COLUMNS, "description", "fix_summary")


RULE_FILE = """rules:
  - {id: no-const, pattern: '\\bconst \\w+', message: "Avoid it.", severity: low, fix_phase: 2, suffixes: [".JS", ".ts"], fix: "Rename."}
  - {id: hex-value, pattern: '(?P<quote>")[0-9a-f]{32,40}(?P=quote)', message: "Looks like a digest.", severity: HIGH}
  - {id: broken, pattern: '(', message: "Never runs.", severity: HIGH}
"""


def scan_rule_files(spark, sf):
    """Every second repository keeps rules of its own in a file; the others have none."""
    files = corpus.files(spark, sf)
    repos = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("source").alias("repo")).distinct().where("length(repo) = 5")
    own = repos.select("repo", F.lit("conf/rules.yml").alias("path"), F.lit(-1).cast("bigint").alias("file_seq"), F.lit(RULE_FILE).alias("content"))
    found = scan(files.unionByName(own.select(*files.columns)), Options(scanners=("custom",), rule_files=("conf/rules.yml",)))
    return found.select("repo", "file", "line", "title", "severity", "description", "fix_phase", "fix_summary")


def raw_rules(spark, sf):
    part = spark.read.parquet(f"{sf}/part.parquet")
    return part.selectExpr(
        "'rules.yml' AS source",
        "p_partkey AS pos",
        "CASE WHEN p_partkey % 13 = 0 THEN ' ' WHEN p_partkey % 17 = 0 THEN NULL ELSE concat(p_type, cast(p_size AS string)) END AS id",
        "CASE p_partkey % 9 WHEN 0 THEN '' WHEN 1 THEN '(' WHEN 2 THEN 'a*' ELSE p_name END AS pattern",
        "CASE WHEN p_partkey % 7 = 0 THEN ' ' ELSE 'text' END AS message",
        "CASE p_partkey % 5 WHEN 0 THEN 'urgent' WHEN 1 THEN 'high' ELSE 'LOW' END AS severity",
        "CASE p_partkey % 11 WHEN 0 THEN '0' WHEN 1 THEN '6' WHEN 2 THEN 'true' WHEN 3 THEN NULL ELSE '2' END AS fix_phase",
        "CASE p_partkey % 6 WHEN 0 THEN '\".py\"' WHEN 1 THEN '[\".py\"]' END AS suffixes",
        "'' AS fix",
    )


def rules_rejected(spark, sf):
    return custom.validate(raw_rules(spark, sf)).select("pos", "id", F.coalesce("reason", F.lit("accepted")).alias("reason"))


def scan_all(spark, sf):
    found = scan(corpus.files(spark, sf), Options(exclude=("*.min.js",)))
    return found.groupBy("repo", "scanner", "severity").agg(F.count(F.lit(1)).alias("n"))


def _path(spark, sf, *templates):
    """(repo, path, doc_id) of the documents that some templates make into files."""
    documents = corpus.table(spark, sf, "documents", "doc_id").select("doc_id", "source", F.expr(corpus.template_no()).alias("t"))
    suffix = F
    for i in templates:
        suffix = suffix.when(F.col("t") == i, F.lit(corpus.TEMPLATES[i][0]))
    rows = documents.where(F.col("t").isin(*templates))
    return rows.select(F.col("source").alias("repo"), F.concat(F.lit("src/f"), F.col("doc_id").cast("string"), suffix).alias("path"), "doc_id")


def engine_reports(spark, sf):
    """One report per TypeScript file: a finding on a line of its own, and one where a native finding is."""
    result = lambda line: (
        f"""concat('{{"check_id": "x.engine-rule", "path": "', path, '", "start": {{"line": {line}}}, "extra": {{"message": "m", "severity": "ERROR"}}}}')"""
    )
    body = f"""concat('{{"results": [', {result(2)}, ', ', {result(10)}, ']}}')"""
    return _path(spark, sf, 2).select("repo", F.col("doc_id").alias("doc"), F.expr(body).alias("json"))


def scan_full(spark, sf):
    """Everything at once: five scanners, rules, advisories, an engine's reports, verdicts, a baseline, an exclude."""
    files = corpus.files(spark, sf).unionByName(dependencies.files(spark, sf))
    verdicts = _path(spark, sf, 0).select(
        "repo", F.col("path").alias("file"), F.lit(7).alias("line"), F.lit("injection/eval_usage").alias("finding_id"),
        F.lit('{"confirmed": false}').alias("raw"), F.lit(None).cast("string").alias("error"),
    )
    known = baseline.entries(injection.scanned(spark, sf).where(F.col("title") == "Path traversal"))
    options = Options(exclude=("*.min.js",), engines=("semgrep",), rules=tuple(RULES))
    found = scan(files, options, dependencies.advisories(spark, sf), {"semgrep": engine_reports(spark, sf)}, verdicts, known)
    return found.select("repo", "file", "line", "scanner", "title", "severity")


IGNORE = "*.min.js\n/src/f*1.js\n!/src/f*21.js\nf*2.py\n"


def scan_gitignore(spark, sf):
    """With a .gitignore in every repository, decided on what was found: no contents meet the patterns."""
    files = corpus.files(spark, sf)
    ignore = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("source").alias("repo")).distinct()
    rows = ignore.select("repo", F.lit(".gitignore").alias("path"), F.lit(-1).cast("bigint").alias("file_seq"), F.lit(IGNORE).alias("content"))
    found = scan(files.unionByName(rows.select(*files.columns)), Options(ignore_limit=0))
    return found.select("repo", "file", "line", "scanner", "title", "severity")


def scan_changed(spark, sf):
    """Findings on the changed lines of every other document's file."""
    changed = _path(spark, sf, *range(corpus.N)).where("doc_id % 2 = 0")
    head = F.array(F.concat(F.lit("+++ b/"), "path"), F.lit("@@ -1,0 +5,10 @@"))
    raw = changed.select("repo", "doc_id", F.posexplode(head).alias("i", "raw"))
    lines = patches.changed_lines(raw.select("repo", F.expr("doc_id * 2 + i").alias("pos"), "raw"))
    found = scan_diff(corpus.files(spark, sf), lines)
    return found.select("repo", "file", "line", "scanner", "title", "severity")


def scan_select(spark, sf):
    found = scan(corpus.files(spark, sf), Options(scanners=("secrets", "headers")))
    return found.groupBy("scanner", "title").agg(F.count(F.lit(1)).alias("n"))


def post_suppress(spark, sf):
    found = post.suppress(injection.scanned(spark, sf))
    return found.select(*COLUMNS)


def agg_severity(spark, sf):
    counts = post.severity_counts(scan(corpus.files(spark, sf)))
    return counts


QUERIES = {
    "scan_all": scan_all,
    "scan_full": scan_full,
    "scan_diff": scan_changed,
    "scan_gitignore": scan_gitignore,
    "scan_select": scan_select,
    "sec_tokens": secrets_titled(*TOKENS),
    "sec_generic": sec_generic,
    "sec_password": secrets_titled(PASSWORD),
    "sec_placeholder": sec_placeholder,
    "hdr_frameworks": hdr_frameworks,
    "hdr_helmet": header("helmet"),
    "hdr_flask": header("flask"),
    "hdr_fastapi": header("fastapi"),
    "hdr_cors": header("cors"),
    "hdr_django": header("django"),
    "hdr_csrf": hdr_csrf,
    "custom_scan": custom_scan,
    "rules_rejected": rules_rejected,
    "scan_rule_files": scan_rule_files,
    "post_suppress": post_suppress,
    "agg_severity": agg_severity,
}

# --- DuckDB side ----------------------------------------------------------------------------------

_COMMENT = q(r"^\s*(?:#|//|\*|/\*)")
_LOOKUP = q(r"os\.environ|os\.getenv|getenv\s*\(|process\.env|env\[")
_FAKE = q(S.PLACEHOLDER)


def _cut(files: str) -> str:
    return f"""WITH files AS ({files}),
cut AS (SELECT *, string_split(CASE WHEN content LIKE '%' || chr(10) THEN content[:-2] ELSE content END, chr(10)) AS ls FROM files),
lines AS (SELECT repo, path, line, ls[line] AS text, array_to_string(list_slice(ls, greatest(line - 1, 1), line + 1), chr(10)) AS snippet
  FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS line FROM cut))"""


def _secrets(rules) -> str:
    parts = []
    for rule in rules:
        rx = q(("(?i)" if rule.ignore_case else "") + rule.pattern)
        # Tokens are judged by what follows up to a quote or a blank, assignments by their value.
        judged = f"regexp_extract(m, {rx}, 1)" if rule in S.VALUE_RULES else f"regexp_extract(substr(text, strpos(text, m)), {q(r'^[^\s' + chr(39) + chr(34) + r']+')})"
        parts.append(
            f"SELECT repo, path AS file, CAST(line AS INTEGER) AS line, 'CRITICAL' AS severity, {q(rule.title)} AS title, CAST(1 AS INTEGER) AS fix_phase, snippet "
            f"FROM (SELECT *, unnest(regexp_extract_all(text, {rx})) AS m FROM lines) WHERE NOT regexp_matches(text, {_COMMENT}) "
            f"AND NOT regexp_matches(lower({judged}), {_LOOKUP}) AND NOT regexp_matches(lower({judged}), {_FAKE})"
        )
    return " UNION ALL ".join(parts)


_FILES = _cut(corpus.files_sql())
_TEXTS = """SELECT 'documents' AS repo, CAST(doc_id AS VARCHAR) AS path, text AS content FROM documents
UNION ALL SELECT 'pages', CAST(page_id AS VARCHAR), html FROM pages
UNION ALL SELECT 'conversations', CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR), text FROM conversations"""

_FRAMEWORK = {
    "express": r"""require\s*\(\s*['"]express['"]\s*\)|from\s+['"]express['"]""",
    "fastapi": r"from\s+fastapi\s+import|import\s+fastapi",
    "flask": r"from\s+flask\s+import|import\s+flask",
    "django": r"from\s+django|import\s+django",
}
_ANY = "(" + " OR ".join(f"regexp_matches(content, {q(rx)})" for rx in _FRAMEWORK.values()) + ")"
_SESSION = q(
    r"(?i)set_cookie|response\.cookies|request\.cookies|session\[|flask_login|render_template|<form\b|app\.secret_key|"
    r"SESSION_COOKIE|express-session|cookie-session|req\.session"
)


def _header(check: str, present: str, absent: str, web: str = f"AND {_ANY}") -> str:
    title, severity, phase, _, _ = H.TEXTS[check]
    before = f"substr(content, 1, strpos(content, regexp_extract(content, {q(present)})) - 1)"
    line = "1" if check == "helmet" else f"length({before}) - length(replace({before}, chr(10), '')) + 1"
    snippet = (
        "CASE WHEN path LIKE '%.py' THEN '# ' ELSE '// ' END || 'No helmet() middleware found'"
        if check == "helmet"
        else "array_to_string(list_slice(ls, greatest(line - 1, 1), line + 1), chr(10))"
    )
    veto = f"AND NOT regexp_matches(content, {q(absent)})" if absent else ""
    return f"""{_FILES} SELECT repo, path AS file, CAST(line AS INTEGER) AS line, '{severity}' AS severity, {q(title)} AS title,
  CAST({phase} AS INTEGER) AS fix_phase, {snippet} AS snippet FROM (SELECT *, {line} AS line FROM cut
  WHERE t <> 11 {web} AND regexp_matches(content, {q(present)}) {veto})"""


_HEADERS = {
    "hdr_helmet": _header("helmet", _FRAMEWORK["express"], r"""require\s*\(\s*['"]helmet['"]\s*\)|from\s+['"]helmet['"]"""),
    "hdr_flask": _header("flask", r"\bFlask\s*\(", r"(?i)Talisman|Strict-Transport-Security|Content-Security-Policy|X-Frame-Options|X-Content-Type-Options"),
    "hdr_fastapi": _header("fastapi", r"\bFastAPI\s*\(", r"(?i)add_middleware|HTTPSRedirectMiddleware|TrustedHostMiddleware|import\s+secure|from\s+secure|Strict-Transport-Security|Content-Security-Policy"),
    "hdr_cors": _header("cors", r"""cors\(\s*\)|origin:\s*['"]?\*['"]?|Access-Control-Allow-Origin.*\*""", ""),
    "hdr_django": _header("django", r"(?m)^\s*INSTALLED_APPS\s*=", r"SECURE_SSL_REDIRECT|SECURE_HSTS_SECONDS", f"AND regexp_matches(content, {q(chr(91) + chr(39) + chr(34) + chr(93) + 'django.(?:contrib|middleware)')})"),
}
_CSRF = f"""{_FILES} SELECT repo, anchor AS file, CAST(1 AS INTEGER) AS line, 'MEDIUM' AS severity, 'No CSRF protection detected' AS title, CAST(2 AS INTEGER) AS fix_phase,
  CASE WHEN regexp_matches(anchor, '\\.(py|rb|sh|bash|yml|yaml|tf)$') THEN '# ' ELSE '// ' END || 'No CSRF middleware found' AS snippet, true AS project_level
  FROM (SELECT repo, min_by(path, file_seq) FILTER (WHERE {_ANY}) AS anchor, bool_or(regexp_matches(content, {_SESSION})) AS session,
    bool_or(regexp_matches(content, '(?i)csrf|csurf')) AS csrf FROM files GROUP BY repo) WHERE anchor IS NOT NULL AND session AND NOT csrf"""

# Each "que" that another "que" follows is one match: a run of n of them has n - 1.
_CUSTOM = f"""{_FILES}, hits AS (
  SELECT *, 'no-const' AS title, 'LOW' AS severity, 2 AS fix_phase, 'Avoid it.' AS description, 'Rename.' AS fix_summary,
    len(regexp_extract_all(text, '\\bconst \\w+')) AS n FROM lines WHERE regexp_matches(path, '\\.(js|ts)$')
  UNION ALL SELECT *, 'hex-value', 'HIGH', 3, 'Looks like a digest.', '', len(regexp_extract_all(text, '"[0-9a-f]{{32,40}}"')) FROM lines
  UNION ALL SELECT *, 'run-on', 'MEDIUM', 5, 'Repeated syllable.', '',
    CAST(coalesce(list_sum(list_transform(regexp_extract_all(text, '(?:que){{2,}}'), lambda r: length(r) // 3 - 1)), 0) AS BIGINT) FROM lines)
SELECT repo, path AS file, CAST(line AS INTEGER) AS line, severity, title, CAST(fix_phase AS INTEGER) AS fix_phase, snippet, description, fix_summary
FROM (SELECT *, unnest(range(n)) FROM hits)"""

_RULES = """WITH raw AS (SELECT p_partkey AS pos,
  CASE WHEN p_partkey % 13 = 0 THEN ' ' WHEN p_partkey % 17 = 0 THEN NULL ELSE p_type || CAST(p_size AS VARCHAR) END AS id,
  CASE WHEN p_partkey % 9 = 0 THEN 'missing pattern' WHEN p_partkey % 9 = 1 THEN 'invalid regex' WHEN p_partkey % 9 = 2 THEN 'matches the empty string'
    WHEN p_partkey % 7 = 0 THEN 'missing message' WHEN p_partkey % 5 = 0 THEN 'bad severity' WHEN p_partkey % 11 IN (0, 1, 2) THEN 'bad fix_phase'
    WHEN p_partkey % 6 = 0 THEN 'bad suffixes' END AS problem FROM part),
firsts AS (SELECT id, min(pos) AS first FROM raw WHERE problem IS NULL AND trim(coalesce(id, '')) <> '' GROUP BY id)
SELECT pos, raw.id, CASE WHEN trim(coalesce(raw.id, '')) = '' THEN 'missing id' WHEN pos > first THEN 'duplicate id' ELSE coalesce(problem, 'accepted') END AS reason
FROM raw LEFT JOIN firsts ON firsts.id = raw.id"""

_INJECTED = injection.group_sql(("sql", "cmd", "cmd_const", "xss"), [t for f in injection._PY_FINDINGS.values() for _, t, _, _, _ in f])
_SILENCED = "(file LIKE '%.js' AND file NOT LIKE '%.min.js' AND line IN (24, 26))"
_EVERYTHING = " UNION ALL ".join(
    [f"SELECT repo, file, line, 'injection' AS scanner, title, severity FROM ({sql}) WHERE NOT {_SILENCED}"
     for sql in [_INJECTED, injection._WEAK, *[injection.sink_sql(name) for name in injection._SINKS]]]
    + [f"SELECT repo, file, line, 'secrets' AS scanner, title, severity FROM ({_FILES} {_secrets(S.RULES)}) WHERE NOT (file LIKE '%.js' AND file NOT LIKE '%.min.js' AND line = 24)"]
    + [f"SELECT repo, file, line, 'headers' AS scanner, title, severity FROM ({sql})" for sql in [*_HEADERS.values(), _CSRF]]
)
_DISTINCT = f"(SELECT repo, file, line, scanner, title, min(severity) AS severity FROM ({_EVERYTHING}) GROUP BY repo, file, line, scanner, title)"

_KINDS = [f"SELECT * FROM {_DISTINCT}", f"SELECT DISTINCT repo, file, line, 'custom' AS scanner, title, severity FROM ({_CUSTOM})"]
_NATIVE = " UNION ALL ".join(
    [f"SELECT repo, file, line, scanner, title, severity FROM ({sql})" for sql in _KINDS]
    + [f"SELECT repo, file, line, 'deps', title, severity FROM ({dependencies.ORACLES['deps_vulns']})"]
)
_FULL = f"""WITH native AS (SELECT * FROM ({_NATIVE}) WHERE file NOT LIKE '%.min.js' AND NOT (scanner = 'custom' AND {_SILENCED})),
reported AS (SELECT source AS repo, 'src/f' || CAST(doc_id AS VARCHAR) || '.ts' AS file, unnest([2, 10]) AS line, 'semgrep' AS scanner, 'engine-rule' AS title, 'HIGH' AS severity
  FROM documents WHERE {corpus.template_no()} = 2)
SELECT * FROM native WHERE title <> 'Path traversal' AND NOT (title = 'eval() usage' AND line = 7 AND file LIKE '%.js')
UNION ALL SELECT * FROM reported r WHERE NOT EXISTS (SELECT 1 FROM native n WHERE n.repo = r.repo AND n.file = r.file AND n.line = r.line)"""

_NOT_IGNORED = f"""SELECT * FROM ({corpus.files_sql()}) WHERE path NOT LIKE '%.min.js' AND NOT regexp_matches(path, '^src/f[^/]*2\\.py$')
AND NOT (regexp_matches(path, '^src/f[^/]*1\\.js$') AND NOT regexp_matches(path, '^src/f[^/]*21\\.js$'))"""

ORACLES = {
    "scan_full": _FULL,
    "scan_gitignore": f"SELECT * FROM {_DISTINCT.replace(corpus.files_sql(), _NOT_IGNORED)}",
    "scan_diff": f"SELECT * FROM {_DISTINCT} WHERE line BETWEEN 5 AND 14 AND title <> 'No CSRF protection detected' AND CAST(regexp_extract(file, 'f(\\d+)\\.', 1) AS BIGINT) % 2 = 0",
    "scan_all": f"SELECT repo, scanner, severity, count(*) AS n FROM {_DISTINCT} WHERE file NOT LIKE '%.min.js' GROUP BY ALL",
    "scan_select": f"SELECT scanner, title, count(*) AS n FROM {_DISTINCT} WHERE scanner IN ('secrets', 'headers') GROUP BY ALL",
    "sec_tokens": f"{_FILES} {_secrets(S.TOKEN_RULES)}",
    "sec_password": f"{_FILES} {_secrets(S.VALUE_RULES[1:])}",
    "sec_generic": f"{_cut(_TEXTS)} {_secrets(S.RULES)}",
    "sec_placeholder": f"{_FILES}, found AS ({_secrets(S.RULES)}) SELECT f.repo, f.path, count(file) AS n FROM files f LEFT JOIN found s ON s.repo = f.repo AND s.file = f.path GROUP BY f.repo, f.path",
    "hdr_frameworks": f"{_FILES} SELECT repo, path, {', '.join(f'regexp_matches(content, {q(rx)}) AS {name}' for name, rx in _FRAMEWORK.items())} FROM files",
    **_HEADERS,
    "hdr_csrf": _CSRF,
    "custom_scan": _CUSTOM,
    "rules_rejected": _RULES,
    "scan_rule_files": f"""SELECT DISTINCT repo, file, line, title, severity, description, fix_phase, fix_summary FROM ({_CUSTOM})
WHERE title <> 'run-on' AND length(repo) = 5 AND NOT (file LIKE '%.js' AND file NOT LIKE '%.min.js' AND line IN (24, 26))""",
    "post_suppress": " UNION ALL ".join(f"SELECT {', '.join(COLUMNS)} FROM ({sql}) WHERE NOT {_SILENCED}" for sql in [_INJECTED, injection._WEAK, *[injection.sink_sql(name) for name in injection._SINKS]]),
    "agg_severity": f"""SELECT repo, count(*) FILTER (WHERE severity = 'CRITICAL') AS critical, count(*) FILTER (WHERE severity = 'HIGH') AS high,
  count(*) FILTER (WHERE severity = 'MEDIUM') AS medium, count(*) FILTER (WHERE severity = 'LOW') AS low, count(*) AS total FROM {_DISTINCT} GROUP BY repo""",
}
