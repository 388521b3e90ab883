"""Queries of the injection and taint operators, and their DuckDB counterparts.

The DuckDB side never parses: patterns are RE2 forms per line (a lookaround becomes a second
predicate on the matched tail), the JavaScript environment is a recursive query, and the findings of
the Python templates are listed from the template texts, shifted by each document's line count.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from codewarden.functions import text as X
from codewarden.operators import facts_py, injection, taint_js, taint_py
from codewarden.operators.injection import looks_minified, taint_columns
from codewarden.plans import file_pass
from codewarden.rules import injection as R
from codewarden.rules import taint as T
from workload import corpus

COLUMNS = ["repo", "file", "line", "severity", "title", "fix_phase", "reachable", "snippet"]

# --- Spark side -----------------------------------------------------------------------------------


def scanned(spark, sf):
    return file_pass.findings(corpus.files(spark, sf), ("injection",))


def of_group(*groups):
    titles = [r.title for r in R.RULES if r.group in groups]
    return lambda spark, sf: scanned(spark, sf).where(F.col("title").isin(*titles)).select(*COLUMNS)


def of_titles(suffixes, *titles):
    return lambda spark, sf: (
        scanned(spark, sf).where(F.col("title").isin(*titles) & X.suffix_of(F.col("file")).isin(*suffixes)).select(*COLUMNS)
    )


def js_files(spark, sf):
    return taint_columns(corpus.files(spark, sf)).where(F.col("_suffix").isin(*T.JS_SUFFIXES))


def js_sources(spark, sf):
    lines = js_files(spark, sf).select("repo", "path", F.posexplode("_lines").alias("i", "text"))
    return lines.where(taint_js.has_source(F.col("text"))).select("repo", "path", (F.col("i") + 1).alias("line"), "text")


def js_defs(spark, sf):
    d = js_files(spark, sf).select("repo", "path", F.explode("_defs").alias("d"))
    return d.select("repo", "path", "d.line", F.array_join("d.names", ",").alias("names"), "d.src", F.col("d.const").alias("is_const"))


def js_uses(spark, sf):
    d = js_files(spark, sf).select("repo", "path", F.explode("_defs").alias("d"))
    return d.select("repo", "path", "d.line", F.explode("d.uses").alias("name"))


def js_env(spark, sf):
    rows = js_files(spark, sf).select(
        "repo", "path", "_tainted", "_constants", F.explode(F.array_distinct(F.flatten(F.transform("_defs", lambda d: d["names"])))).alias("name")
    )
    state = F.when(F.array_contains("_tainted", F.col("name")), F.lit(True)).when(
        F.array_contains("_constants", F.col("name")), F.lit(False)
    )
    return rows.select("repo", "path", "name", state.alias("state"))


def js_reachable(spark, sf):
    rows = js_files(spark, sf).select("repo", "path", "_tainted", "_constants", F.posexplode("_lines").alias("i", "text"))
    usable = rows.where(F.contains("text", F.lit("(")))
    verdict = taint_js.reachable(F.col("text"), F.col("_tainted"), F.col("_constants"))
    return usable.select("repo", "path", (F.col("i") + 1).alias("line"), verdict.alias("reachable"))


def js_xss_const_drop(spark, sf):
    xss = [r.title for r in R.XSS_RULES]
    found = scanned(spark, sf).where(F.col("title").isin(*xss))
    return found.groupBy("repo", "file", "title").agg(
        F.count(F.lit(1)).alias("kept"), F.count_if(~F.col("reachable")).alias("constant")
    )


def inj_minified(spark, sf):
    f = corpus.files(spark, sf).withColumn("_lines", X.split_lines(F.col("content")))
    code = f.where(X.suffix_of(F.col("path")).isin(*T.JS_SUFFIXES))
    return code.select("repo", "path", looks_minified(F.col("path"), F.col("_lines")).alias("minified"))


def py_modules(spark, sf):
    f = corpus.files(spark, sf).where(X.suffix_of(F.col("path")) == ".py")
    return (
        f.withColumn("_syntax", facts_py.facts(F.col("content")))
        .withColumn("_facts", taint_py.judged(F.col("_syntax")))
        .withColumn("_parsed", F.col("_facts").isNotNull())
        .withColumn("_tainted", taint_py.reached(F.col("_facts")))
        .withColumn("_constants", taint_py.constant_names(F.col("_facts"), F.col("_tainted")))
    )


def py_facts(spark, sf):
    facts = F.col("_facts")
    return py_modules(spark, sf).select(
        "repo",
        "path",
        F.col("_parsed").alias("parsed"),
        F.coalesce(facts["functions"], F.lit(0)).alias("functions"),
        F.coalesce(F.size(facts["calls"]), F.lit(0)).alias("calls"),
        F.coalesce(F.size(facts["assigns"]), F.lit(0)).alias("assigns"),
        F.coalesce(F.size(F.filter(facts["assigns"], lambda a: a["src"])), F.lit(0)).alias("source_assigns"),
        F.coalesce(F.size(F.filter(facts["assigns"], lambda a: a["const"])), F.lit(0)).alias("constant_assigns"),
    )


def py_env(spark, sf):
    names = F.array_distinct(F.concat(F.transform(F.col("_facts")["assigns"], lambda a: a["name"]), "_tainted"))
    rows = py_modules(spark, sf).select("repo", "path", "_tainted", "_constants", F.explode(names).alias("name"))
    state = F.when(F.array_contains("_tainted", F.col("name")), F.lit(True)).when(F.array_contains("_constants", F.col("name")), F.lit(False))
    kept = rows.where((F.col("name") != facts_py.ROOT) & ~F.col("name").startswith(facts_py.RETURN))
    return kept.select("repo", "path", "name", state.alias("state"))


def py_xfn(step):
    """Propagation edges that carried taint: 2 argument to parameter, 3 body to return value."""

    def query(spark, sf):
        rows = py_modules(spark, sf).select("repo", "path", "_tainted", F.explode(F.col("_facts")["edges"]).alias("e"))
        ways = rows.where(F.col("e.step") == step).select("repo", "path", "_tainted", F.explode("e.srcs").alias("src"), F.col("e.dst").alias("dst"))
        return ways.where(F.array_contains("_tainted", F.col("src"))).select("repo", "path", "src", "dst").distinct()

    return query


def py_reachable(spark, sf):
    found = scanned(spark, sf).where(F.col("file").endswith(".py"))
    return found.groupBy("repo", "file").agg(
        F.count_if(F.col("reachable")).alias("reached"),
        F.count_if(~F.col("reachable")).alias("constant"),
        F.count_if(F.col("reachable").isNull()).alias("unknown"),
    )


PY = (".py",)
QUERIES = {
    "inj_sql": of_group("sql"),
    "inj_cmd": of_group("cmd", "eval_exec", "os_system"),
    "inj_cmd_const": of_group("cmd_const"),
    "inj_xss": of_group("xss"),
    "inj_weak_random": of_group("weak_random"),
    "inj_minified": inj_minified,
    "inj_skipped": lambda spark, sf: injection.skipped(corpus.files(spark, sf)),
    "js_sources": js_sources,
    "js_defs": js_defs,
    "js_uses": js_uses,
    "js_env": js_env,
    "js_reachable": js_reachable,
    "js_xss_const_drop": js_xss_const_drop,
    "js_nosql": of_group("nosql"),
    "js_query_ident": of_group("query_ident"),
    "js_exec_ident": of_group("exec_ident"),
    "js_path": of_titles(T.JS_SUFFIXES, "Path traversal"),
    "js_ssrf": of_titles(T.JS_SUFFIXES, "Server-side request forgery (SSRF)"),
    "js_deserialize": of_titles(T.JS_SUFFIXES, "Insecure deserialization"),
    "js_redirect": of_titles(T.JS_SUFFIXES, "Open redirect"),
    "py_facts": py_facts,
    "py_env": py_env,
    "py_xfn_param": py_xfn(2),
    "py_xfn_return": py_xfn(3),
    "py_reachable": py_reachable,
    "py_eval_exec": of_titles(PY, "eval() usage", "exec() usage"),
    "py_os_system": of_titles(PY, "os.system() call", "os.system() with constant command"),
    "py_shell_true": of_titles(PY, "shell=True with dynamic command", "shell=True with constant command"),
    "py_sql": of_titles(PY, "SQL f-string query", "SQL string concatenation"),
    "py_path": of_titles(PY, "Path traversal"),
    "py_ssrf": of_titles(PY, "Server-side request forgery (SSRF)"),
    "py_deserialize": of_titles(PY, "Insecure deserialization"),
    "py_redirect": of_titles(PY, "Open redirect"),
}

# --- DuckDB side ----------------------------------------------------------------------------------

q = corpus.quoted
_PREFIX = r"(?:^|[^\w.])"
_CONST = r"""(?:"[^"$\n]*"|'[^'$\n]*'|`[^`$\n]*`)"""
_IDENT = r"(?:^|[^\w$.])([A-Za-z_$][\w$]*)"
_SOURCE = (
    r"\b(?:req|request|ctx)\.(?:body|query|params|headers|cookies|url|originalUrl|baseUrl|path|querystring)\b"
    r"|(?:\bwindow\.)?\blocation\.(?:hash|search|href|pathname)\b"
    r"|\bdocument\.(?:URL|documentURI|referrer|cookie)\b|\bprocess\.(?:argv|env)\b|\bwindow\.name\b"
)
_WORDS = "[" + ", ".join(q(w) for w in T.JS_KEYWORDS) + "]"


def _names(text: str) -> str:
    return f"list_filter(list_distinct(regexp_extract_all({text}, {q(_IDENT)}, 1)), lambda w: NOT list_contains({_WORDS}, w))"


# title, severity, phase, group, RE2 pattern (group 1 is the match), veto on the text from the match on
_RE2 = [
    ("SQL string concatenation", "CRITICAL", 4, "sql", r"""(?i)((?:execute|query|raw|cursor\.execute)\s*\(\s*(?:f['"]|['"].*?['"]\s*[+%]|.*?\.format))""", ""),
    ("SQL f-string query", "CRITICAL", 4, "sql", r"""(?i)((?:execute|query)\s*\(\s*f['"].*(?:SELECT|INSERT|UPDATE|DELETE|WHERE))""", ""),
    ("Raw SQL with string format", "CRITICAL", 4, "sql", r"""(?i)(['"][^'"\n]*(?:SELECT|INSERT|UPDATE|DELETE)[^'"\n]*['"]\s*%\s*\()""", ""),
    ("SQL template literal", "CRITICAL", 4, "sql", r"""(?i)((?:query|execute)\s*\(\s*`[^`]*(?:(?:SELECT|INSERT|UPDATE|DELETE|FROM|WHERE)[^`]*\$\{|\$\{[^`]*(?:SELECT|INSERT|UPDATE|DELETE|FROM|WHERE)))""", ""),
    ("SQL raw() with dynamic input", "CRITICAL", 4, "sql", r"""(\.raw\s*\(\s*`[^`\n]*\$\{)""", ""),
    ("shell=True with dynamic command", "CRITICAL", 4, "cmd", r"""(?i)(subprocess\.\w+\(\s*(?:(?:f|rf|fr)['"]|[A-Za-z_][\w.\[\]]*\s*[,(]|(?:r|b|rb|br)?['"][^'"]*['"]\s*(?:[+%]|\.format\()).*?shell\s*=\s*True)""", ""),
    ("os.system() call", "CRITICAL", 4, "cmd", r"""(os\.system\s*\()""", ""),
    ("eval() usage", "CRITICAL", 4, "cmd", _PREFIX + r"""(eval\s*\()""", ""),
    ("exec() with template literal", "CRITICAL", 4, "cmd", _PREFIX + r"""(exec(?:Sync)?\s*\(\s*`[^`]*\$\{)""", ""),
    ("exec() with string concatenation", "CRITICAL", 4, "cmd", _PREFIX + r"""(exec(?:Sync)?\s*\(\s*['"][^'"]*['"]\s*\+)""", ""),
    ("child_process exec with variable command", "CRITICAL", 4, "cmd", r"""(child_process\s*\.\s*exec(?:Sync)?\s*\(\s*[A-Za-z_$])""", ""),
    ("child_process exec (member call)", "CRITICAL", 4, "cmd", _PREFIX + r"""((?:[A-Za-z_$][\w$]*\s*\.\s*)?exec(?:Sync)?\s*\(\s*(?:[^,;()\[\]\n]|\([^)\n]*\)|\[[^\]\n]*\])+,\s*(?:function\b|\([^)\n]*\)\s*=>|\{|[A-Za-z_$]))""", r"""^(?:[A-Za-z_$][\w$]*\s*\.\s*)?exec(?:Sync)?\s*\(['"][^'"\n]*['"]\s*,"""),
    ("spawn() with shell:true", "CRITICAL", 4, "cmd", r"""(?i)(\bspawn(?:Sync)?\s*\([^)]*shell\s*:\s*true)""", ""),
    ("Function constructor with dynamic code", "CRITICAL", 4, "cmd", r"""(\bnew\s+Function\s*\()""", r"""^new\s+Function\s*\(\s*(?:['"][^'"\n]*['"]\s*,?\s*)*\)"""),
    ("vm.runInContext with dynamic code", "CRITICAL", 4, "cmd", r"""(\bvm\.runIn(?:New|This)?Context\s*\()""", r"""^vm\.runIn(?:New|This)?Context\s*\((?:"[^"$\n]*"|'[^'$\n]*')\s*[),]"""),
    ("shell=True with constant command", "LOW", 1, "cmd_const", r"""(?i)(subprocess\.\w+\(\s*(?:r|b|rb|br)?['"][^'"]*['"]\s*,.*?shell\s*=\s*True)""", ""),
    ("innerHTML assignment", "HIGH", 4, "xss", r"""(\.innerHTML\s*\+?=)(?:[^=]|$)""", r"""^\.innerHTML\s*\+?=\s*""" + _CONST + r"""\s*;?\s*$"""),
    ("outerHTML assignment", "HIGH", 4, "xss", r"""(\.outerHTML\s*\+?=)(?:[^=]|$)""", r"""^\.outerHTML\s*\+?=\s*""" + _CONST + r"""\s*;?\s*$"""),
    ("document.write()", "HIGH", 4, "xss", r"""(document\.write(?:ln)?\s*\()""", r"""^document\.write(?:ln)?\s*\(\s*""" + _CONST + r"""\s*[),]"""),
    ("insertAdjacentHTML with dynamic content", "HIGH", 4, "xss", r"""(\.insertAdjacentHTML\s*\(\s*['"][^'"\n]*['"]\s*,)""", r"""^\.insertAdjacentHTML\s*\(\s*['"][^'"\n]*['"]\s*,\s*""" + _CONST + r"""\s*\)"""),
    ("dangerouslySetInnerHTML with dynamic content", "HIGH", 4, "xss", r"""(dangerouslySetInnerHTML\s*=\s*\{\s*\{\s*__html\s*:)""", r"""^dangerouslySetInnerHTML\s*=\s*\{\s*\{\s*__html\s*:\s*""" + _CONST + r"""\s*\}"""),
    ("jQuery .html() with dynamic content", "HIGH", 4, "xss", r"""(\.html\s*\(\s*(?:[A-Za-z_$][\w.$]*\s*[+)]|['"][^'"\n]*['"]\s*\+))""", ""),
    ("Unescaped template output", "HIGH", 4, "xss", r"""(\{\{\{.*?\}\}\}|<%[-=].*?%>|\{%\s*autoescape\s+false)""", ""),
]

_PY_SUFFIXED = "t IN (6, 7, 8, 9, 10)"
_COMMENT = q(r"^\s*(?:#|//|\*|/\*)")


def code_ctes() -> str:
    """files, their lines, and which of them the lexical rules read."""
    return f"""WITH RECURSIVE files AS ({corpus.files_sql()}),
cut AS (SELECT *, string_split(CASE WHEN content LIKE '%' || chr(10) THEN content[:-2] ELSE content END, chr(10)) AS ls FROM files),
code AS (SELECT *, {_PY_SUFFIXED} AS py,
  NOT ({_PY_SUFFIXED}) AND t = 3 AS bundle,
  NOT ({_PY_SUFFIXED}) AND (t = 3 OR list_max(list_transform(ls, lambda s: length(s))) > 2000) AS minified
  FROM cut WHERE t <> 11),
lines AS (SELECT * EXCLUDE (ls), ls[line] AS text,
  array_to_string(list_slice(ls, greatest(line - 1, 1), line + 1), chr(10)) AS snippet
  FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS line FROM code))"""


def env_ctes() -> str:
    """Definitions, then taint as reachability over strictly earlier lines, then the constants."""
    destruct = q(r"^\s*(?:const|let|var)\s*[{\[]\s*([^}\]]*)[}\]]\s*=\s*(\S.*)$")
    decl = q(r"^\s*(?:const|let|var)\s+([A-Za-z_$][\w$]*)(?:\s*:\s*[^=\n]+?)?\s*=\s*(\S.*)$")
    again = q(r"^\s*([A-Za-z_$][\w$]*)\s*\+?=(?:\s+(\S.*)|([^=\s].*))$")
    bound = f"list_filter(list_transform(string_split(regexp_extract(text, {destruct}, 1), ','), lambda p: regexp_extract_all(string_split(p, '=')[1], {q(_IDENT)}, 1)[-1]), lambda n: n IS NOT NULL)"
    const_rhs = q(r"^(?:" + _CONST + r"|\d+(?:\.\d+)?|true|false|null|undefined)\s*;?\s*$")
    return f"""defs AS (SELECT *, regexp_matches(rhs, {q(_SOURCE)}) AS src, regexp_matches(rhs, {const_rhs}) AS is_const, {_names('rhs')} AS uses FROM (
  SELECT repo, path, line,
    CASE WHEN regexp_matches(text, {destruct}) THEN {bound}
         WHEN regexp_matches(text, {decl}) THEN [regexp_extract(text, {decl}, 1)]
         WHEN regexp_matches(text, {again}) THEN [regexp_extract(text, {again}, 1)] ELSE [] END AS names,
    CASE WHEN regexp_matches(text, {destruct}) THEN regexp_extract(text, {destruct}, 2)
         WHEN regexp_matches(text, {decl}) THEN regexp_extract(text, {decl}, 2)
         ELSE regexp_extract(text, {again}, 2) || regexp_extract(text, {again}, 3) END AS rhs
  FROM lines WHERE NOT py) WHERE len(names) > 0),
named AS (SELECT repo, path, line, unnest(names) AS name, is_const, src FROM defs),
used AS (SELECT repo, path, line, unnest(uses) AS name FROM defs),
taint(repo, path, line, name) AS (
  SELECT repo, path, line, name FROM named WHERE src
  UNION
  SELECT n.repo, n.path, n.line, n.name FROM taint t JOIN used u ON u.path = t.path AND u.repo = t.repo AND u.name = t.name AND u.line > t.line
    JOIN named n ON n.path = u.path AND n.repo = u.repo AND n.line = u.line),
tainted AS (SELECT repo, path, list(DISTINCT name) AS tainted FROM taint GROUP BY ALL),
constants AS (SELECT repo, path, list(name) AS constants FROM (
  SELECT repo, path, name FROM named GROUP BY ALL HAVING bool_and(is_const)) c
  WHERE NOT EXISTS (SELECT 1 FROM taint t WHERE t.repo = c.repo AND t.path = c.path AND t.name = c.name) GROUP BY ALL),
env AS (SELECT f.repo, f.path, coalesce(tainted, []) AS tainted, coalesce(constants, []) AS constants
  FROM code f LEFT JOIN tainted t ON t.repo = f.repo AND t.path = f.path LEFT JOIN constants c ON c.repo = f.repo AND c.path = f.path)"""


def verdict_sql(text: str) -> str:
    return (
        f"CASE WHEN regexp_matches({text}, {q(_SOURCE)}) OR list_has_any({_names(text)}, tainted) THEN true "
        f"WHEN len({_names(text)}) > 0 AND list_has_all(constants, {_names(text)}) THEN false END"
    )


def pattern_hits_sql(groups) -> str:
    parts = []
    for title, severity, phase, group, rx, veto in _RE2:
        if group not in groups:
            continue
        scope = "(py OR NOT bundle)" if group == "xss" else "(t = 10 OR (NOT py AND NOT bundle))"
        no_veto = f" AND NOT regexp_matches(substr(text, strpos(text, m)), {q(veto)})" if veto else ""
        parts.append(
            f"SELECT repo, path, py, line, text, snippet, {q(title)} AS title, '{severity}' AS severity, {phase} AS fix_phase, "
            f"'{group}' AS grp, substr(text, strpos(text, m)) AS tail FROM (SELECT *, regexp_extract(text, {q(rx)}, 1) AS m FROM lines "
            f"WHERE {scope} AND NOT regexp_matches(text, {_COMMENT})) WHERE m <> ''{no_veto}"
        )
    return " UNION ALL ".join(parts)


# template number -> (line in the template, title, severity, phase, reachable)
_PY_FINDINGS = {
    6: [
        (5, "os.system() call", "CRITICAL", 4, "true"),
        (13, "eval() usage", "CRITICAL", 4, "true"),
        (15, "exec() usage", "CRITICAL", 4, "true"),
        (16, "os.system() with constant command", "LOW", 1, "false"),
        (17, "os.system() call", "CRITICAL", 4, "false"),
        (18, "shell=True with constant command", "LOW", 1, "false"),
        (19, "shell=True with dynamic command", "CRITICAL", 4, "true"),
        (21, "SQL f-string query", "CRITICAL", 4, "true"),
        (22, "SQL string concatenation", "CRITICAL", 4, "NULL"),
        (23, "SQL string concatenation", "CRITICAL", 4, "false"),
        (24, "SQL string concatenation", "CRITICAL", 4, "true"),
    ],
    7: [
        (5, "Path traversal", "HIGH", 4, "true"),
        (6, "Server-side request forgery (SSRF)", "HIGH", 4, "true"),
        (10, "Path traversal", "HIGH", 4, "true"),
        (11, "Server-side request forgery (SSRF)", "HIGH", 4, "true"),
        (12, "Server-side request forgery (SSRF)", "HIGH", 4, "true"),
        (13, "Server-side request forgery (SSRF)", "HIGH", 4, "true"),
        (15, "Insecure deserialization", "HIGH", 4, "true"),
        (17, "Insecure deserialization", "HIGH", 4, "NULL"),
        (19, "Open redirect", "HIGH", 4, "true"),
    ],
}


def py_values() -> str:
    rows = [
        f"({t}, {i}, {q(title)}, '{severity}', {phase}, CAST({reach} AS BOOLEAN))"
        for t, found in _PY_FINDINGS.items()
        for i, title, severity, phase, reach in found
    ]
    return f"(VALUES {', '.join(rows)}) AS e(et, i, title, severity, fix_phase, reachable)"


_OUT = "repo, path AS file, CAST(line AS INTEGER) AS line, severity, title, CAST(fix_phase AS INTEGER) AS fix_phase, reachable, snippet"


def py_sql(titles=None) -> str:
    where = "" if titles is None else f" WHERE title IN ({', '.join(q(x) for x in titles)})"
    return f"SELECT l.repo, l.path, l.line, e.severity, e.title, e.fix_phase, e.reachable, l.snippet FROM lines l JOIN {py_values()} ON e.et = l.t AND l.line = l.k + e.i{where}"


def group_sql(groups, py_titles) -> str:
    return f"""{code_ctes()}, {env_ctes()}, hits AS ({pattern_hits_sql(groups)}),
judged AS (SELECT h.*, CASE WHEN NOT py THEN {verdict_sql('tail')} END AS reachable FROM hits h JOIN env e ON e.repo = h.repo AND e.path = h.path),
found AS (SELECT repo, path, line, severity, title, fix_phase, reachable, snippet FROM judged WHERE NOT (grp = 'xss' AND coalesce(reachable = false, false))
  UNION ALL {py_sql(py_titles)})
SELECT {_OUT} FROM found"""


_ARG = r"((?:[^,()\n]|\([^)\n]*\))+)"
_SINKS = {
    "js_nosql": ("NoSQL query with user-controlled value", "HIGH", r"\.(?:find|findOne(?:And\w+)?|deleteOne|deleteMany|updateOne|updateMany)\s*\(([^)\n]*)"),
    "js_query_ident": ("SQL query with user-controlled string", "CRITICAL", r"\.(?:query|execute)\s*\(\s*([A-Za-z_$][\w$]*)\s*[,)]"),
    "js_exec_ident": ("exec() with user-controlled command", "CRITICAL", r"(?:^|[^\w.])exec(?:Sync)?\s*\(\s*([A-Za-z_$][\w$]*)\s*[,)]"),
    "js_path": ("Path traversal", "HIGH", r"\.(?:readFile|readFileSync|createReadStream|writeFile|unlink|stat|open|sendFile|download)\s*\(\s*" + _ARG),
    "js_ssrf": ("Server-side request forgery (SSRF)", "HIGH", r"(?:(?:^|[^\w.$])(?:fetch|axios|got|superagent)|\b(?:axios|http|https|got|request|superagent|fetch)\.(?:get|post|put|patch|del|delete|head|request))\s*\(\s*" + _ARG),
    "js_deserialize": ("Insecure deserialization", "HIGH", r"\bunserialize\s*\(\s*([^,)\n]+)"),
    "js_redirect": ("Open redirect", "HIGH", r"(?:^|[^\w.])(?:res|response|reply|ctx)\s*\.\s*redirect\s*\(\s*([^)\n]+)"),
}


def sink_sql(name: str) -> str:
    title, severity, rx = _SINKS[name]
    arg = "a"
    reaches = f"regexp_matches({arg}, {q(_SOURCE)}) OR list_has_any({_names(arg)}, tainted)"
    extra = ""
    if name == "js_nosql":
        extra = f" AND NOT regexp_matches(a, {q(r'^\s*(?:function\b|[A-Za-z_$][\w$]*\s*=>)')})"
        stripped = f"regexp_replace(a, {q(r'[\w$]+\s*:')}, '', 'g')"
        reaches = reaches.replace(f"regexp_matches({arg},", f"regexp_matches({stripped},").replace(_names(arg), _names(stripped))
    if name in ("js_query_ident", "js_exec_ident"):
        reaches = "list_contains(tainted, a)"
    return f"""{code_ctes()}, {env_ctes()},
calls AS (SELECT *, unnest(regexp_extract_all(text, {q(rx)}, 1)) AS a FROM lines
  WHERE NOT py AND NOT bundle AND NOT regexp_matches(text, {_COMMENT})),
found AS (SELECT c.repo, c.path, line, '{severity}' AS severity, {q(title)} AS title, 4 AS fix_phase, true AS reachable, snippet
  FROM calls c JOIN env e ON e.repo = c.repo AND e.path = c.path WHERE ({reaches}){extra})
SELECT {_OUT} FROM found"""


_PY_STATES = {
    6: {"x": "true", "y": "false", "z": "true", "w": "NULL", "cmd": "true"},
    7: {"q": "true", "copy": "NULL", "p": "true", "u": "true", "token": "NULL"},
    8: {"app": "NULL", "api": "NULL", "password": "false", "cors_options": "false"},
    9: {"INSTALLED_APPS": "false", "password": "false", "SECRET": "true", "api_key": "false", "token": "false"},
}
# template -> parsed, functions, calls, assignments, from a source, constant
_PY_COUNTS = {
    6: ("true", 3, 20, 4, 1, 1),
    7: ("true", 1, 18, 3, 1, 0),
    8: ("true", 0, 2, 4, 0, 2),
    9: ("true", 0, 0, 5, 1, 4),
    10: ("false", 0, 0, 0, 0, 0),
}
_PY_EDGES = {
    2: [(6, "x", "cmd"), (7, "q", "p"), (7, "*", "u")],
    3: [(6, "*", "()get")],
}


def _by_template(columns: str, rows: list[str]) -> str:
    return f"WITH files AS ({corpus.files_sql()}) SELECT repo, path, {columns} FROM files JOIN (VALUES {', '.join(rows)}) AS e(et, {columns}) ON et = t"



_WEAK = f"""{code_ctes()}
SELECT repo, path AS file, CAST(line AS INTEGER) AS line, 'MEDIUM' AS severity, 'Weak randomness for security value' AS title,
  CAST(3 AS INTEGER) AS fix_phase, CAST(NULL AS BOOLEAN) AS reachable, snippet FROM lines
WHERE (py OR NOT bundle) AND NOT regexp_matches(text, {_COMMENT})
  AND regexp_matches(text, {q(r'\bMath\.random\s*\(|(?:^|[^\w.])random\.(?:random|randint|randrange|randbytes|choice|choices|getrandbits|uniform|sample|shuffle)\s*\(')})
  AND regexp_matches(text, {q(r'(?i)\b(?:token|secret|password|passwd|api[_-]?key|otp|csrf|nonce|salt)\w*')})"""

_PY_CMD = ["eval() usage", "exec() usage", "os.system() call", "os.system() with constant command", "shell=True with dynamic command"]


def _py_only(titles) -> str:
    """Findings of Python files: parsed ones by template, the unparsable one by pattern."""
    return f"SELECT * FROM ({group_sql(('sql', 'cmd', 'cmd_const'), titles)}) WHERE file LIKE '%.py' AND title IN ({', '.join(q(x) for x in titles)})"


ORACLES = {
    "inj_sql": group_sql(("sql",), ["SQL f-string query", "SQL string concatenation"]),
    "inj_cmd": group_sql(("cmd",), _PY_CMD),
    "inj_cmd_const": group_sql(("cmd_const",), ["shell=True with constant command"]),
    "inj_xss": group_sql(("xss",), ["-"]),
    "inj_weak_random": _WEAK,
    "inj_skipped": f"{code_ctes()} SELECT repo, path, 'generated bundle' AS reason FROM code WHERE bundle",
    "inj_minified": f"{code_ctes()} SELECT repo, path, minified FROM code WHERE NOT py",
    "js_sources": f"{code_ctes()} SELECT repo, path, CAST(line AS INTEGER) AS line, text FROM lines WHERE NOT py AND regexp_matches(text, {q(_SOURCE)})",
    "js_defs": f"{code_ctes()}, {env_ctes()} SELECT repo, path, CAST(line AS INTEGER) AS line, array_to_string(names, ',') AS names, src, is_const FROM defs",
    "js_uses": f"{code_ctes()}, {env_ctes()} SELECT repo, path, CAST(line AS INTEGER) AS line, name FROM used",
    "js_env": f"{code_ctes()}, {env_ctes()}, all_names AS (SELECT DISTINCT repo, path, name FROM named) SELECT n.repo, n.path, name, CASE WHEN list_contains(tainted, name) THEN true WHEN list_contains(constants, name) THEN false END AS state FROM all_names n JOIN env e ON e.repo = n.repo AND e.path = n.path",
    "js_reachable": f"{code_ctes()}, {env_ctes()} SELECT l.repo, l.path, CAST(line AS INTEGER) AS line, {verdict_sql('text')} AS reachable FROM lines l JOIN env e ON e.repo = l.repo AND e.path = l.path WHERE NOT py AND contains(text, '(')",
    "js_xss_const_drop": f"SELECT repo, file, title, count(*) AS kept, count(*) FILTER (WHERE reachable = false) AS constant FROM ({group_sql(('xss',), ['-'])}) GROUP BY ALL",
    **{name: sink_sql(name) for name in _SINKS},
    "py_facts": _by_template(
        "parsed, functions, calls, assigns, source_assigns, constant_assigns",
        [f"({t}, {', '.join(f'CAST({v} AS INTEGER)' if i else str(v) for i, v in enumerate(values))})" for t, values in _PY_COUNTS.items()],
    ),
    "py_env": _by_template("name, state", [f"({t}, {q(n)}, CAST({s} AS BOOLEAN))" for t, names in _PY_STATES.items() for n, s in names.items()]),
    "py_xfn_param": _by_template("src, dst", [f"({t}, {q(a)}, {q(b)})" for t, a, b in _PY_EDGES[2]]),
    "py_xfn_return": _by_template("src, dst", [f"({t}, {q(a)}, {q(b)})" for t, a, b in _PY_EDGES[3]]),
    "py_eval_exec": _py_only(["eval() usage", "exec() usage"]),
    "py_os_system": _py_only(["os.system() call", "os.system() with constant command"]),
    "py_shell_true": _py_only(["shell=True with dynamic command", "shell=True with constant command"]),
    "py_sql": _py_only(["SQL f-string query", "SQL string concatenation"]),
    **{
        name: f"{code_ctes()} SELECT {_OUT} FROM ({py_sql([title])})"
        for name, title in {
            "py_path": "Path traversal",
            "py_ssrf": "Server-side request forgery (SSRF)",
            "py_deserialize": "Insecure deserialization",
            "py_redirect": "Open redirect",
        }.items()
    },
    "py_reachable": f"""SELECT repo, file, count(*) FILTER (WHERE reachable) AS reached, count(*) FILTER (WHERE NOT reachable) AS constant,
  count(*) FILTER (WHERE reachable IS NULL) AS unknown
  FROM (SELECT repo, file, reachable FROM ({group_sql(('sql', 'cmd', 'cmd_const', 'xss'), [t for f in _PY_FINDINGS.values() for _, t, _, _, _ in f])}) WHERE file LIKE '%.py'
        UNION ALL SELECT repo, file, reachable FROM ({_WEAK}) WHERE file LIKE '%.py') GROUP BY ALL""",
}
