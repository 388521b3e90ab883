"""Tables derived from the given ones, so that every query's work grows with them.

A derived table exists twice: as a DataFrame and as the text of a DuckDB query. Both are made from
the same template texts, and nothing else is shared between the two sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codewarden.functions.sizes import spread_rows

# (suffix, how the document's text joins the code, code). In the code, @HEX@ and @HEXU@ stand for
# the digest of the document's number, and @ID@ for the number.
#   raw: code, then the text as it is        comment: the text as comment lines, then the code
TEMPLATES: list[tuple[str, str, str]] = [
    (
        ".js",
        "raw",
        """const q = req.query.id;
db.query("SELECT * FROM t WHERE id = " + q);
db.query(`SELECT * FROM t WHERE id = ${q}`);
db.query("SELECT 1", [q]);
knex.raw(`select ${q}`);
const out = "DELETE FROM t WHERE n = %s" % (q);
eval(q);
model.eval(q);
exec(`ping ${q}`);
exec("ping " + q, cb);
exec("ls", cb);
child_process.exec(cmd);
cp.exec(cmd, function () {});
re.exec(text);
spawn("sh", [q], { shell: true });
new Function("a", "return a");
new Function(q);
vm.runInNewContext("1 + 1");
vm.runInNewContext(q);
os.system(q);
subprocess.run(cmd, shell=True);
subprocess.run("ls", shell=True);
// eval(q)
eval(q); // codewarden: ignore
eval(code); // codewarden: ignore[secrets]
eval(code); // codewarden: ignore[injection/eval_usage]""",
    ),
    (
        ".jsx",
        "raw",
        """const safe = "<b>ok</b>";
const raw = location.hash;
const other = load();
el.innerHTML = "<p>static</p>";
el.innerHTML = raw;
el.innerHTML = safe;
el.innerHTML = other;
el.innerHTML += raw + safe;
el.outerHTML = other;
document.write("<p>x</p>");
document.write(raw);
document.writeln(other);
node.insertAdjacentHTML("beforeend", "<i>x</i>");
node.insertAdjacentHTML("beforeend", raw);
<div dangerouslySetInnerHTML={{ __html: raw }} />
<div dangerouslySetInnerHTML={{ __html: "<b></b>" }} />
$("#a").html(raw);
$("#a").html();
$("#a").html("x" + other);
<p>{{{ raw }}}</p>
<%- other %>
if (el.innerHTML == raw) {}
/* el.innerHTML = raw */
let weak = "token" + Math.random();
const csrfToken = Math.random().toString(36);
const r = Math.random();""",
    ),
    (
        ".ts",
        "raw",
        """const { name, role: kind = "x", ...rest } = req.body;
let a = name;
let b = a + 1;
let late = later;
let later = req.query.l;
var k = 1;
k = name;
let n = 5;
const m: string = process.env.HOME;
users.find({ name: b });
users.find(x => x.id);
users.findOne({ name: n });
db.query(b, cb);
db.query(n);
exec(later);
fs.readFile(path.join(root, req.query.f), cb);
fs.readFileSync("config.json");
res.download(kind);
fetch(rest);
axios.get(m, opts);
cache.get(b);
serialize.unserialize(k);
res.redirect(301, b);
res.redirect("/home");
fetch(late);""",
    ),
    (
        ".min.js",
        "raw",
        """const q = req.query.id;
eval(q);
el.innerHTML = q;
const api_key = "@HEX@";""",
    ),
    (
        ".mjs",
        "raw",
        """import express from 'express';
const app = express();
app.use(cors());
app.use(session({ store: x }));
req.session.user = 1;""",
    ),
    (
        ".cjs",
        "raw",
        """const express = require("express");
const helmet = require("helmet");
const csrf = require("csurf");
res.setHeader("Access-Control-Allow-Origin", "*");""",
    ),
    (
        ".py",
        "comment",
        """import os, subprocess
x = request.args.get("x")
y = "const"
def run(cmd):
    os.system(cmd)
def get():
    return input()
def keep(v):
    return v
run(x)
z = get()
w = keep(y)
eval(x)
eval("1 + 1")
exec(z)
os.system("ls")
os.system(y)
subprocess.run("ls", shell=True)
subprocess.run(z, shell=True)
subprocess.run(["ls", x], shell=False)
db.execute(f"SELECT {x}")
db.execute("SELECT " + w)
db.execute("SELECT %s" % y)
db.execute("SELECT {}".format(z))
db.execute("SELECT 1", (x,))""",
    ),
    (
        ".py",
        "comment",
        """import pickle, yaml, requests
q = os.environ["Q"]
copy = q
def handler(p, u):
    open(p)
    requests.get(u)
handler(q, "http://a")
handler("a", sys.argv[1])
open("config.json")
send_from_directory("d", q)
requests.get(q)
session.http.post(q)
urlopen(q)
cache.get(q)
pickle.loads(q)
pickle.loads(b"x")
yaml.load(f)
yaml.load(f, Loader=yaml.SafeLoader)
redirect(q)
redirect("/home")
open(copy)
token = random.choice(pool)""",
    ),
    (
        ".py",
        "comment",
        """from flask import Flask, render_template
from fastapi import FastAPI
app = Flask(__name__)
api = FastAPI()
password = "hunter@ID@secret"
cors_options = "origin: '*'" """.rstrip(),
    ),
    (
        ".py",
        "comment",
        """INSTALLED_APPS = [
    "django.contrib.admin",
]
password = "changeme123"
SECRET = os.environ["APP_SECRET"]
api_key = "your_api_key_goes_here_0"
# token = "@HEX@"
token = "@HEX@" """.rstrip(),
    ),
    (
        ".py",
        "comment",
        """print "old syntax"
os.system(cmd)
eval(code)
subprocess.run("ls", shell=True)
cursor.execute("SELECT * FROM t WHERE a = '%s'" % name)
cursor.execute(f"SELECT {name} FROM t")""",
    ),
    (
        ".yml",
        "raw",
        """aws_access_key_id: AKIA@HEXU@
url: postgres://app:p@HEX@@db.internal/app
api_key: "@HEX@"
password: "pw-@ID@-long"
example: "api_key = 'your-key-your-key-your-key'"
one: AIza@HEX@abc
two: ghp_@HEX@abcd
three: glpat-@HEX@
four: sk-ant-@HEX@
five: sk-@HEX@
six: xoxb-@HEX@
seven: npm_@HEX@abcd
eight: pypi-@HEX@@HEX@
nine: sk_live_@HEX@
ten: -----BEGIN RSA PRIVATE"""
        + """ KEY-----
eleven: AIzayour-placeholder-key-of-35-letters-long
twelve: ghp_exampleexampleexampleexampleexample1
key = os.getenv("KEY") or "AKIA@HEXU@"
secret = getenv("SECRET") or "x"
password = "process.env.DB_PASSWORD"
""",
    ),
]
N = len(TEMPLATES)


def table(spark: SparkSession, sf: str, name: str, *keys: str) -> DataFrame:
    """A given table, spread by its row key while it is too small to fill the cores, or has too many rows a partition."""
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return spread_rows(df, *keys) if keys else df


def template_no(column: str = "doc_id") -> str:
    """SQL text, good on both sides: the number of the row's template."""
    return f"{column} % {N}"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# --- files, from documents ----------------------------------------------------------------------


def _code(digest: Column, number: Column) -> Column:
    out = F
    for i, (_, _, code) in enumerate(TEMPLATES):
        out = out.when(F.col("t") == i, F.lit(code))
    code = out.otherwise(F.lit(""))
    code = F.replace(code, F.lit("@HEXU@"), F.upper(F.substring(digest, 1, 16)))
    code = F.replace(code, F.lit("@HEX@"), digest)
    return F.replace(code, F.lit("@ID@"), number.cast("string"))


def files_of(documents: DataFrame) -> DataFrame:
    """``files`` rows of documents: the code of a template and the document's whole text."""
    t = documents.withColumn("t", F.expr(template_no()))
    raw = [i for i, x in enumerate(TEMPLATES) if x[1] == "raw"]
    suffix = F
    for i, (name, _, _) in enumerate(TEMPLATES):
        suffix = suffix.when(F.col("t") == i, F.lit(name))
    code = _code(F.md5(F.col("doc_id").cast("string")), F.col("doc_id"))
    commented = F.concat(F.lit("# "), F.replace("text", F.lit("\n"), F.lit("\n# ")))
    return t.select(
        F.col("source").alias("repo"),
        F.concat(F.lit("src/f"), F.col("doc_id").cast("string"), suffix).alias("path"),
        F.col("doc_id").alias("file_seq"),
        F.when(F.col("t").isin(*raw), F.concat(code, F.lit("\n"), "text"))
        .otherwise(F.concat(commented, F.lit("\n"), code))
        .alias("content"),
    )


def files(spark: SparkSession, sf: str) -> DataFrame:
    return files_of(table(spark, sf, "documents", "doc_id").select("doc_id", "source", "text"))


def files_sql() -> str:
    """DuckDB text of the same table, with the template number ``t`` and comment-line count ``k``."""
    code = "CASE " + " ".join(f"WHEN t = {i} THEN {quoted(c)}" for i, (_, _, c) in enumerate(TEMPLATES)) + " END"
    digest = "md5(CAST(doc_id AS VARCHAR))"
    code = f"replace({code}, '@HEXU@', upper(substr({digest}, 1, 16)))"
    code = f"replace(replace({code}, '@HEX@', {digest}), '@ID@', CAST(doc_id AS VARCHAR))"
    suffix = "CASE " + " ".join(f"WHEN t = {i} THEN '{s}'" for i, (s, _, _) in enumerate(TEMPLATES)) + " END"
    raw = ", ".join(str(i) for i, x in enumerate(TEMPLATES) if x[1] == "raw")
    return f"""SELECT source AS repo, 'src/f' || CAST(doc_id AS VARCHAR) || {suffix} AS path, doc_id AS file_seq, t,
  CASE WHEN t IN ({raw}) THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + 1 END AS k,
  CASE WHEN t IN ({raw}) THEN {code} || chr(10) || text
       ELSE '# ' || replace(text, chr(10), chr(10) || '# ') || chr(10) || {code} END AS content
  FROM (SELECT *, {template_no()} AS t FROM documents)"""


# --- a file tree, from lineitem and supplier ------------------------------------------------------

DIRS = ["src", "node_modules/lib", "env", "dist", "a/b", "tests/fixtures", "venv/x"]
NAMES = ["app", ".env", "Dockerfile", "docker-compose", "README", "lib.min", "keep"]
EXTS = [".py", ".JS", ".txt", ".tsx", "", ".d.ts", ".log", ".toml"]
GITIGNORES = ["*.py\n!keep.py\n/env\n", "# comment\n\na/b/\n**/fixtures/*.toml\n", "docker*\n[kl]*.tsx\n!src/**\n"]


def _pick(values: list[str], index: str) -> str:
    return "CASE " + " ".join(f"WHEN {index} = {i} THEN {quoted(v)}" for i, v in enumerate(values)) + " END"


def tree_sql(columns: str = "repo, path, file_seq") -> str:
    path = f"{_pick(DIRS, 'l_linenumber - 1')} || '/' || {_pick(NAMES, 'l_partkey % 7')} || {_pick(EXTS, 'l_orderkey % 8')}"
    return (
        f"SELECT {columns} FROM (SELECT 's' || CAST(l_suppkey AS VARCHAR) AS repo, {path} AS path, "
        f"l_orderkey * 8 + l_linenumber AS file_seq, l_suppkey % 3 AS g FROM lineitem)"
    )


def tree(spark: SparkSession, sf: str) -> DataFrame:
    """Paths of many repositories (no contents) and each repository's .gitignore."""

    def pick(values, index):
        return F.element_at(F.array(*[F.lit(v) for v in values]), F.expr(index).cast("int") + 1)

    lines = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    rows = lines.select(
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("repo"),
        F.concat(
            pick(DIRS, "l_linenumber - 1"), F.lit("/"), pick(NAMES, "l_partkey % 7"), pick(EXTS, "l_orderkey % 8")
        ).alias("path"),
        F.expr("l_orderkey * 8 + l_linenumber").alias("file_seq"),
        F.lit("").alias("content"),
    )
    ignores = spark.read.parquet(f"{sf}/supplier.parquet").select(
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("repo"),
        F.lit(".gitignore").alias("path"),
        F.lit(0).cast("bigint").alias("file_seq"),
        pick(GITIGNORES, "s_suppkey % 3").alias("content"),
    )
    return rows.unionByName(ignores)


# --- findings, from lineitem ----------------------------------------------------------------------

TITLES = ["eval() usage", "Path traversal", "AWS Access Key Detected", "--", "js/sql-injection", "innerHTML assignment"]
SCANNERS = ["injection", "injection", "secrets", "deps", "semgrep", "injection"]


def findings(spark: SparkSession, sf: str) -> DataFrame:
    """Synthetic findings: one per line item, with many exact copies and every severity."""
    from codewarden.schemas import as_findings, emit_seq

    def pick(values, index):
        return F.element_at(F.array(*[F.lit(v) for v in values]), F.expr(index).cast("int") + 1)

    lines = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_shipdate"
    )
    kind = "l_partkey % 6"
    severity = F.expr(
        "CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'CRITICAL' WHEN l_returnflag = 'A' THEN 'HIGH' "
        "WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN 'MEDIUM' WHEN l_returnflag = 'N' THEN 'INFO' ELSE 'LOW' END"
    )
    seq = "l_orderkey * 8 + l_linenumber"
    return as_findings(
        lines.select(
            F.concat(F.lit("r"), F.expr("cast(l_suppkey % 20 as string)")).alias("repo"),
            F.concat(F.lit("/work/r/src/m"), F.expr("cast(l_partkey % 50 as string)"), F.lit(".py")).alias("file"),
            F.col("l_linenumber").alias("line"),
            severity.alias("severity"),
            pick(TITLES, kind).alias("title"),
            F.concat(F.lit("seen at "), F.col("l_quantity").cast("int").cast("string")).alias("description"),
            pick(SCANNERS, kind).alias("scanner"),
            F.when(F.expr("l_orderkey % 5 = 0"), F.lit("")).otherwise(
                F.concat(F.lit("  code "), F.expr("cast(l_partkey % 7 as string)"), F.lit(" \t"))
            ).alias("snippet"),
            F.expr("cast(l_orderkey % 5 + 1 as int)").alias("fix_phase"),
            F.lit("Fix it.").alias("fix_summary"),
            F.when(F.expr("l_orderkey % 3 = 0"), F.array(F.lit("https://e.example/1"))).otherwise(F.array().cast("array<string>")).alias("references"),
            F.expr("CASE WHEN l_orderkey % 4 = 0 THEN true WHEN l_orderkey % 4 = 1 THEN false END").alias("reachable"),
            F.expr("l_orderkey % 11 = 0").alias("project_level"),
            F.when(F.expr("l_orderkey % 7 != 0"), F.concat(F.lit("\t line "), F.expr("cast(l_partkey % 9 as string)"), F.lit(" "))).alias("line_text"),
            emit_seq(F.expr("cast(l_partkey % 3 as int)"), F.expr(seq), 0, F.col("l_partkey"), F.col("l_suppkey"), F.expr("cast(round(l_extendedprice * 100) as bigint)")).alias("emit_seq"),
        )
    )


def findings_sql() -> str:
    kind = "l_partkey % 6"
    return f"""SELECT 'r' || CAST(l_suppkey % 20 AS VARCHAR) AS repo,
  '/work/r/src/m' || CAST(l_partkey % 50 AS VARCHAR) || '.py' AS file, l_linenumber AS line,
  CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'CRITICAL' WHEN l_returnflag = 'A' THEN 'HIGH'
       WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN 'MEDIUM' WHEN l_returnflag = 'N' THEN 'INFO' ELSE 'LOW' END AS severity,
  CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 0 WHEN l_returnflag = 'A' THEN 1
       WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN 2 WHEN l_returnflag = 'N' THEN 4 ELSE 3 END AS srank,
  {_pick(TITLES, kind)} AS title, 'seen at ' || CAST(CAST(floor(l_quantity) AS INTEGER) AS VARCHAR) AS description,
  {_pick(SCANNERS, kind)} AS scanner,
  CASE WHEN l_orderkey % 5 = 0 THEN '' ELSE '  code ' || CAST(l_partkey % 7 AS VARCHAR) || ' ' || chr(9) END AS snippet,
  CAST(l_orderkey % 5 + 1 AS INTEGER) AS fix_phase, 'Fix it.' AS fix_summary, l_orderkey % 3 = 0 AS has_ref,
  CASE WHEN l_orderkey % 4 = 0 THEN true WHEN l_orderkey % 4 = 1 THEN false END AS reachable,
  l_orderkey % 11 = 0 AS project_level,
  CASE WHEN l_orderkey % 7 != 0 THEN chr(9) || ' line ' || CAST(l_partkey % 9 AS VARCHAR) || ' ' END AS line_text,
  l_partkey % 3 AS e1, l_orderkey * 8 + l_linenumber AS e2, l_partkey AS e3, l_suppkey AS e4,
  CAST(round(l_extendedprice * 100) AS BIGINT) AS e5
  FROM lineitem"""


def finding_id_sql(scanner: str = "scanner", title: str = "title") -> str:
    slug = f"trim(regexp_replace(lower({title}), '[^a-z0-9]+', '_', 'g'), '_')"
    return f"({scanner} || '/' || CASE WHEN {slug} = '' THEN 'finding' ELSE {slug} END)"
