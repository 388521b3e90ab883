"""The whole scan: selection, options, suppression, copies, diffs, user rules and scanners."""

import pytest
from pyspark.sql import functions as F

from codewarden.operators import baseline, custom, post, report, select
from codewarden.plans import scan as plan
from codewarden.sources import files as tree
from codewarden.sources import patches, reports, rules

KEY = "AKIA" + "Q" * 16


def titles(df):
    return sorted((r.file, r.line, r.title) for r in df.collect())


def test_selection(files_of):
    kept = ["app.py", ".env", ".env.local", "Dockerfile", "docker-compose.override", "env/x.py", "sub/a.TF"]
    dropped = ["Makefile", "node_modules/a.js", "a/dist/b.js", "gen/x.js", "api.gen.js", "img.png", "vendor/a.py"]
    files = files_of({**{p: "" for p in kept + dropped}, ".gitignore": "gen/\n*.gen.js\n"})
    got = {r.path for r in select.collect(files, ["vendor"]).collect()}
    assert got == set(kept)


def test_gitignore_belongs_to_its_repository(files_of):
    files = files_of([("a", ".gitignore", "*.py\n!keep.py\n"), ("a", "x.py", ""), ("a", "d/keep.py", ""), ("b", "x.py", "")])
    assert {(r.repo, r.path) for r in select.collect(files).collect()} == {("a", "d/keep.py"), ("b", "x.py")}


@pytest.mark.parametrize(
    "pattern, path, matched",
    [("a/b", "x/a/b", False), ("/a", "a/b", True), ("a/**/b", "a/x/y/b", True), ("**/a", "x/a/b", True), ("a/", "a", False),
     ("a/", "x/a/b", True), ("*.py[co]", "x.pyc", True), ("[!a].c", "a.c", False), ("a?c", "a/c", False), ("\\#x", "#x", True)],
)
def test_gitignore_patterns(pattern, path, matched):
    import re

    assert bool(re.match(select.gitignore_line(pattern)[0], path)) is matched


def test_exclude_patterns(spark):
    regex = select.exclude_regex(["tests\\fixtures/", "*.min.js", "  "])
    rows = spark.createDataFrame([("tests/fixtures/a.py",), ("a/b.min.js",), ("tests/fixtures2/a.py",)], "path string")
    assert [r.x for r in rows.select(F.col("path").rlike(regex).alias("x")).collect()] == [True, True, False]


def test_scan_end_to_end(files_of):
    files = files_of(
        {
            "app.py": f'import flask\napp = Flask(__name__)\nk = "{KEY}"\neval(x)\neval(y)  # codewarden: ignore\nsession["a"] = 1\n',
            "safe.py": "import os\nkey = os.environ['K']\n# token = 'abcdefghijklmnopqrstuvwx'\n",
            "dist/x.js": "eval(x)\n",
        }
    )
    found = plan.scan(files)
    assert titles(found) == [
        ("app.py", 1, "No CSRF protection detected"),
        ("app.py", 2, "Flask app without security headers"),
        ("app.py", 3, "AWS Access Key Detected"),
        ("app.py", 4, "eval() usage"),
    ]
    order = [r.title for r in post.sort(found).collect()]
    assert order[:2] == ["eval() usage", "AWS Access Key Detected"]
    assert post.exit_code(found, "critical").first().exit_code == 1
    assert post.exit_code(found, "never").first().exit_code == 0


def test_baseline_survives_moved_lines_but_not_edits(files_of, spark, tmp_path):
    before = plan.scan(files_of({"a.py": "eval(x)\nexec(y)\n"}))
    path = str(tmp_path / "base")
    baseline.write(before, path)
    known = baseline.read(spark, path)
    moved = plan.scan(files_of({"a.py": "\n\nif a:\n  eval(x)\nexec(other)\n"}), known=known)
    assert titles(moved) == [("a.py", 5, "exec() usage")]


def test_malformed_baseline_is_an_error(spark, tmp_path):
    (tmp_path / "base.json").write_text('{"repo": "r", "id": "a/b", "file": "x"}\n')
    with pytest.raises(Exception, match="malformed entry"):
        baseline.read(spark, str(tmp_path / "base.json")).collect()


def test_diff_scan_keeps_changed_lines(files_of, spark):
    files = files_of({"a.py": "eval(a)\neval(b)\neval(c)\n", "b.py": "eval(d)\n", "new.py": "eval(e)\n", "gone.py": "eval(f)\n"})
    diff = "+++ b/a.py\n@@ -1,0 +2 @@\n+eval(b)\n+++ b/gone.py\n@@ -3,2 +2,0 @@\n-x\n-y"
    rows = spark.createDataFrame([("r", i, line) for i, line in enumerate(diff.split("\n"))], "repo string, pos bigint, raw string")
    untracked = spark.createDataFrame([("r", "new.py")], "repo string, path string")
    changed = patches.changed_lines(rows, untracked)
    got = titles(plan.scan_diff(files, changed))
    assert got == [("a.py", 2, "eval() usage"), ("gone.py", 1, "eval() usage"), ("new.py", 1, "eval() usage")]


def test_engine_findings_yield_to_native_ones(files_of, spark):
    files = files_of({"a.py": "eval(a)\nother()  # codewarden: ignore\nthird()\n"})
    doc = '{"results": [%s]}' % ", ".join(
        '{"check_id": "x.rule", "path": "a.py", "start": {"line": %d}, "extra": {}}' % n for n in (1, 2, 3, 9)
    )
    report_rows = spark.createDataFrame([("r", 0, doc)], "repo string, doc bigint, json string")
    found = plan.scan(files, plan.Options(engines=("semgrep",)), engine_reports={"semgrep": report_rows})
    assert titles(found) == [("a.py", 1, "eval() usage"), ("a.py", 3, "rule"), ("a.py", 9, "rule")]
    with pytest.raises(ValueError, match="unknown engine"):
        reports.engines(["nope"])


def test_verdicts_lower_and_drop(files_of, spark):
    files = files_of({"a.py": "eval(a)\nexec(b)\nos.system(c)\n"})
    rows = [
        ("r", "a.py", 1, "injection/eval_usage", '{"confirmed": false}', None),
        ("r", "a.py", 2, "injection/exec_usage", '```\n{"confirmed": true, "severity": "low"}\n```', None),
        ("r", "a.py", 3, "injection/os_system_call", '{"confirmed": false}', "timeout"),
    ]
    verdicts = spark.createDataFrame(rows, "repo string, file string, line int, finding_id string, raw string, error string")
    got = {r.line: (r.severity, r.ai_confirmed) for r in plan.scan(files, verdicts=verdicts).collect()}
    assert got == {2: ("LOW", True), 3: ("CRITICAL", None)}


RULES = """
rules:
  - {id: host, pattern: "corp[.]internal", message: "Internal host.", severity: high, fix_phase: 1, fix: "Move it."}
  - {id: bad, pattern: "([x", message: m, severity: LOW}
  - {id: host, pattern: "y", message: m, severity: LOW}
  - {id: empty, pattern: "a*", message: m, severity: LOW}
  - {id: phase, pattern: "y", message: m, severity: LOW, fix_phase: true}
  - {id: kinds, pattern: "y", message: m, severity: LOW, suffixes: ".py"}
  - {id: level, pattern: "y", message: m, severity: URGENT}
  - just text
  - {id: bad, pattern: "(?P<q>z)(?P=q)", message: "Twice.", severity: LOW, suffixes: [".RB"]}
"""


def test_rule_files(files_of, spark, tmp_path):
    path = tmp_path / "rules.yml"
    path.write_text(RULES)
    loaded, warnings = rules.load_rules(spark, [str(path), str(tmp_path / "absent.yml")])
    assert [r.id for r in loaded] == ["host", "bad"]
    assert len(warnings) == 8 and any("duplicate id" in w for w in warnings)
    files = files_of({"a.py": "# corp.internal\nzz", "b.rb": "zzz zz"})
    found = plan.scan(files, plan.Options(scanners=("custom",), rules=tuple(loaded)))
    assert titles(found) == [("a.py", 1, "host"), ("b.rb", 1, "bad")]


def test_repositories_bring_their_own_rules(files_of):
    mine = 'rules: [{id: mine, pattern: "x\\ny", message: m, severity: LOW}]'
    files = files_of([("a", "conf/rules.yml", mine), ("a", "a.py", "\nx\ny"), ("b", "a.py", "x\ny")])
    found = plan.scan(files, plan.Options(scanners=("custom",), rule_files=("conf/rules.yml",)))
    assert [(r.repo, r.file, r.line, r.title) for r in found.collect()] == [("a", "a.py", 2, "mine")]


def test_registered_scanner(files_of, monkeypatch):
    monkeypatch.setattr(plan, "_extra", {})

    def long_lines(path, content):
        return [
            {"line": i, "severity": "LOW", "title": "Long line"}
            for i, text in enumerate(content.split("\n"), start=1)
            if len(text) > 5
        ]

    plan.register_scanner("style", plan.file_scanner("style", long_lines, (".txt", ".py")))
    found = plan.scan(files_of({"a.py": "x\nlonger line\n", "b.js": "longer line"}), plan.Options(scanners=("style",)))
    assert titles(found) == [("a.py", 2, "Long line")]
    with pytest.raises(ValueError, match="unknown scanner"):
        plan.chosen_scanners(["nope"])


def test_options_from_a_table():
    options, warnings = plan.Options.from_table({"exclude": ["a"], "fail_on": "LOW", "odd": 1}, exclude=("b",))
    assert options.exclude == ("b",) and options.fail_on == "low" and warnings == ["ignoring unknown key: odd"]
    for table in ({"scanners": []}, {"fail_on": "x"}, {"exclude": "a"}, {"rules": [1]}):
        with pytest.raises(ValueError):
            plan.Options.from_table(table)


def test_tree_reader_drops_bad_bytes(spark, tmp_path):
    (tmp_path / "one" / "src").mkdir(parents=True)
    (tmp_path / "one" / "src" / "a.py").write_bytes(b"eval(x) # \xff\xe9 \xc3\xa9\n")
    row = tree.read_tree(spark, str(tmp_path)).first()
    assert (row.repo, row.path, row.content) == ("one", "src/a.py", "eval(x) #  é\n")


def test_written_documents_keep_their_order(files_of, spark, tmp_path):
    import json
    import pathlib

    files = files_of({f"f{i}.py": f"eval(a{i})\nos.system('ls')\n" for i in range(30)})
    found = spark.createDataFrame(plan.scan(files).collect(), plan.schemas.FINDINGS)
    report.write_documents(report.json_document(found), str(tmp_path / "out"))
    parts = sorted(pathlib.Path(tmp_path / "out" / "repo=r").glob("part-*"))
    document = json.loads("".join(p.read_text() for p in parts))
    assert document["total_issues"] == 60 and document["severity_counts"] == {"CRITICAL": 30, "LOW": 30}
    assert [f["severity"] for f in document["findings"]] == ["CRITICAL"] * 30 + ["LOW"] * 30
    sarif = report.sarif_document(found).orderBy("seq").collect()
    log = json.loads("".join(r.text for r in sarif))
    assert len(log["runs"][0]["results"]) == 60 and len(log["runs"][0]["tool"]["driver"]["rules"]) == 2
    assert log["runs"][0]["results"][0]["ruleIndex"] == 0


def test_validation_reports_the_first_reason(spark):
    rows = [("s", 0, None, "x", "m", "LOW", None, None, ""), ("s", 1, "a", None, "m", "LOW", None, None, "")]
    got = custom.validate(spark.createDataFrame(rows, custom.RAW_RULES_DDL)).orderBy("pos").collect()
    assert [r.reason for r in got] == ["missing id", "missing pattern"]
