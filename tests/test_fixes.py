"""Composed edits against a plain line-by-line edit of each file."""

import random

import pytest
from pyspark.sql import functions as F

from codewarden.operators import fix
from codewarden.plans import file_pass
from codewarden.schemas import as_findings


def _edited(content, edits, line_end):
    """The file by plain list operations, from the last edit to the first."""
    nl = ("\r\n" if "\r\n" in content else "\n") if content else line_end
    lines = content.splitlines()
    for action, line, text in sorted(edits, key=lambda e: (e[1], e[0] == "replace"), reverse=True):
        if action == "replace":
            lines[line - 1] = text
        elif action == "insert":
            lines.insert(line - 1, text)
    lines += [text for action, _, text in edits if action == "append"]
    ends = content.endswith("\n") or any(action == "append" for action, _, _ in edits)
    return nl.join(lines) + (nl if ends else "")


def test_composed_files_are_the_plain_edits(spark, files_of):
    rnd = random.Random(5)
    entries, rows, want = [], [], {}
    for n in range(60):
        path, nl = f"f{n}.txt", rnd.choice(["\n", "\r\n"])
        count = rnd.choice([0, 1, 2, 12])
        content = nl.join(f"line {i}" for i in range(count)) + (nl if count and rnd.random() < 0.5 else "")
        if count or rnd.random() < 0.5:
            entries.append((f"r{n % 7}", path, content))
        edits = [("replace", i + 1, f"new {i}") for i in range(count) if rnd.random() < 0.4]
        edits += [("insert", rnd.randint(1, count), "in")] if count and rnd.random() < 0.5 else []
        edits += [("append", k, f"end {k}") for k in range(rnd.randint(0, 3))]
        for k, (action, line, text) in enumerate(edits):
            rows.append((f"r{n % 7}", path, line, action, None, text, "t", nl, k))
        if edits:
            want[f"r{n % 7}", path] = (_edited(content, edits, nl), len(edits))
    ddl = "repo string, path string, line int, action string, old_text string, new_text string, title string, line_end string, emit_seq int"
    got = fix.compose(spark.createDataFrame(rows, ddl), files_of(entries)).collect()
    assert {(r.repo, r.path): (r.new_content, r.edits) for r in got} == want


@pytest.fixture
def two(files_of):
    return files_of([
        ("r", "a.py", 'import sys\nx_token = "0123456789abcdefABCDEF"\r\ncall(token="0123456789abcdefABCDEG")\n'),
        ("r", "b.py", 'password = "hunter2secret"'),
        ("r", "c.py", 'import os\npassword = "hunter3secret"\n'),
        ("r", ".env", "OLD=1"),
        ("q", "d.js", 'const password = "hunter4secret";\n'),
    ])


def test_secrets_of_a_repository_become_one_edit_list(two):
    found = file_pass.findings(two, ("secrets",))
    edits = fix.line_edits(found, two)
    files = {(r.repo, r.path): r.new_content for r in fix.compose(edits, two).collect()}
    assert files == {
        ("r", "a.py"): 'import os\r\nimport sys\r\nx_token = os.environ["X_TOKEN"]\r\ncall(token="0123456789abcdefABCDEG")\r\n',
        ("r", "b.py"): 'import os\npassword = os.environ["PASSWORD"]',
        ("r", "c.py"): 'import os\npassword = os.environ["PASSWORD"]\n',
        ("r", ".env"): "OLD=1\nX_TOKEN=0123456789abcdefABCDEF\nPASSWORD=hunter2secret\nPASSWORD=hunter3secret\n",
        ("r", ".gitignore"): ".env\r\n",
    }
    again = fix.verify_composed(edits, fix.compose(edits, two), lambda f: file_pass.findings(f, ("secrets",))).collect()
    assert sorted((r.path, r.line, r.new_line, r.fixed) for r in again) == [("a.py", 2, 3, True), ("b.py", 1, 2, True), ("c.py", 2, 2, True)]
    broken = fix.compose(edits, two).withColumn("new_content", F.replace("new_content", F.lit('os.environ["PASSWORD"]'), F.lit('"hunter9secret"')))
    judged = fix.verify_composed(edits, broken, lambda f: file_pass.findings(f, ("secrets",))).collect()
    assert {r.path: r.fixed for r in judged} == {"a.py": True, "b.py": False, "c.py": False}


def test_pins_of_one_file_and_no_findings(spark, files_of):
    text = "flask==1.0\nDjango[x] == 2.0 ; python_version > '3'\nother==1\n"
    files = files_of([("r", "requirements.txt", text)])
    rows = [("r", "requirements.txt", i, f"t{i}", "deps", 1, s) for i, s in ((1, "Upgrade flask to >=1.1"), (2, "Upgrade Django to >=2.2.1"), (3, "Upgrade gone to >=9"))]
    found = as_findings(spark.createDataFrame(rows, "repo string, file string, line int, title string, scanner string, fix_phase int, fix_summary string"))
    composed = fix.compose(fix.line_edits(found, files), files)
    assert [(r.new_content, r.edits) for r in composed.collect()] == [("flask==1.1\nDjango[x]==2.2.1\nother==1\n", 2)]
    assert fix.compose(fix.line_edits(found.where("false"), files), files).collect() == []
