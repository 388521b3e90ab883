"""Ignored files are left out the same way at any size of the patterns, and contents never move for it."""

from codewarden.operators import select
from codewarden.plans.scan import Options, scan

FILES = {
    ".gitignore": "gen/\n*.tmp.js\n!keep.tmp.js\n",
    "a.js": "eval(q);\n",
    "gen/b.js": "eval(q);\n",
    "c.tmp.js": "eval(q);\n",
    "keep.tmp.js": "eval(q);\n",
    "gen/server.py": "from flask import Flask\napp = Flask(__name__)\nsession['x'] = 1\n",
    "requirements.txt": "flask==1.0\n",
}


def _found(files, **options):
    return sorted((r.repo, r.file, r.title) for r in scan(files, Options(**options)).collect())


def test_both_ways_agree(files_of):
    rows = [("one", p, c) for p, c in FILES.items()] + [("two", p, c) for p, c in FILES.items() if p != ".gitignore"]
    files = files_of(rows)
    small = _found(files)
    assert {f for r, f, _ in small if r == "one"} == {"a.js", "keep.tmp.js"}
    assert {f for r, f, _ in small if r == "two"} > {"gen/b.js", "gen/server.py"}
    assert _found(files, ignore_limit=0) == small
    assert _found(files, ignore_limit=0, exclude=("a.js",)) == [x for x in small if x[1] != "a.js"]


def test_contents_do_not_move(files_of):
    files = files_of(FILES)
    large = select.Selection(files, (), files, 0)
    plan = large.files._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert {r.path for r in large.paths().collect()} == {"a.js", "keep.tmp.js"}
    assert {r.path for r in select.Selection(files, (), files).paths().collect()} == {"a.js", "keep.tmp.js"}
