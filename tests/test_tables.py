"""Order-dependent operators and matching against brute force, with hot keys."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from codewarden.functions.ordering import range_rank
from codewarden.operators import deps, evaluate, fix, history
from codewarden.sources import manifests, patches
from codewarden.streaming import watch


def random_log(rng, n):
    lines = []
    for _ in range(n):
        lines.append(
            rng.choice(
                ["COMMIT " + "%040x" % rng.getrandbits(160), "+++ b/a.py", '+++ "b/b c.py"', "+++ /dev/null", "@@ -1 +%d,3 @@" % rng.randrange(99),
                 "@@ -2 +7 @@ def f():", "@@ odd", "+x", "+y = 1", "-z", "+", " same"]
            )
        )
    return lines


def added_by_hand(lines):
    sha, path, line, out = "", None, 0, []
    for raw in lines:
        if raw.startswith("COMMIT "):
            sha, path = raw[7:].strip(), None
        elif raw.startswith("+++ "):
            name = raw[4:].strip().strip('"')
            path = name[2:] if name.startswith("b/") else None
        elif raw.startswith("@@"):
            found = re.match(r"@@ -\S+ \+(\d+)", raw)
            line = int(found.group(1)) if found else 0
        elif raw.startswith("+") and path is not None and sha:
            out.append((sha, path, line, raw[1:]))
            line += 1
    return out


def test_added_lines_across_blocks(spark):
    rng = random.Random(5)
    logs = {"hot": random_log(rng, 600), "a": random_log(rng, 40), "b": random_log(rng, 3)}
    rows = [(repo, i, raw) for repo, lines in logs.items() for i, raw in enumerate(lines)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "repo string, pos bigint, raw string")
    for block in (7, 100_000):
        got = patches.added_lines(df, block).orderBy("repo", "pos").collect()
        for repo, lines in logs.items():
            assert [(r.sha, r.path, r.new_line, r.text) for r in got if r.repo == repo] == added_by_hand(lines)


def test_history_names_the_commit_and_drops_copies(spark):
    key = "AKIA" + "7" * 16
    log = ["COMMIT " + "a" * 40, "+++ b/x.py", "@@ -0,0 +5 @@", f'+k = "{key}"', f'+# k = "{key}"', "+++ b/x.py", "@@ -0,0 +5 @@", f'+k = "{key}"']
    df = spark.createDataFrame([("r", i, raw) for i, raw in enumerate(log)], "repo string, pos bigint, raw string")
    row = history.secret_findings(df).collect()
    assert [(r.file, r.line, r.snippet) for r in row] == [("x.py @ " + "a" * 12, 5, f'k = "{key}"')]
    assert row[0].description.startswith("Committed in " + "a" * 40) and "rotate the credential" in row[0].description


def test_range_rank_is_the_rank(spark):
    rng = random.Random(1)
    rows = [(rng.choice("aaab"), rng.randrange(300), i) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, v int, i int")
    got = range_rank(df, ["k"], [F.col("v"), F.col("i")], "n").collect()
    for key in "ab":
        want = sorted((v, i) for k, v, i in rows if k == key)
        assert [(r.v, r.i) for r in sorted((r for r in got if r.k == key), key=lambda r: r.n)] == want
        assert sorted(r.n for r in got if r.k == key) == list(range(1, len(want) + 1))


def affected_by_hand(version, versions, events):
    """Walk the events in version order; an empty range list covers nothing."""

    def key(v):
        return [0] if v == "0" else [int(x) for x in v.split(".")]

    if version in versions:
        return True
    inside = False
    marks = [(key(v), kind) for kind, v in events]
    for at, kind in sorted(marks, key=lambda m: (m[0], m[1] == "introduced")):
        if at <= key(version):
            inside = kind == "introduced"
    return inside


def test_version_ranges(spark):
    rng = random.Random(11)
    cases = []
    for _ in range(200):
        points = rng.sample(range(1, 40), 4)
        points.sort()
        events = [("introduced", "0" if rng.random() < 0.3 else f"1.{points[0]}.0"), ("fixed", f"1.{points[1]}.0")]
        if rng.random() < 0.5:
            events += [("introduced", f"1.{points[2]}.0"), ("fixed", f"1.{points[3]}.0")]
        cases.append((f"1.{rng.randrange(42)}.{rng.randrange(2)}", [f"1.{rng.randrange(42)}.0"], events))
    rows = [
        (i, v, vs, [{"introduced": x if k == "introduced" else None, "fixed": x if k == "fixed" else None, "last_affected": None} for k, x in es])
        for i, (v, vs, es) in enumerate(cases)
    ]
    ddl = "i int, v string, vs array<string>, es array<struct<introduced:string,fixed:string,last_affected:string>>"
    got = spark.createDataFrame(rows, ddl).select("i", deps.is_affected(F.col("v"), F.lit("npm"), F.col("vs"), F.array(F.struct(F.col("es").alias("events")))).alias("x")).collect()
    for row in got:
        assert row.x == affected_by_hand(*cases[row.i]), cases[row.i]


LOCK = '{\n "packages": {\n  "": {"version": "1.0.0"},\n  "node_modules/a": {"version": "1.2.3"},\n  "node_modules/b/node_modules/a": {"version": "1.2.3"},\n  "node_modules/c": {"version": 7},\n  "w": {"link": true, "version": "1.0.0"}\n }\n}'


@pytest.mark.parametrize(
    "text, want",
    [
        (LOCK, [("a", "1.2.3", 4)]),
        ('{"dependencies": {\n"a": {\n"version": "1.0.0", "dependencies": {\n"b": {"version": "2.0.0"}}},\n"c": 5}}', [("a", "1.0.0", 2), ("b", "2.0.0", 4)]),
        ('{"packages": {}, "dependencies": {"a": {"version": "1.0.0"}}}', []),
        ("[]", []),
        ("{", []),
    ],
)
def test_lockfiles(text, want):
    assert [(e["name"], e["version"], e["line"]) for e in manifests._parse_lock(text)] == want


def test_unknown_details_and_shrinkwrap_preference(files_of, spark):
    lock = '{"dependencies": {"x": {"version": "1.0.0"}}}'
    files = files_of({"a.js": "", "package.json": "{}", "npm-shrinkwrap.json": lock.replace("x", "y"), "package-lock.json": lock})
    advisory = spark.createDataFrame(
        [("V1", None, None, None, [(("npm", "x"), ["1.0.0"], []), (("npm", "y"), ["1.0.0"], None)])], deps.ADVISORIES_DDL
    )
    row = deps.findings(files, files.where("path = 'a.js'"), advisory).collect()
    assert [(r.file, r.title, r.severity, r.description, r.fix_summary) for r in row] == [
        ("package-lock.json", "Vulnerable package: x@1.0.0 (V1)", "HIGH", "Known vulnerability. (source: OSV.dev)", "Upgrade x to a patched release")
    ]


def test_published_advisories(files_of, spark, tmp_path):
    """Files as published: two ranges that overlap, commit ranges, pre-releases, an epoch; hits worked out by hand."""
    events = lambda *pairs: [{k: v} for k, v in pairs]
    advisory = {
        "id": "OSV-1", "modified": "2024-01-01T00:00:00Z", "summary": "One line\nmore", "database_specific": {"severity": "LOW", "x": [1]},
        "affected": [
            {"package": {"ecosystem": "npm", "name": "a", "purl": "pkg:npm/a"}, "ranges": [
                {"type": "GIT", "repo": "r", "events": events(("introduced", "0"), ("fixed", "abc"))},
                {"type": "SEMVER", "events": events(("introduced", "1.0.0-alpha.2"), ("fixed", "1.2.0"))},
                {"type": "SEMVER", "events": events(("introduced", "1.1.0"), ("fixed", "1.4.0-beta.11"))}]},
            {"package": {"ecosystem": "PyPI", "name": "B.b"}, "versions": ["0.1"], "ranges": [
                {"type": "ECOSYSTEM", "events": events(("introduced", "1.0.post1"), ("last_affected", "1!2.0"))}]},
        ],
    }
    (tmp_path / "a.json").write_text(json.dumps(advisory, indent=1))
    (tmp_path / "b.json").write_text(json.dumps({"id": "OSV-2", "affected": [{"package": {"ecosystem": "npm", "name": "zz"}}]}))
    pins = {"a": "1.0.0-alpha.1 1.0.0-alpha.beta 1.0.0 1.3.0 1.4.0-beta.2 1.4.0-beta.11 1.4.0".split(), "b-B": "0.1 1.0 1.0.post1 1.0.dev1 9.0 1!1.5 1!2.0.dev1 1!2.1".split()}
    rows = [("r", "p", i, name, v, "npm" if name == "a" else "PyPI", "raw", i) for name, vs in pins.items() for i, v in enumerate(vs)]
    found = spark.createDataFrame(rows, "repo string, path string, line int, name string, version string, ecosystem string, raw string, ord int")
    known = deps.read_advisories(spark, str(tmp_path))
    hits = {(r.ecosystem, r.version) for r in deps.match(found, known).collect()}
    assert hits == {("npm", v) for v in "1.0.0-alpha.beta 1.0.0 1.3.0 1.4.0-beta.2".split()} | {("PyPI", v) for v in "0.1 1.0.post1 9.0 1!1.5 1!2.0.dev1".split()}
    row = deps.advised(deps.match(found, known), known).where("ecosystem = 'npm'").first()
    assert (row.severity, row.summary, row.fixed) == ("LOW", "One line", "1.2.0")


def test_scores_by_hand(spark):
    labels = spark.createDataFrame(
        [("c1", "a", 10, 1, ["sqli", "xss"]), ("c1", "b", 5, 2, ["sqli", "xss"]), ("c2", "a", 1, 3, ["cmdi"])],
        "cve string, file string, line int, weakness_id int, categories array<string>",
    )
    findings = spark.createDataFrame(
        [("c1", "a", 12, "f1", ["sqli"]), ("c1", "a", 13, "f2", ["sqli"]), ("c1", "b", 5, "f3", ["ssrf"]), ("c1", "b", 9, "f4", ["xss", "sqli"])],
        "cve string, file string, line int, finding_id string, cats array<string>",
    )
    got = {r.category: (r.tp, r.fp, r.fn, r.precision, r.recall) for r in evaluate.scores(findings, labels, labels.select("cve", "categories").distinct()).collect()}
    assert got == {
        "sqli": (1, 2, 1, 1 / 3, 0.5),
        "xss": (1, 1, 1, 0.5, 0.5),
        "cmdi": (0, 0, 1, None, 0.0),
        "all": (2, 3, 3, 0.4, 0.4),
    }


def test_close_lines_match_over_bucket_borders(spark):
    f = spark.createDataFrame([("c", "a", n, f"f{n}", ["xss"]) for n in range(40)], "cve string, file string, line int, finding_id string, cats array<string>")
    w = spark.createDataFrame([("c", "a", n, n, ["xss"]) for n in range(40)], "cve string, file string, line int, weakness_id int, categories array<string>")
    got = {(r.w_line, r.f_line) for r in evaluate.line_matches(f, w).collect()}
    assert got == {(a, b) for a in range(40) for b in range(40) if abs(a - b) <= 2}
    counts = {r.weakness_id: r.n for r in evaluate.matches(f, w).collect()}
    assert counts == {a: sum(abs(a - b) <= 2 for b in range(40)) for a in range(40)}


def test_fixes_keep_line_ends_and_refuse_calls(files_of):
    from codewarden.plans import file_pass

    value = "s3cr3t-" + "v" * 20
    files = files_of(
        {
            "a.py": f'"""doc"""\r\nimport re\r\n  token: str = "{value}"\r\n',
            "b.py": f'connect(token="{value}")\n',
            "c.js": f'token = "{value}"\n',
            "d.py": f'import os\ntoken = "{value}"',
        }
    )
    found = file_pass.findings(files, ("secrets",))
    got = {r.file: r.new_content for r in fix.secret_fixes(found, files).collect()}
    assert got == {
        "a.py": '"""doc"""\r\nimport os\r\nimport re\r\n  token = os.environ["TOKEN"]\r\n',
        "d.py": 'import os\ntoken = os.environ["TOKEN"]',
    }


def test_pins_are_raised_where_they_still_stand(files_of, spark):
    """The whole line becomes the new pin."""
    files = files_of({"requirements.txt": "# x\nMy.Pkg[a]==1.0 ; y\nother==2.0\n"})
    from codewarden.schemas import as_findings

    rows = spark.createDataFrame(
        [("r", "requirements.txt", 2, "t", "deps", 1, "Upgrade my.pkg to >=1.5"), ("r", "requirements.txt", 3, "u", "deps", 1, "Upgrade my.pkg to >=1.5"),
         ("r", "requirements.txt", 3, "v", "deps", 1, "Upgrade other to a patched release")],
        "repo string, file string, line int, title string, scanner string, fix_phase int, fix_summary string",
    )
    got = fix.pin_fixes(as_findings(rows), files).collect()
    assert [(r.title, r.new_line, r.new_content) for r in got] == [("t", "my.pkg[a]==1.5", "# x\nmy.pkg[a]==1.5\nother==2.0\n")]


def test_watch_replaces_versions_and_forgets_deleted_files(spark, tmp_path):
    import datetime as dt

    at = lambda n: dt.datetime(2024, 1, 1, 0, 0, n)
    source, out = tmp_path / "in", str(tmp_path / "out")
    steps = [
        [("r", "a.py", 1, "eval(x)\n", at(1), False), ("r", "b.py", 2, "eval(y)\n", at(1), False)],
        [("r", "a.py", 1, "exec(x)\n", at(2), False), ("r", "b.py", 2, "", at(3), True), ("r", "own.json", 3, "eval(z)", at(3), False)],
    ]
    for n, step in enumerate(steps):
        spark.createDataFrame(step, watch.VERSIONS_DDL).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(watch.VERSIONS_DDL).parquet(str(source))
        query = watch.watch(stream, out, f"{out}/checkpoint", skip_paths=("own.json",), availableNow=True)
        query.awaitTermination()
        got = sorted((r.file, r.title) for r in watch.current_findings(spark, out).collect())
        assert got == ([("a.py", "eval() usage"), ("b.py", "eval() usage")] if n == 0 else [("a.py", "exec() usage")])


def test_watch_scans_whole_repositories(spark, tmp_path):
    """Project-level and dependency findings follow the current files; A, B, A ends as A; a repeat changes nothing."""
    import datetime as dt

    from codewarden.plans.scan import Options

    at = lambda n: dt.datetime(2024, 1, 1, 0, 0, n)
    app, safe = "from flask import Flask\napp = Flask(__name__)\nsession['a'] = 1\n", "csrf = CSRFProtect(app)\n"
    pin = ("r", "requirements.txt", 9, "x==1.0.0\n", at(1), False)
    steps = [
        [("r", "app.py", 1, app, at(1), False), pin, ("s", "a.py", 1, "eval(x)\n", at(1), False)],
        [("r", "safe.py", 2, safe, at(2), False), ("s", "a.py", 1, "exec(x)\n", at(2), False)],
        [("r", "safe.py", 2, "", at(3), True), ("s", "a.py", 1, "eval(x)\n", at(3), False), ("s", "a.py", 1, "exec(x)\n", at(2), False)],
        [("s", "a.py", 1, "exec(x)\n", at(2), False), ("r", "vendor/v.py", 3, "eval(x)\n", at(4), False)],
    ]
    advisory = spark.createDataFrame([("V1", None, None, None, [(("PyPI", "x"), ["1.0.0"], [])])], deps.ADVISORIES_DDL)
    csrf, flask, pinned = ("app.py", "No CSRF protection detected"), ("app.py", "Flask"), ("requirements.txt", "Vulnerable package: x==1.0.0 (V1)")
    want = [
        {csrf, pinned, ("a.py", "eval() usage")}, {pinned, ("a.py", "exec() usage")}, {csrf, pinned, ("a.py", "eval() usage")}, {csrf, pinned, ("a.py", "eval() usage")},
    ]
    source, out = tmp_path / "in", str(tmp_path / "out")
    watch.SNAPSHOT, old = 2, watch.SNAPSHOT
    for step, expected in zip(steps, want):
        spark.createDataFrame(step, watch.VERSIONS_DDL).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(watch.VERSIONS_DDL).parquet(str(source))
        watch.watch(stream, out, f"{out}-checkpoint", options=Options(exclude=("vendor",)), advisories=advisory, availableNow=True).awaitTermination()
        got = {(r.file, r.title) for r in watch.current_findings(spark, out).collect() if not r.title.startswith(flask[1])}
        assert got == expected
    watch.SNAPSHOT = old


def test_repeated_deliveries_are_dropped_and_states_kept(spark, tmp_path):
    import datetime as dt

    at = lambda n: dt.datetime(2024, 1, 1, 0, 0, n)
    rows = [("r", "a.py", 1, "x", at(1), False)] * 5 + [("r", "a.py", 1, "y", at(2), False), ("r", "a.py", 1, "x", at(3), False)]
    spark.createDataFrame(rows, watch.VERSIONS_DDL).write.parquet(str(tmp_path / "in"))
    stream = watch.without_repeats(spark.readStream.schema(watch.VERSIONS_DDL).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("saves").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((r.content, r.mtime.second) for r in spark.table("saves").collect()) == [("x", 1), ("x", 3), ("y", 2)]
