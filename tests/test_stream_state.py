"""The state of a continuous scan: folders per bucket, snapshots of touched buckets, reruns."""

import datetime
import random
import re
from itertools import combinations

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from codewarden.operators import baseline
from codewarden.plans import file_pass
from codewarden.streaming import watch


def _repos_of_two_buckets(spark):
    rows = spark.range(50).select(F.concat(F.lit("r"), "id").alias("repo")).withColumn("b", watch.bucket_of(F.col("repo"))).collect()
    first = rows[0]
    return (first.repo, first.b), next((r.repo, r.b) for r in rows if r.b != first.b)


@pytest.fixture
def every_two(monkeypatch):
    monkeypatch.setattr(watch, "SNAPSHOT", 2)


def test_a_batch_reads_the_buckets_it_touches(spark, tmp_path, every_two):
    (one, b1), (two, b2) = _repos_of_two_buckets(spark)
    out, source = str(tmp_path / "out"), str(tmp_path / "in")
    at = lambda n: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=n)
    saves = [(one, "a.py", "eval(x)", 0), (two, "b.py", "exec(x)", 1), (one, "c.py", "eval(y)", 2), (two, "b.py", "", 3), (two, "d.py", "eval(z)", 4), (one, "a.py", "", 5)]
    for repo, path, text, n in saves:
        spark.createDataFrame([(repo, path, 0, text, at(n), False)], watch.VERSIONS_DDL).write.mode("append").parquet(source)
        stream = spark.readStream.schema(watch.VERSIONS_DDL).parquet(source)
        watch.watch(stream, out, f"{out}-checkpoint", availableNow=True).awaitTermination()
    found = sorted((r.repo, r.file, r.title) for r in watch.current_findings(spark, out).collect())
    assert found == sorted([(one, "c.py", "eval() usage"), (two, "d.py", "eval() usage")])
    for bucket, repo in ((b1, one), (b2, two)):
        state = watch._state(spark, out, len(saves), [bucket])
        scans = re.findall(r"FileScan parquet .*", state._jdf.queryExecution().executedPlan().toString())
        scans = [scan for scan in scans if "batch#" in scan]  # the others read named folders
        assert scans and all(re.search(r"PartitionFilters: \[[^\]]*bucket#", scan) for scan in scans)
        assert {r.repo for r in state.collect()} == {repo}
        newest = watch.latest_versions(state).collect()
        assert {(r.repo, r.path): r.content for r in newest} == {(r, p): t for r, p, t, _ in saves if r == repo}
    # The last snapshot (batch 4) holds what batches 3 and 4 touched: the second repository.
    index = {(r.batch, r.bucket) for r in spark.read.schema("bucket int, batch int").parquet(f"{out}/snapshot-index").collect()}
    assert index == {(2, b1), (2, b2), (4, b2)}
    read = {f.f.split(str(tmp_path))[1] for f in watch._state(spark, out, 5, [b1, b2]).select(F.input_file_name().alias("f")).distinct().collect()}
    assert {f.rsplit("/", 1)[0] for f in read} == {f"/out/snapshots/batch=2/bucket={b1}", f"/out/snapshots/batch=4/bucket={b2}"}


def test_every_choice_of_scanners_runs(files_of):
    files = files_of({"a.js": "const q = req.query.id;\neval(q);\nel.innerHTML = q;\n", "b.py": "def f(a):\n    eval(a)\nf(input())\n", "c.js": "let x = 1;\n"})
    per_scanner = {}
    for n in range(1, 4):
        for names in combinations(("headers", "injection", "secrets"), n):
            rows = file_pass.findings(files, names).select("scanner", "file", "line", "title", "reachable").collect()
            for name in names:
                mine = sorted(map(str, (r for r in rows if r.scanner == name)))
                assert per_scanner.setdefault(name, mine) == mine
    assert len(per_scanner["injection"]) == 3


def test_the_baseline_is_made_once_and_not_in_every_batch(spark, tmp_path, monkeypatch):
    given, scan = [], watch.scan
    monkeypatch.setattr(watch, "scan", lambda *args, known, **rest: (given.append(known), scan(*args, known=known, **rest))[1])
    source = str(tmp_path / "in")
    rows = [("r", "a.py", 0, "eval(x)\nexec(y)", datetime.datetime(2024, 1, 1), False)]
    files = spark.createDataFrame([(r[0], r[1], r[2], r[3]) for r in rows], "repo string, path string, file_seq bigint, content string")
    known = baseline.entries(scan(files).where("title = 'eval() usage'"))
    spark.createDataFrame(rows, watch.VERSIONS_DDL).write.parquet(source)
    stream = spark.readStream.schema(watch.VERSIONS_DDL).parquet(source)
    watch.watch(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"), known, availableNow=True).awaitTermination()
    assert [r.title for r in watch.current_findings(spark, str(tmp_path / "out")).collect()] == ["exec() usage"]
    plan = given[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Relation") and "Aggregate" not in plan  # a written table, read as it is


def _save(spark, tmp_path, rows, **settings):
    spark.createDataFrame(rows, watch.VERSIONS_DDL).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(watch.VERSIONS_DDL).parquet(str(tmp_path / "in"))
    watch.watch(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"), availableNow=True, **settings).awaitTermination()
    return sorted(((r.repo, r.file, r.line, r.title) for r in watch.current_findings(spark, str(tmp_path / "out")).collect()), key=str)


@pytest.fixture
def scanned(monkeypatch):
    """Paths that the per-file pass is given, a list per pass."""
    given, findings = [], file_pass.findings
    monkeypatch.setattr(file_pass, "findings", lambda files, *args, **rest: (given.append(sorted(r.path for r in files.select("path").collect())), findings(files, *args, **rest))[1])
    return given


def test_a_batch_scans_only_files_of_new_contents(spark, tmp_path, scanned):
    at = lambda n: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=n)
    row = lambda path, text, n, seq=0: ("r", path, seq, text, at(n), False)
    ignores = lambda text, n: row(".gitignore", text, n)
    a, b, c = ("r", "a.py", 1, "eval() usage"), ("r", "b.py", 1, "eval() usage"), ("r", "c.py", 1, "eval() usage")
    assert _save(spark, tmp_path, [row("a.py", "eval(x)", 0), row("b.py", "eval(x)", 0), row("c.py", "eval(x)", 0), ignores("c.py\n", 0)]) == [a, b]
    assert _save(spark, tmp_path, [row("b.py", "x = 1", 1)]) == [a]
    assert _save(spark, tmp_path, [row("a.py", "eval(x)", 2), row("b.py", "eval(x)", 0)]) == [a]  # the same again, and an old one
    assert _save(spark, tmp_path, [row("b.py", "eval(x)", 3)]) == [a, b]  # back to a content whose rows are there
    assert _save(spark, tmp_path, [ignores("a.py\n", 4)]) == [b, c]  # a file that was never scanned, one that is ignored
    assert _save(spark, tmp_path, [ignores("", 5)]) == [a, b, c]
    assert _save(spark, tmp_path, [row("a.py", "eval(x)", 6, 7)]) == [a, b, c]  # its number is part of its rows
    assert scanned == [["a.py", "b.py"], ["b.py"], [], [], ["c.py"], [], ["a.py"]]
    rest = watch.Options(scanners=("secrets",))
    assert _save(spark, tmp_path, [row("d.py", "", 8)], options=rest) == []  # rows of other settings are not taken
    assert scanned[-1] == ["a.py", "b.py", "c.py", "d.py"]


def test_findings_after_every_batch_are_those_of_a_scan(spark, tmp_path, every_two):
    rnd = random.Random(3)
    texts = ["eval(x)\n", "exec(y)\nq = 1\n", "", None, "from flask import Flask\napp = Flask(__name__)\nsession['a'] = 1\n", "csrf = CSRFProtect(app)\n"]
    ignores = ["", "f1.py\n", "f*.py\n!f2.py\n"]
    newest = {}
    for batch in range(6):
        rows = []
        for n in range(8):
            repo, path = rnd.choice(["r", "s"]), rnd.choice([".gitignore", *(f"f{i}.py" for i in range(4)), None])
            when = datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=10 * batch + n - 15 * (rnd.random() < 0.3), seconds=n)
            row = (repo, path, rnd.choice([1, 2]), rnd.choice(ignores if path == ".gitignore" else texts), when, rnd.random() < 0.2)
            rows.append(row)
            newest[repo, path] = max(newest.get((repo, path), row), row, key=lambda r: r[4])
        got = _save(spark, tmp_path, rows)
        live = [r[:4] for r in newest.values() if not r[5]]
        files = spark.createDataFrame(live, "repo string, path string, file_seq bigint, content string")
        assert got == sorted(((r.repo, r.file, r.line, r.title) for r in watch.scan(files).collect()), key=str)


def test_several_tasks_read_a_file_of_the_state(spark, tmp_path, monkeypatch):
    """Contents lie in groups of rows, and a micro-batch reads them in small pieces, whatever the session's pieces are."""
    rnd, given = random.Random(1), []
    scan = watch.scan
    monkeypatch.setattr(watch, "scan", lambda *args, **rest: (given.append(args[0].sparkSession.conf.get("spark.sql.files.maxPartitionBytes")), scan(*args, **rest))[1])
    monkeypatch.setitem(watch.STORED, "parquet.block.size", 1 << 18)
    monkeypatch.setattr(watch, "SPLIT_BYTES", 1 << 18)
    at = datetime.datetime(2024, 1, 1)
    rows = [("r", f"f{i}.py", i, f"eval(x)\n# {rnd.randbytes(4000).hex()}", at, False) for i in range(400)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    assert len(_save(spark, tmp_path, rows)) == 400
    assert given == [f"{1 << 18}b"] and spark.conf.get("spark.sql.files.maxPartitionBytes") == before
    files = [*(tmp_path / "out" / "versions").rglob("*.parquet")]
    assert sum(pq.ParquetFile(f).num_row_groups for f in files) >= 4 * len(files)
    assert {pq.ParquetFile(f).metadata.row_group(0).column(3).compression for f in files} == {"ZSTD"}
