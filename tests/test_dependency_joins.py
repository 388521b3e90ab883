"""Joins and aggregates of the dependency scan at the size of the repositories."""

from codewarden.operators import deps
from codewarden.sources import manifests as M


def test_rows_of_every_repository_are_not_broadcast(files_of):
    lock = '{"packages": {"node_modules/a": {"version": "1.0.0"}}}'
    rows = files_of({"package-lock.json": lock, "requirements.txt": "a==1"})
    roots = M.project_roots(rows, rows)
    for df in (roots, M.lock_entries(M.lockfiles_at(rows, roots)), M.pins(M.requirement_files(rows, roots))):
        assert df.count() == 1
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_version_keys_are_made_for_distinct_versions(spark):
    made = spark.range(50).selectExpr("'npm' AS ecosystem", "'a' AS name", "cast(id % 2 AS string) || '.0.0' AS version")
    known = spark.createDataFrame([("V", None, None, None, [(("npm", "a"), [], [("SEMVER", [("1.0.0", None, None)])])])], deps.ADVISORIES_DDL)
    found = deps.match(made, known)
    assert [tuple(r) for r in found.collect()] == [("npm", "a", "1.0.0", "V")]
    # The dependency rows are read once, for the distinct triples: nothing of the matching is pushed down to them.
    assert "Range (" not in found._jdf.queryExecution().optimizedPlan().toString()
