"""Registered queries against their SQL on the smallest given tables.

Every topic has a few here; the rest run with ALL_QUERIES=1 or with ``python -m workload.check``.
"""

import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from workload import check

SF = "/root/testdata/sf0.001"
SOME = (
    "scan_all sec_tokens hdr_csrf custom_scan rules_rejected src_collect src_gitignore inj_cmd js_env py_xfn_return "
    "post_sort baseline_filter ai_apply report_json report_sarif_rules eval_scores deps_vulns hist_added_lines diff_filter "
    "ingest_sarif fix_secret stream_latest"
).split()
NAMES = sorted(entry.queries()) if os.environ.get("ALL_QUERIES") else SOME

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")


@pytest.fixture(scope="module")
def con():
    return check.connect(SF)


def test_the_registry_needs_no_session():
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    root = os.path.dirname(os.path.abspath(entry.__file__))
    subprocess.run([sys.executable, "-B", "-c", code], cwd=root, check=True, timeout=120)


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    line, good = check.compare(spark, con, name, entry.queries()[name], entry.oracle_sql().get(name), SF)
    assert good or " 0 vs 0 rows" in line, line


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["repo", "scanner", "severity", "n"] and df.count() > 0
