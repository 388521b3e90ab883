import os

import pytest

import __spark_entry__ as entry
from workload import check

SF = "/root/testdata/sf0.001"


def test_one_query_per_operator():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()


@pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")
@pytest.mark.parametrize("name", ["op3_secrets", "op7_top_inner_products", "op9_main_text"])
def test_query(spark, name):
    line, good = check.compare(spark, check.connect(SF), name, entry.queries()[name], entry.oracle_sql().get(name), SF)
    assert good, line
