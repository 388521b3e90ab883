import os

import pytest

from codewarden.plans.scan import Options, scan
from codewarden.session import cut_lineage, scratch, shared_dir


def test_scratch_owns_what_is_written_inside(spark, files_of):
    base = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(base)) if os.path.isdir(base) else set()
    with scratch(spark) as folder:
        rows = scan(files_of({"a.py": "eval(x)\n"}), Options(scanners=("injection",))).collect()
        assert os.listdir(folder.removeprefix("file:"))
    assert len(rows) == 1 and set(os.listdir(base)) == before
    with pytest.raises(KeyError), scratch(spark):
        cut_lineage(spark.range(3))
        raise KeyError
    assert set(os.listdir(base)) == before
    assert cut_lineage(spark.range(3)).count() == 3 and set(os.listdir(base)) != before
