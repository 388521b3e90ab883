import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from codewarden.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[4]", **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "6g",
        }
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def files_of(spark):
    """files(...) from {path: content} or a list of (repo, path, content)."""

    def make(entries):
        if isinstance(entries, dict):
            entries = [("r", path, content) for path, content in entries.items()]
        rows = [(repo, path, i, content) for i, (repo, path, content) in enumerate(entries)]
        return spark.createDataFrame(rows, "repo string, path string, file_seq bigint, content string")

    return make
