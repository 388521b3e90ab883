"""The query that writes a file per supplier and reads the tree back."""

from pathlib import Path

from codewarden.session import shared_dir
from workload.selection import src_read_tree


def test_files_are_written_by_several_tasks(spark, tmp_path):
    spark.range(200).selectExpr("id AS s_suppkey", "id % 5 AS s_nationkey", "'n' || id AS s_name").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    before = set(Path(shared_dir(spark)).glob("tree-*"))
    assert src_read_tree(spark, str(tmp_path)).where("in_path_order").count() == 200
    (tree,) = set(Path(shared_dir(spark)).glob("tree-*")) - before
    assert len({file.name.split("-")[1] for file in tree.rglob("part-*.txt")}) > 1
