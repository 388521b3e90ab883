"""Baseline of accepted findings: identity keys, write, read, anti-join filter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codewarden.functions import text as X

KEY = ["repo", "id", "file", "hash"]


def relative_file(file, root):
    """Path relative to the root; unchanged when it is not below it."""
    prefix = F.concat(root, F.lit("/"))
    return F.when(F.startswith(file, prefix), F.substr(file, F.length(prefix) + 1)).otherwise(file)


def with_keys(findings: DataFrame, root: str | None = None) -> DataFrame:
    """Adds ``id`` and ``hash``: digest of the flagged line, or of the snippet without a real line."""
    anchored = (F.col("line") >= 1) & ~F.col("project_level") & F.col("line_text").isNotNull()
    text = X.strip(F.when(anchored, F.col("line_text")).otherwise(F.col("snippet")))
    out = findings.withColumns(
        {
            "id": X.finding_id(F.col("scanner"), F.col("title")),
            "hash": F.substring(F.sha2(text, 256), 1, 16),
        }
    )
    return out.withColumn("file", relative_file(F.col("file"), F.lit(root))) if root else out


def entries(findings: DataFrame, root: str | None = None) -> DataFrame:
    """Distinct identities, sorted."""
    return with_keys(findings, root).select(*KEY).distinct().orderBy(*KEY)


def write(findings: DataFrame, path: str, root: str | None = None) -> None:
    entries(findings, root).write.mode("overwrite").json(path)


def read(spark, path: str) -> DataFrame:
    """Entries of a written baseline; a row without all of its fields is an error, raised here and not in a later job."""
    rows = spark.read.schema("repo string, id string, file string, hash string, _bad string").option(
        "columnNameOfCorruptRecord", "_bad"
    ).json(path)
    bad = F.col("_bad").isNotNull() | F.col("id").isNull() | F.col("file").isNull() | F.col("hash").isNull()
    entry = F.struct(*KEY, "_bad")
    first = rows.select(entry.alias("entry"), bad.alias("bad")).where("bad").select(F.to_json("entry").alias("entry")).take(1)
    if first:
        raise ValueError(f"baseline {path} has a malformed entry; write it again: {first[0]['entry']}")
    return rows.select(*KEY)


def filter_known(findings: DataFrame, known: DataFrame, root: str | None = None) -> DataFrame:
    """Findings whose identity is not in the baseline."""
    keyed = with_keys(findings, root)
    return keyed.join(known.select(*KEY).distinct(), KEY, "left_anti").select(*keyed.columns).drop("id", "hash")
