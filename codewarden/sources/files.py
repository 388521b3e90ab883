"""Readers that yield a ``files(repo, path, file_seq, content)`` table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def decode(content: Column) -> Column:
    """Text of UTF-8 bytes, undecodable bytes dropped (a genuine U+FFFD is dropped with them)."""
    return F.replace(F.make_valid_utf8(content.cast("string")), F.lit("�"), F.lit(""))


def file_seq(path: Column) -> Column:
    """A number in the order of the paths: their first seven bytes.

    Paths that begin alike have one number and are told apart by themselves: wherever files are ordered or a first
    file is picked, the path follows the number. No listing of all paths is needed for it.
    """
    start = F.rpad(F.substring(F.hex(F.encode(path, "UTF-8")), 1, 14), 14, "0")
    return F.conv(start, 16, 10).cast("bigint")


def read_tree(spark: SparkSession, root: str, repo: str | None = None) -> DataFrame:
    """Files below ``root`` on any file system Spark reads; the first directory level is the
    repository unless ``repo`` names one. Paths are repository-relative."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").removeprefix("file:").lstrip("/")
    relative = F.regexp_replace(F.col("path"), f"^[a-z0-9]*:?/*{_quote(base)}/", "")
    if repo is not None:
        named = raw.select(F.lit(repo).alias("repo"), relative.alias("path"), "content", "modificationTime")
    else:
        named = raw.select(
            F.substring_index(relative, "/", 1).alias("repo"),
            F.regexp_replace(relative, "^[^/]*/", "").alias("path"),
            "content",
            "modificationTime",
        )
    return named.select(
        "repo",
        "path",
        file_seq(F.col("path")).alias("file_seq"),
        decode(F.col("content")).alias("content"),
        F.col("modificationTime").alias("mtime"),
    )


def _quote(text: str) -> str:
    return "".join(ch if ch.isalnum() or ch in "/_ -" else "\\" + ch for ch in text)


def from_texts(df: DataFrame, repo: Column, path: Column, seq: Column, content: Column) -> DataFrame:
    """Any table with a text column as a ``files`` table."""
    return df.select(
        repo.cast("string").alias("repo"),
        path.alias("path"),
        seq.cast("bigint").alias("file_seq"),
        F.coalesce(content, F.lit("")).alias("content"),
    )
