"""Readers of user rules: YAML files on the driver (settings), or rule files inside the repositories."""

from __future__ import annotations

import json
from collections.abc import Sequence
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codewarden.functions.sizes import broadcast_if_small
from codewarden.operators import custom

FIELDS = ("id", "pattern", "message", "severity", "fix_phase", "suffixes", "fix")
_ROW = "array<struct<pos:bigint,id:string,pattern:string,message:string,severity:string,fix_phase:string,suffixes:string,fix:string,problem:string>>"


def _field(raw: dict, name: str) -> tuple[str | None, str | None]:
    """(text of a field, problem): texts as they are, the rest as JSON; wrong types are a problem."""
    value = raw.get(name)
    if value is None:
        return None, None
    if name == "fix_phase":
        good = isinstance(value, int) and not isinstance(value, bool)
        return (str(value), None) if good else (None, "bad fix_phase")
    if name == "suffixes":
        good = isinstance(value, list) and all(isinstance(x, str) for x in value)
        return (json.dumps([x.lower() for x in value]), None) if good else (None, "bad suffixes")
    if name == "severity":
        return str(value), None
    return (value, None) if isinstance(value, str) else (None, f"bad {name}" if name == "fix" else None)


def parse_rules(text: str | None) -> list[dict]:
    """Raw rule rows of one YAML text; a text that is no rule list is one rejected row."""
    try:
        import yaml
    except ImportError as exc:  # pragma: no cover
        raise ImportError("reading rule files needs PyYAML; pass CustomRule objects instead") from exc
    empty = dict.fromkeys(FIELDS)
    try:
        data = yaml.safe_load(text or "")
    except yaml.YAMLError:
        return [{"pos": 0, **empty, "problem": "not valid YAML"}]
    if data is None:
        return []
    entries = data.get("rules") if isinstance(data, dict) else None
    if not isinstance(entries, list):
        return [{"pos": 0, **empty, "problem": "no top-level rules list"}]
    rows = []
    for pos, raw in enumerate(entries):
        if not isinstance(raw, dict):
            rows.append({"pos": pos, **empty, "problem": "not a mapping"})
            continue
        fields = {name: _field(raw, name) for name in FIELDS}
        problems = [problem for _, problem in fields.values() if problem]
        rows.append({"pos": pos, **{n: v for n, (v, _) in fields.items()}, "problem": problems[0] if problems else None})
    return rows


def raw_rules(rule_files: DataFrame) -> DataFrame:
    """Raw rule rows of ``rule_files(repo, path, content)``."""

    @F.pandas_udf(_ROW)
    def parse(contents: pd.Series) -> pd.Series:
        return contents.map(parse_rules)

    rows = rule_files.select("repo", F.col("path").alias("source"), F.explode(parse("content")).alias("r"))
    return rows.select("repo", "source", "r.*")


def load_rules(spark: SparkSession, paths: Sequence[str]) -> tuple[list[custom.CustomRule], list[str]]:
    """Accepted rules of YAML files on the driver, and a warning per rejected row."""
    rows = []
    for path in paths:
        try:
            rows.append(("", path, Path(path).read_text(encoding="utf-8")))
        except OSError as exc:
            rows.append(("", path, f"cannot read: {exc}"))
    if not rows:
        return [], []
    files = spark.createDataFrame(rows, "repo string, path string, content string")
    judged = custom.validate(raw_rules(files)).orderBy("source", "pos").collect()
    warnings = [f"{r.source}: rule {r.id!r}: {r.reason} - skipped" for r in judged if r.reason]
    return [_rule(r) for r in judged if not r.reason], warnings


def _rule(row) -> custom.CustomRule:
    suffixes = tuple(json.loads(row.suffixes)) if row.suffixes is not None else None
    return custom.CustomRule(
        row.id, row.pattern, row.message, row.severity.upper(), int(row.fix_phase or 3), suffixes, row.fix or ""
    )


def repo_rules(files: DataFrame, paths: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) rules that repositories keep in their own rule files at ``paths``."""
    judged = custom.validate(raw_rules(files.where(F.col("path").isin(*paths))))
    return judged.where(F.col("reason").isNull()), judged.where(F.col("reason").isNotNull())


def repo_findings(files: DataFrame, accepted: DataFrame) -> DataFrame:
    """Findings of each repository's own rules over its files.

    A repository's rules are one row (its rule files are rows of the input themselves); that row meets
    the files by broadcast when measured small.
    """
    rule = F.struct("source", "pos", "id", "pattern", "message", F.upper("severity").alias("severity"),
                    F.coalesce(F.col("fix_phase").cast("int"), F.lit(3)).alias("fix_phase"),
                    F.from_json("suffixes", "array<string>").alias("suffixes"), F.coalesce("fix", F.lit("")).alias("fix"), "needs")
    rules = custom.with_needs(accepted).groupBy("repo").agg(F.array_sort(F.collect_list(rule)).alias("_rules"))
    return custom.rules_per_row(files.join(broadcast_if_small(rules), "repo"))
