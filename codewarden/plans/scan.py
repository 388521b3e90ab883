"""The whole scan as one plan: select, scan, merge, suppress, review, collapse copies, filter known."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codewarden import schemas
from codewarden.functions import text as X
from codewarden.functions.sizes import BROADCAST_LIMIT
from codewarden.operators import baseline, custom, deps, headers, history, post, select
from codewarden.plans import file_pass
from codewarden.session import cut_lineage
from codewarden.sources import manifests, reports, rules


@dataclass(frozen=True)
class Options:
    """Settings of a scan. ``scanners`` None runs all of them; ``rules`` hold for every repository,
    ``rule_files`` name the files in which repositories keep rules of their own, and ``ignore_limit`` says up to how
    many bytes the .gitignore patterns of all repositories are broadcast."""

    exclude: tuple[str, ...] = ()
    scanners: tuple[str, ...] | None = None
    fail_on: str = "high"
    engines: tuple[str, ...] = ()
    rules: tuple[custom.CustomRule, ...] = ()
    rule_files: tuple[str, ...] = ()
    marker: str = post.MARKER
    ignore_limit: int = BROADCAST_LIMIT

    @classmethod
    def from_table(cls, table: Mapping[str, object], **overrides) -> tuple[Options, list[str]]:
        """Options from a configuration table, and warnings about unknown keys; overrides replace."""
        known = {"exclude", "scanners", "fail_on", "engines", "rules"}
        warnings = [f"ignoring unknown key: {key}" for key in sorted(set(table) - known)]
        values: dict[str, object] = {}
        for key in ("exclude", "scanners", "engines"):
            if key in table:
                value = table[key]
                if not isinstance(value, (list, tuple)) or not all(isinstance(x, str) for x in value):
                    raise ValueError(f"{key} must be an array of strings")
                values[key] = tuple(value)
        if values.get("scanners") == ():
            raise ValueError("scanners must name at least one scanner")
        if "fail_on" in table:
            level = table["fail_on"]
            if not isinstance(level, str) or level.lower() not in {*(s.lower() for s in schemas.SEVERITIES), "never"}:
                raise ValueError("fail_on must be one of: critical, high, medium, low, never")
            values["fail_on"] = level.lower()
        if "rules" in table:
            if not isinstance(table["rules"], (list, tuple)) or not all(isinstance(x, str) for x in table["rules"]):
                raise ValueError("rules must be an array of file paths")
            values["rule_files"] = tuple(table["rules"])
        values.update({key: value for key, value in overrides.items() if value is not None})
        return cls(**values), warnings


# Scanners registered by users: name -> plan over files. Built-in ones keep their order.
_extra: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register_scanner(name: str, scan: Callable[[DataFrame], DataFrame]) -> None:
    """Register a scanner: a function from ``files`` to findings columns."""
    _extra[name] = scan


def file_scanner(name: str, scan_file: Callable[[str, str], list[dict]], suffixes: Sequence[str] | None = None):
    """A scanner from a per-file function ``(path, content) -> [finding fields]``, Arrow-batched."""
    fields = "line int, severity string, title string, description string, snippet string, fix_phase int, fix_summary string"
    names = [part.strip().split(" ")[0] for part in fields.split(",")]
    fill = {"snippet": "", "fix_phase": 1, "fix_summary": "", "description": ""}

    def scan(files: DataFrame) -> DataFrame:
        def batches(frames):
            for frame in frames:
                rows = []
                for repo, path, seq, content in frame.itertuples(index=False):
                    for nth, hit in enumerate(scan_file(path, content)):
                        rows.append([repo, path, seq, nth, *[hit.get(n, fill.get(n)) for n in names]])
                yield pd.DataFrame(rows, columns=["repo", "file", "file_seq", "nth", *names])

        scope = files if suffixes is None else files.where(X.suffix_of(F.col("path")).isin(*suffixes))
        found = scope.select("repo", "path", "file_seq", "content").mapInPandas(
            batches, f"repo string, file string, file_seq bigint, nth int, {fields}"
        )
        order = len(schemas.SCANNERS)
        return schemas.as_findings(
            found.withColumns(
                {"scanner": F.lit(name), "emit_seq": schemas.emit_seq(order, F.col("file_seq"), 0, F.col("nth"))}
            )
        )

    return scan


def scanner_names() -> list[str]:
    return [*schemas.SCANNERS, *_extra]


def chosen_scanners(only: Sequence[str] | None) -> list[str]:
    """Names to run, in registration order; an unknown name is an error."""
    names = scanner_names()
    if only is None:
        return names
    unknown = sorted(set(only) - set(names))
    if unknown:
        raise ValueError(f"unknown scanner(s): {', '.join(unknown)}. Available: {', '.join(sorted(names))}")
    return [name for name in names if name in set(only)]


def by_file(options: Options) -> bool:
    """Whether what the scanners find in a file's contents depends on that file and the settings alone: no scanner of
    a user's runs, and no repository has rules of its own."""
    names = chosen_scanners(options.scanners)
    return not any(name in _extra for name in names) and not ("custom" in names and options.rule_files)


def pass_settings(options: Options) -> str:
    """A digest of all settings that the rows of the shared pass depend on."""
    names = [name for name in chosen_scanners(options.scanners) if name in file_pass.SCANNERS]
    return hashlib.sha256(repr((names, options.rules if "custom" in names else ())).encode()).hexdigest()


def pass_rows(files: DataFrame, options: Options) -> DataFrame:
    """Rows of the shared pass over ``files`` as a scan of whole repositories reads them, CSRF signals among them."""
    names = chosen_scanners(options.scanners)
    return file_pass.findings(files, names, options.rules, signals="headers" in names)


def native_findings(
    special: DataFrame,
    selected: select.Selection,
    options: Options,
    advisories: DataFrame | None = None,
    touched: DataFrame | None = None,
    file_rows: Callable[[select.Selection], DataFrame] | None = None,
) -> DataFrame:
    """Findings of the chosen scanners, materialized once; only their branches are in the plan.

    All per-file scanners share one pass over ``touched`` (by default all selected files). The pass
    also carries the CSRF signals, so the per-repository check reads its rows and not the contents.
    ``file_rows`` may give the rows of that pass where the caller keeps them (``by_file`` must hold).
    """
    names = chosen_scanners(options.scanners)
    per_file = selected.files if touched is None else touched
    whole = "headers" in names and touched is None
    if file_rows is not None:
        found = file_rows(selected)
    else:
        rows = pass_rows(per_file, options) if whole else file_pass.findings(per_file, names, options.rules)
        parts = [rows, *[_extra[name](per_file) for name in names if name in _extra]]
        if "custom" in names and options.rule_files:
            accepted, _ = rules.repo_rules(special, options.rule_files)
            parts.append(rules.repo_findings(per_file, accepted))
        # Findings are small next to the contents they came from, and they are read several times below.
        found = selected.rows(cut_lineage(reduce(lambda a, b: a.unionByName(b), parts)))
    if whole:
        found = found.where(~headers.is_signal()).unionByName(headers.csrf_findings(headers.signals_of(found)))
    if "deps" in names and advisories is not None:
        # Written once like the others: what follows reads the findings more than once.
        found = found.unionByName(cut_lineage(deps.findings(special, selected.paths(), advisories)))
    return found


def scan(
    files: DataFrame,
    options: Options = Options(),
    advisories: DataFrame | None = None,
    engine_reports: Mapping[str, DataFrame] | None = None,
    verdicts: DataFrame | None = None,
    known: DataFrame | None = None,
    file_rows: Callable[[select.Selection], DataFrame] | None = None,
) -> DataFrame:
    """Findings of all repositories in ``files``, one row per distinct finding.

    Order them with ``post.sort``; the rows carry their order in ``emit_seq``. The contents are read
    twice: once for the few special files, once for the scan. With ``file_rows`` (see ``native_findings``) and no
    reports, only the contents of special files are read.
    """
    special = cut_lineage(manifests.special_files(files, options.rule_files))
    selected = select.Selection(files, options.exclude, special, options.ignore_limit)
    found = native_findings(special, selected, options, advisories, file_rows=file_rows)
    readers = reports.engines(options.engines)
    reported = [reader(engine_reports[name]) for name, reader in readers.items() if engine_reports and name in engine_reports]
    if reported:
        merged = reduce(lambda a, b: a.unionByName(b), reported)
        found = post.merge_engines(found, post.attach_line_text(merged, files).select(*found.columns))
    found = post.suppress(found, options.marker)
    if verdicts is not None:
        found = post.apply_verdicts(found, verdicts)
    found = post.dedupe(found)
    return found if known is None else baseline.filter_known(found, known)


def scan_diff(files: DataFrame, changed: DataFrame, options: Options = Options(), advisories: DataFrame | None = None) -> DataFrame:
    """Findings on changed lines. The per-file scanners read changed files only; the project-level
    check is left out, since its finding would be dropped."""
    special = cut_lineage(manifests.special_files(files, options.rule_files))
    selected = select.Selection(files, options.exclude, special, options.ignore_limit)
    touched = history.only_changed_files(selected.files, changed)
    found = native_findings(special, selected, options, advisories, touched)
    return history.on_changed_lines(post.dedupe(post.suppress(found, options.marker)), changed)
