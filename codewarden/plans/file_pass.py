"""One pass over the files for all per-file scanners.

File contents are by far the largest column, so they are read once: every scanner adds its columns to
the same projection chain, and one ``explode`` turns the hits of all of them into rows. The pass has
no shuffle; texts of the rules come from a broadcast of a fixed small table at the end.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cache, reduce
from itertools import zip_longest

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codewarden import schemas
from codewarden.functions import matching as M
from codewarden.functions import text as X
from codewarden.functions.sizes import BROADCAST_LIMIT
from codewarden.operators import custom, headers, injection, secrets
from codewarden.rules import headers as header_texts
from codewarden.rules import taint as T

SCANNERS = ("custom", "headers", "injection", "secrets")
_MODULES = {"headers": headers, "injection": injection, "secrets": secrets}


def _scanner(name: str) -> int:
    return schemas.SCANNERS.index(name)


def scan_columns(
    files: DataFrame,
    scanners: Sequence[str] = SCANNERS,
    rules: Sequence[custom.CustomRule] = (),
    signals: bool = False,
) -> DataFrame:
    """``files`` plus the columns of the chosen scanners (and the CSRF signals, on request)."""
    modules = [_MODULES[name] for name in SCANNERS if name in scanners and name in _MODULES]
    text = M.fold_case(F.col("content"))
    only_code = secrets not in modules and not signals
    before = [module.before_lines() for module in modules]
    wanted = [module.wants_lines() for module in modules]
    if "custom" in scanners and rules:
        before.append(custom.before_lines(rules))
        wanted.append(custom.wants_lines())
    after = [module.after_lines() for module in modules] + ([[headers.signal_step()]] if signals else [])
    levels = [
        {"_suffix": X.suffix_of(F.col("path"))},
        {"_code": F.col("_suffix").isin(*T.CODE_SUFFIXES)},
        {"_low": F.when(F.col("_code"), text) if only_code else text},
        *_merged(before),
        {"_lines": F.when(reduce(lambda a, b: a | b, wanted, F.lit(False)), X.split_lines(F.col("content")))},
        *_merged(after),
    ]
    for level in levels:
        files = files.withColumns(level)
    return files


def _merged(parts: list[list[dict[str, Column]]]) -> list[dict[str, Column]]:
    """Levels of several scanners side by side: columns of one level need only earlier levels."""
    return [reduce(lambda a, b: a | b, [level or {} for level in row]) for row in zip_longest(*parts)]


@cache
def _emitted(names: tuple[str, ...], signals: bool) -> Column:
    """Hits of all scanners as rows. The exploded value is an expression, not a bare column: from a
    bare column a filter on its size is derived and pushed below the pass, which would run it twice."""

    def tagged(name: str) -> Column:
        module = custom if name == "custom" else _MODULES[name]
        order = _scanner(name)

        def row(h: Column) -> Column:
            snippet = X.snippet_at(F.col("_lines"), h["line"])
            if name == "headers":
                helmet = headers.placeholder(F.col("path"), header_texts.HELMET_PLACEHOLDER)
                snippet = F.when(h["rule"] == headers.CHECKS.index("helmet"), helmet).otherwise(snippet)
            return F.struct(
                h["rule"].alias("rule"),
                F.lit(order).alias("scanner_no"),
                h["line"].alias("line"),
                h["part"].alias("part"),
                h["a"].alias("a"),
                h["b"].alias("b"),
                h["c"].alias("c"),
                h["reachable"].alias("reachable"),
                snippet.alias("snippet"),
                X.line_at(F.col("_lines"), h["line"]).alias("line_text"),
            )

        hits = F.concat(F.col(module.HITS), headers.signal_hits()) if signals and name == "headers" else F.col(module.HITS)
        return F.transform(hits, row)

    return F.explode(F.concat(*[tagged(name) for name in names])).alias("x")


def rule_texts(spark, scanners: Sequence[str], rules: Sequence[custom.CustomRule] = ()) -> DataFrame:
    """The rule dimension: a few dozen fixed rows, and the user's own rules. Broadcast up to the limit of all broadcasts."""
    rows = []
    for name in scanners:
        found = custom.rule_rows(rules) if name == "custom" else _MODULES[name].rule_rows()
        rows += [(_scanner(name), number, name, *texts) for number, *texts in found]
    texts = spark.createDataFrame(
        rows,
        "scanner_no int, rule int, scanner string, title string, severity string, fix_phase int, description string, fix_summary string",
    )
    size = sum(len(str(value)) for row in rows for value in row)  # rules are settings, so this is no job
    return F.broadcast(texts) if size <= BROADCAST_LIMIT else texts


def findings(
    files: DataFrame,
    scanners: Sequence[str] = SCANNERS,
    rules: Sequence[custom.CustomRule] = (),
    keep: Sequence[str] = (),
    signals: bool = False,
) -> DataFrame:
    """Findings of the chosen per-file scanners; columns named in ``keep`` are carried through.

    With ``signals``, rows of the signal rule are among them (``headers.signals_of`` reads them).
    """
    names = tuple(name for name in SCANNERS if name in scanners and (name != "custom" or rules))
    if not names:
        return files.sparkSession.createDataFrame([], schemas.FINDINGS)
    rows = (
        scan_columns(files, names, rules, signals)
        .select("repo", "path", "file_seq", *keep, _emitted(names, signals))
        .select("repo", "path", "file_seq", *keep, "x.*")
        .join(rule_texts(files.sparkSession, names, rules), ["scanner_no", "rule"])
        .withColumnRenamed("path", "file")
        .withColumn(
            "emit_seq",
            schemas.emit_seq(F.col("scanner_no"), F.col("file_seq"), F.col("part"), F.col("a"), F.col("b"), F.col("c")),
        )
    )
    return schemas.as_findings(rows, keep)
