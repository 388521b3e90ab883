"""Readers of other scanners' reports, held as JSON text in a table ``(repo, doc, json)``.

Documents are read as VARIANT: a field of an unexpected type is simply not there, so a malformed
result never loses its neighbours.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codewarden import schemas
from codewarden.functions.text import lookup, strip
from codewarden.session import cut_lineage

# Severity names and score bands of the report formats.
SEMGREP_SEVERITY = {
    "CRITICAL": "CRITICAL",
    "ERROR": "HIGH",
    "HIGH": "HIGH",
    "WARNING": "MEDIUM",
    "MEDIUM": "MEDIUM",
    "INFO": "LOW",
    "LOW": "LOW",
}
SARIF_BANDS = ((9.0, "CRITICAL"), (7.0, "HIGH"), (4.0, "MEDIUM"))
SARIF_LEVELS = {"error": "HIGH", "warning": "MEDIUM", "note": "LOW"}


def kind(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit("VOID"))


def field(value: Column, path: str) -> Column:
    return F.try_variant_get(value, f"$.{path}", "variant")


def text(value: Column, path: str) -> Column:
    """String at a path, NULL when absent or of another type."""
    found = field(value, path)
    return F.when(kind(found) == "STRING", F.try_variant_get(value, f"$.{path}", "string"))


def integer(value: Column, path: str) -> Column:
    found = field(value, path)
    return F.when(kind(found) == "BIGINT", F.try_variant_get(value, f"$.{path}", "bigint"))


def truthy(value: Column) -> Column:
    """Present and neither null, false, zero, nor empty."""
    body = F.to_json(value)
    return F.coalesce(value.isNotNull() & ~body.isin("null", "false", "0", "0.0", '""', "[]", "{}"), F.lit(False))


def elements(value: Column, path: str = "") -> Column:
    """array<variant> of the JSON array at a path, empty for anything else."""
    at = f"$.{path}" if path else "$"
    return F.coalesce(F.try_variant_get(value, at, "array<variant>"), F.array().cast("array<variant>"))


def is_object(value: Column) -> Column:
    """Whether a value is a JSON object. Nothing of it is read: its schema would be all of it, at every level anew."""
    return F.try_variant_get(value, "$", "struct<>").isNotNull()


def objects(value: Column, path: str = "") -> Column:
    return F.filter(elements(value, path), is_object)


def normal_path(path: Column) -> Column:
    """Path without empty or `.` parts; '.' when nothing is left."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    joined = F.concat(F.when(F.startswith(path, F.lit("/")), F.lit("/")).otherwise(F.lit("")), F.array_join(parts, "/"))
    return F.when(joined == "", F.lit(".")).otherwise(joined)


def documents(reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(parsed, rejected): documents that are JSON objects, and the others with a reason."""
    parsed = reports.withColumn("_v", F.try_parse_json("json"))
    good = is_object(F.col("_v"))
    reason = F.when(F.col("_v").isNull(), F.lit("invalid JSON")).otherwise(F.lit("not an object"))
    return parsed.where(good), parsed.where(~good).select("repo", "doc", reason.alias("reason"))


def semgrep(reports: DataFrame) -> DataFrame:
    """Findings of semgrep JSON reports."""
    # What is no JSON object has no array there; a filter on the parsed value would parse it a second time.
    rows = reports.select("repo", "doc", F.posexplode(objects(F.try_parse_json("json"), "results")).alias("nth", "r"))
    r = F.col("r")
    rule = F.coalesce(F.when(text(r, "check_id") != "", text(r, "check_id")), F.lit("semgrep-rule"))
    line = integer(r, "start.line")
    message = strip(F.coalesce(text(r, "extra.message"), F.lit("")))
    refs = F.transform(
        F.filter(elements(r, "extra.metadata.references"), lambda e: kind(e) == "STRING"),
        lambda e: F.try_variant_get(e, "$", "string"),
    )
    return schemas.as_findings(
        rows.select(
            "repo",
            normal_path(F.coalesce(text(r, "path"), F.lit(""))).alias("file"),
            F.when(line > 0, line).otherwise(F.lit(1)).cast("int").alias("line"),
            lookup(F.upper(F.coalesce(text(r, "extra.severity"), F.lit(""))), SEMGREP_SEVERITY, "MEDIUM").alias("severity"),
            F.substring_index(rule, ".", -1).alias("title"),
            F.when(message != "", message).otherwise(F.concat(F.lit("Semgrep rule "), rule, F.lit(" matched."))).alias("description"),
            F.lit("semgrep").alias("scanner"),
            strip(F.coalesce(text(r, "extra.lines"), F.lit(""))).alias("snippet"),
            F.when(truthy(field(r, "extra.fix")), F.lit(1)).otherwise(F.lit(3)).alias("fix_phase"),
            F.concat(F.lit("See semgrep rule "), rule, F.lit(".")).alias("fix_summary"),
            refs.alias("references"),
            schemas.emit_seq(len(schemas.SCANNERS) + 1, F.col("doc"), 0, F.col("nth")).alias("emit_seq"),
        )
    )


def _score_severity(score: Column, level: Column) -> Column:
    out = F
    for floor, label in SARIF_BANDS:
        out = out.when(score >= floor, F.lit(label))
    banded = out.otherwise(F.lit("LOW"))
    usable = score.isNotNull() & ~F.isnan(score)
    return F.when(usable, banded).otherwise(lookup(F.lower(F.coalesce(level, F.lit(""))), SARIF_LEVELS, "MEDIUM"))


def sarif_rows(reports: DataFrame) -> DataFrame:
    """Rules and results of SARIF reports as rows of one table: repo, doc, run, nth, is_rule, rule_id and their fields.

    The arrays are cut into rows first, and fields are read from these, in compiled code: inside an array function each
    would be interpreted, element by element.
    """
    # What is no JSON object has no array there; a filter on the parsed value would parse it a second time.
    runs = reports.select("repo", "doc", F.posexplode(objects(F.try_parse_json("json"), "runs")).alias("run", "r"))

    def entries(path: str, is_rule: bool) -> Column:
        return F.transform(objects(F.col("r"), path), lambda e, nth: F.struct(nth.alias("nth"), F.lit(is_rule).alias("is_rule"), e.alias("e")))

    rows = runs.select("repo", "doc", "run", F.inline(F.concat(entries("tool.driver.rules", True), entries("results", False))))
    e, physical = F.col("e"), "locations[0].physicalLocation"

    def of_rule(value: Column) -> Column:
        return F.when(F.col("is_rule"), value)

    def of_result(value: Column) -> Column:
        return F.when(~F.col("is_rule"), value)

    read = rows.select(
        "repo", "doc", "run", "nth", "is_rule",
        F.when(F.col("is_rule"), text(e, "id")).otherwise(text(e, "ruleId")).alias("id"),
        of_rule(F.try_variant_get(e, "$.properties['security-severity']", "string")).alias("score"),
        of_rule(text(e, "helpUri")).alias("help_uri"),
        of_result(text(e, "level")).alias("level"),
        of_result(text(e, "message.text")).alias("message"),
        of_result(text(e, f"{physical}.artifactLocation.uri")).alias("uri"),
        of_result(integer(e, f"{physical}.region.startLine")).alias("line"),
        of_result(text(e, f"{physical}.region.snippet.text")).alias("snippet"),
    )
    named = F.when(F.col("is_rule"), F.coalesce("id", F.lit("None"))).when(F.col("id") != "", F.col("id")).otherwise(F.lit("codeql-rule"))
    line = F.when(F.col("line") > 0, F.col("line")).otherwise(F.lit(1)).cast("int")
    empty = F.lit("")
    return read.select(
        "repo", "doc", "run", "nth", "is_rule", named.alias("rule_id"), "score", "help_uri", "level",
        of_result(strip(F.coalesce("message", empty))).alias("message"), of_result(F.coalesce("uri", empty)).alias("uri"),
        of_result(line).alias("line"), of_result(strip(F.coalesce("snippet", empty))).alias("snippet"),
    )


def sarif(reports: DataFrame, root: str = "") -> DataFrame:
    """Findings of SARIF reports; each result is joined to its rule inside its own run.

    A report is parsed once into rows of rules and results, which are written and split. Of a run's rules with one id
    the last holds; those that say something (a score, an address) are one row each, and a run with very many results
    or rules is no group: the join on (run, rule) is split where a rule is hot.
    """
    rows = cut_lineage(sarif_rows(reports))
    key = ["repo", "doc", "run", "rule_id"]
    last = rows.where("is_rule").groupBy(*key).agg(F.max_by(F.struct("score", "help_uri"), "nth").alias("r"))
    rules = last.select(*key, "r.*").where("score IS NOT NULL OR help_uri IS NOT NULL")
    found = rows.where("NOT is_rule").drop("score", "help_uri")
    named = rules.select(*[F.col(c).alias(f"_{c}") for c in key], "score", "help_uri")
    met = [found[c].eqNullSafe(named[f"_{c}"]) if c in ("repo", "doc") else found[c] == named[f"_{c}"] for c in key]
    joined = found.join(named, met, "left")
    rule_id, message, help_uri = F.col("rule_id"), F.col("message"), F.col("help_uri")
    prefix = F.lit(f"{root}/" if root else "")
    return schemas.as_findings(
        joined.select(
            "repo",
            F.when(F.col("uri") != "", F.concat(prefix, normal_path(F.col("uri")))).otherwise(F.lit(root or ".")).alias("file"),
            "line",
            _score_severity(F.col("score").try_cast("double"), F.col("level")).alias("severity"),
            rule_id.alias("title"),
            F.when(message != "", message).otherwise(F.concat(F.lit("CodeQL rule "), rule_id, F.lit(" matched."))).alias("description"),
            F.lit("codeql").alias("scanner"),
            "snippet",
            F.lit(3).alias("fix_phase"),
            F.concat(F.lit("See CodeQL rule "), rule_id, F.lit(".")).alias("fix_summary"),
            F.when(help_uri != "", F.array(help_uri)).otherwise(F.array().cast("array<string>")).alias("references"),
            schemas.emit_seq(len(schemas.SCANNERS), F.col("doc"), F.col("run"), F.col("nth")).alias("emit_seq"),
        )
    )


# Engines: name -> reader of that engine's report table, in registration order.
_engines: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register_engine(name: str, reader: Callable[[DataFrame], DataFrame]) -> None:
    _engines[name] = reader


def engines(only) -> dict[str, Callable[[DataFrame], DataFrame]]:
    """Readers of the named engines; an unknown name is an error."""
    unknown = sorted(set(only) - set(_engines))
    if unknown:
        raise ValueError(f"unknown engine(s): {', '.join(unknown)}. Available: {', '.join(sorted(_engines))}")
    return {name: reader for name, reader in _engines.items() if name in set(only)}


register_engine("codeql", sarif)
register_engine("semgrep", semgrep)
