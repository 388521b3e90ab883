"""Report documents as ordered rows.

A repository's document can hold a third of all findings, so it is never collected into one value.
Each report is a table ``(repo, seq, text)``: one row per header, block or footer, numbered in
document order. ``write_documents`` range-partitions the rows, so a large document is written by many
tasks as consecutive parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codewarden.functions import text as X
from codewarden.functions.ordering import range_rank
from codewarden.functions.severity import severity_rank
from codewarden.functions.text import lookup
from codewarden.operators import post
from codewarden.session import cut_lineage

TOOL = "codewarden"
VERSION = "0.1.0"
_END = (1 << 62) - 1

# Fallback references, badges, SARIF levels and scores, diagnostics ranks.
DEFAULT_REFERENCES = {
    "secrets": "https://owasp.org/www-community/vulnerabilities/Use_of_hard-coded_password",
    "injection": "https://owasp.org/www-community/Injection_Flaws",
    "headers": "https://owasp.org/www-project-secure-headers/",
    "deps": "https://owasp.org/www-community/vulnerabilities/Using_Components_with_Known_Vulnerabilities",
}
BADGES = {"CRITICAL": "🔴", "HIGH": "🟠", "MEDIUM": "🟡", "LOW": "🔵"}
SARIF_LEVELS = {"CRITICAL": "error", "HIGH": "error", "MEDIUM": "warning", "LOW": "note"}
SARIF_SCORES = {"CRITICAL": "9.5", "HIGH": "8.0", "MEDIUM": "5.5", "LOW": "3.0"}
DIAGNOSTIC_RANK = {"CRITICAL": 0, "HIGH": 0, "MEDIUM": 1, "LOW": 2}
PHASES = (
    (1, "Secrets, env vars, dependency bumps", "Zero"),
    (2, "Security headers, CORS, rate limits", "Low"),
    (3, "Auth & session fixes", "Medium"),
    (4, "Injection & data layer", "Medium-high"),
    (5, "Architecture changes", "High"),
)
SARIF_SCHEMA = "https://raw.githubusercontent.com/oasis-tcs/sarif-spec/master/Schemata/sarif-schema-2.1.0.json"


def references_of(references: Column, scanner: Column) -> Column:
    """The finding's own references, else the scanner's fallback, else none."""
    fallback = lookup(scanner, DEFAULT_REFERENCES, "")
    return (
        F.when(F.size(references) > 0, references)
        .when(fallback != "", F.array(fallback))
        .otherwise(F.array().cast("array<string>"))
    )


def badge(severity: Column) -> Column:
    return lookup(severity, BADGES, "⚪")


def numbered(findings: DataFrame) -> DataFrame:
    """Adds ``seq``, the 1-based position of a finding in its repository's sorted report."""
    order = [severity_rank(F.col("severity")), post.emission(), F.col("line"), F.col("title")]
    return range_rank(findings, ["repo"], order, "seq")


def finding_json(root: str = "") -> Column:
    """One finding in the machine-readable layout (renamed fields, nulls kept)."""
    file = F.col("file")
    if root:
        prefix = root.rstrip("/") + "/"
        file = F.when(file.startswith(prefix), F.substr(file, F.lit(len(prefix) + 1))).otherwise(file)
    body = F.struct(
        X.finding_id(F.col("scanner"), F.col("title")).alias("id"),
        "scanner",
        file.alias("file"),
        "line",
        "severity",
        "fix_phase",
        F.col("snippet").alias("code_snippet"),
        "title",
        F.col("description").alias("explanation"),
        F.col("fix_summary").alias("fix_guidance"),
        references_of(F.col("references"), F.col("scanner")).alias("references"),
        "reachable",
    )
    return F.to_json(body, {"ignoreNullFields": "false"})


def _files_scanned(df: DataFrame, files_scanned: DataFrame | None) -> DataFrame:
    if files_scanned is None:
        return df.withColumn("files_scanned", F.lit(None).cast("bigint"))
    return df.join(files_scanned, "repo", "left")


def _everyone(counts: DataFrame, repos: DataFrame | None) -> DataFrame:
    """Counts per repository, with zeros for those of ``repos`` that have no findings."""
    if repos is None:
        return counts
    every = repos.select("repo").unionByName(counts.select("repo")).distinct()
    return every.join(counts, "repo", "left").na.fill(0)


def json_document(
    findings: DataFrame, files_scanned: DataFrame | None = None, root: str = "", repos: DataFrame | None = None
) -> DataFrame:
    """JSON report: a head row, one row per finding, a tail row; texts joined in order are the document.

    ``repos`` names the repositories that get a document; those without findings get an empty one.
    """
    findings = cut_lineage(findings)  # the order and the counts read them
    sorted_rows = numbered(findings)
    counts = findings.groupBy("repo").agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("severity") == s).alias(s) for s in BADGES],
    )
    counts = _everyone(counts, repos)
    present = F.to_json(F.struct(*[F.when(F.col(s) > 0, F.col(s)).alias(s) for s in BADGES]))
    head = _files_scanned(counts, files_scanned).select(
        "repo",
        F.lit(0).cast("bigint").alias("seq"),
        F.concat(
            F.lit(f'{{"tool":"{TOOL}","version":"{VERSION}","project":'),
            F.regexp_replace(F.to_json(F.array("repo")), r"^\[|\]$", ""),
            F.lit(',"files_scanned":'),
            F.coalesce(F.col("files_scanned").cast("string"), F.lit("null")),
            F.lit(',"total_issues":'),
            F.col("total").cast("string"),
            F.lit(',"severity_counts":'),
            present,
            F.lit(',"findings":['),
        ).alias("text"),
    )
    comma = F.when(F.col("seq") > 1, F.lit(",")).otherwise(F.lit(""))
    body = sorted_rows.select("repo", "seq", F.concat(comma, finding_json(root)).alias("text"))
    tail = counts.select("repo", F.lit(_END).cast("bigint").alias("seq"), F.lit("]}").alias("text"))
    return head.unionByName(body).unionByName(tail)


def sarif_rules(findings: DataFrame) -> DataFrame:
    """Distinct rules of each repository with their index in first-seen order."""
    keyed = findings.withColumn("rule_id", X.finding_id(F.col("scanner"), F.col("title")))
    seen = F.struct(severity_rank(F.col("severity")).alias("r"), post.emission().alias("s"), F.col("line").alias("l"))
    first = keyed.groupBy("repo", "rule_id").agg(
        F.min(seen).alias("seen"),
        F.min_by(F.struct("title", "description", "severity", "fix_summary", "references", "scanner"), seen).alias("f"),
    )
    ranked = range_rank(first, ["repo"], [F.col("seen"), F.col("rule_id")], "n")
    return ranked.select("repo", "rule_id", (F.col("n") - 1).cast("int").alias("rule_index"), "f.*")


def _sarif_rule() -> Column:
    refs = references_of(F.col("references"), F.col("scanner"))
    return F.to_json(
        F.struct(
            F.col("rule_id").alias("id"),
            F.col("title").alias("name"),
            F.struct(F.col("title").alias("text")).alias("shortDescription"),
            F.struct(F.col("description").alias("text")).alias("fullDescription"),
            F.struct(lookup(F.col("severity"), SARIF_LEVELS, "warning").alias("level")).alias("defaultConfiguration"),
            F.struct(
                F.array(F.lit("security")).alias("tags"),
                lookup(F.col("severity"), SARIF_SCORES, "5.5").alias("security-severity"),
            ).alias("properties"),
            F.when(F.col("fix_summary") != "", F.struct(F.col("fix_summary").alias("text"))).alias("help"),
            F.get(refs, 0).alias("helpUri"),
        )
    )


def _sarif_result() -> Column:
    place = F.struct(
        F.struct(
            F.struct(F.col("file").alias("uri"), F.lit("%SRCROOT%").alias("uriBaseId")).alias("artifactLocation"),
            F.struct(F.greatest(F.lit(1), F.col("line")).alias("startLine")).alias("region"),
        ).alias("physicalLocation")
    )
    return F.to_json(
        F.struct(
            F.col("rule_id").alias("ruleId"),
            F.col("rule_index").alias("ruleIndex"),
            lookup(F.col("severity"), SARIF_LEVELS, "warning").alias("level"),
            F.struct(F.concat("title", F.lit(": "), "description").alias("text")).alias("message"),
            F.array(place).alias("locations"),
        )
    )


def sarif_results(findings: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """(repo, seq, rule_id, rule_index, result): SARIF result objects in report order."""
    rules = (sarif_rules(findings) if rules is None else rules).select("repo", "rule_id", "rule_index")
    rows = numbered(findings).withColumn("rule_id", X.finding_id(F.col("scanner"), F.col("title")))
    return rows.join(rules, ["repo", "rule_id"]).select("repo", "seq", "rule_id", "rule_index", _sarif_result().alias("result"))


def sarif_document(findings: DataFrame, files_scanned: DataFrame | None = None, repos: DataFrame | None = None) -> DataFrame:
    """SARIF 2.1.0 log: head, rule rows, separator, result rows, tail; ``repos`` as in ``json_document``."""
    rules = sarif_rules(findings)
    results = sarif_results(findings, rules)
    named = findings.select("repo") if repos is None else findings.select("repo").unionByName(repos.select("repo"))
    repos = _files_scanned(named.distinct(), files_scanned)
    driver = f'{{"$schema":"{SARIF_SCHEMA}","version":"2.1.0","runs":[{{"tool":{{"driver":{{"name":"{TOOL}","version":"{VERSION}","rules":['
    properties = F.coalesce(
        F.concat(F.lit(',"properties":{"filesScanned":'), F.col("files_scanned").cast("string"), F.lit("}")), F.lit("")
    )
    # Sections get their own ranges of seq: rules below, results above the separator.
    shift = 1 << 40
    comma = lambda first: F.when(first, F.lit("")).otherwise(F.lit(","))
    at = lambda value: F.lit(value).cast("bigint").alias("seq")
    parts = [
        repos.select("repo", at(-1), F.lit(driver).alias("text")),
        rules.select(
            "repo", F.col("rule_index").cast("bigint").alias("seq"), F.concat(comma(F.col("rule_index") == 0), _sarif_rule()).alias("text")
        ),
        repos.select("repo", at(shift), F.lit(']}},"results":[').alias("text")),
        results.select("repo", (F.col("seq") + shift).alias("seq"), F.concat(comma(F.col("seq") == 1), "result").alias("text")),
        repos.select("repo", at(_END), F.concat(F.lit("]"), properties, F.lit("}]}")).alias("text")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _line(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def markdown_document(
    findings: DataFrame,
    files_scanned: DataFrame | None = None,
    scan_date: str | None = None,
    repos: DataFrame | None = None,
) -> DataFrame:
    """Markdown report: a head row with summary and counts, one block per finding, a closing row.

    ``repos`` as in ``json_document``.
    """
    n = lambda name: F.col(name).cast("string")
    date = F.lit(scan_date) if scan_date else F.concat(F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd HH:mm"), F.lit(" UTC"))
    phases = findings.groupBy("repo").agg(*[F.count_if(F.col("fix_phase") == p).alias(f"phase{p}") for p, _, _ in PHASES])
    totals = _everyone(post.severity_counts(findings).join(phases, "repo"), repos)
    counts = _files_scanned(post.headline(totals), files_scanned)
    phase_rows = [_line(f"| {p} | {what} | {risk} | ", n(f"phase{p}"), " |\n") for p, what, risk in PHASES]
    head = counts.select(
        "repo",
        F.lit(0).cast("bigint").alias("seq"),
        _line(
            "# Security Report — ", F.col("repo"), "\n\n**Scanned:** ", date,
            "\n**Files scanned:** ", F.coalesce(n("files_scanned"), F.lit("—")),
            "\n**Total issues:** ", n("total"), "\n\n---\n\n## Executive Summary\n\n", F.col("headline"), "\n\n",
            "| Severity | Count |\n|----------|-------|\n| 🔴 Critical | ", n("critical"),
            " |\n| 🟠 High | ", n("high"), " |\n| 🟡 Medium | ", n("medium"), " |\n| 🔵 Low | ", n("low"), " |\n\n---\n\n",
            "## Fix Plan (Phased)\n\n| Phase | What | Risk | Issues |\n|-------|------|------|--------|\n",
            *phase_rows,
            "\n**How to apply:** Turn the issues below into fix prompts with the prompt report. "
            "Start with Phase 1 — those fixes are zero-risk.\n\n---\n\n## Issues\n\n",
        ).alias("text"),
    )
    reach = (
        F.when(F.col("reachable"), F.lit(" | ⚡ **Reachable from untrusted input**"))
        .when(~F.col("reachable"), F.lit(" | 🧊 Not fed by untrusted input (this file)"))
        .otherwise(F.lit(""))
    )
    code = F.when(F.col("snippet") != "", _line("```\n", F.col("snippet"), "\n```\n\n")).otherwise(F.lit(""))
    body = numbered(findings).select(
        "repo",
        "seq",
        _line(
            "### ", n("seq"), ". ", badge(F.col("severity")), " ", F.col("title"),
            "\n\n**File:** `", F.col("file"), ":", n("line"), "`\n**Phase:** ", n("fix_phase"), " | **Scanner:** ",
            F.col("scanner"), reach, "\n\n", F.col("description"), "\n\n", code, "**Fix:** ", F.col("fix_summary"), "\n\n---\n\n",
        ).alias("text"),
    )
    tail = counts.select(
        "repo",
        F.lit(_END).cast("bigint").alias("seq"),
        F.lit(
            "## Next Steps\n\n1. Review this report\n2. Write the prompt report for ready-to-paste fix prompts "
            "(start with Phase 1 — zero-risk)\n3. Apply the fixes\n4. Test your app\n"
            "5. Scan again to verify the issues are gone\n"
        ).alias("text"),
    )
    return head.unionByName(body).unionByName(tail)


# Fixed value: the closing instructions of a prompt.
_PROMPT_TAIL = """

Please:
1. Apply the fix to this specific file, matching my existing code style and conventions.
2. Search the rest of my codebase for the same class of issue and fix those too.
3. If this fix needs supporting changes (e.g. a new env var, a .gitignore entry,
   a config update), make those changes and tell me what you changed.
4. Do not introduce new dependencies unless strictly necessary; if you do, explain why.
"""


def fix_prompt() -> Column:
    """Self-contained prompt of one finding."""
    return _line(
        "I have a security vulnerability in my code. Please fix it.\n\nFILE: ", F.col("file"),
        "\nLINE: ", F.col("line").cast("string"), "\nISSUE: ", F.col("title"),
        "\n\nTHE CODE:\n```", X.language_of(F.col("file")), "\n",
        F.when(F.col("snippet") == "", F.lit("(snippet unavailable)")).otherwise(F.col("snippet")),
        "\n```\n\nWHY IT'S DANGEROUS:\n", F.col("description"), "\n\nWHAT TO DO:\n", F.col("fix_summary"), _PROMPT_TAIL,
    )


def prompt_document(findings: DataFrame, repos: DataFrame | None = None) -> DataFrame:
    """Fix-prompt document: a head row, then one prompt per finding."""
    title = f"# {TOOL} — AI Fix Prompts\n\nPaste each block below into your AI assistant. Each prompt is self-contained.\n"
    body = numbered(findings).select(
        "repo",
        "seq",
        _line(
            F.when(F.col("seq") > 1, F.lit("\n\n---\n\n")).otherwise(F.lit("\n---\n\n")),
            "## ", F.col("seq").cast("string"), ". ", badge(F.col("severity")), " ", F.col("severity"), " — ", F.col("title"),
            "\n\n", fix_prompt(),
        ).alias("text"),
    )
    everyone = findings.select("repo").distinct() if repos is None else repos.select("repo").distinct()
    some = findings.select("repo").distinct().withColumn("_some", F.lit(True))
    head = everyone.join(some, "repo", "left").select(
        "repo",
        F.lit(0).cast("bigint").alias("seq"),
        F.when(F.col("_some"), F.lit(title))
        .otherwise(F.lit(title + "\nNo vulnerabilities found. Nothing to fix.\n"))
        .alias("text"),
    )
    return head.unionByName(body)


def by_file(diagnostics: DataFrame) -> DataFrame:
    """Diagnostics grouped by file: ranged and sorted by path, with each one's number in its file.

    A file's rows follow each other in one range of the output; no file is collected into one value.
    """
    order = [F.col("line"), F.col("severity"), F.col("message"), F.col("code")]
    ranked = range_rank(diagnostics, ["repo", "path"], order, "nth")
    return ranked.repartitionByRange("repo", "path", "nth").sortWithinPartitions("repo", "path", "nth")


def diagnostics(findings: DataFrame, scan_root: str, single_file: str | None = None) -> DataFrame:
    """Editor diagnostics: 0-based line, rank, message; findings without a real location are dropped.

    ``by_file`` groups them.
    """
    file = F.col("file")
    absolute = F.contains(file, F.lit(":")) | file.startswith("/")
    separator = "\\" if "\\" in scan_root else "/"
    path = F.lit(single_file) if single_file else F.when(absolute, file).otherwise(F.concat(F.lit(scan_root + separator), file))
    kept = findings if single_file else findings.where(~file.isin(".", ""))
    tag = F.when(F.col("reachable"), F.lit(" [reachable from user input]")).otherwise(F.lit(""))
    return kept.select(
        "repo",
        path.alias("path"),
        F.greatest(F.lit(0), F.col("line") - 1).alias("line"),
        lookup(F.col("severity"), DIAGNOSTIC_RANK, 1).alias("severity"),
        F.concat("title", tag, F.lit(" — "), "description").alias("message"),
        X.finding_id(F.col("scanner"), F.col("title")).alias("code"),
    )


def write_documents(document: DataFrame, path: str) -> None:
    """Write document rows as text parts per repository, in order, many tasks per large repository.

    Row groups never wait for a whole document: rows are range-partitioned by (repo, seq), and the
    part files of a repository, read in name order, are its document.
    """
    ordered = document.repartitionByRange("repo", "seq").sortWithinPartitions("repo", "seq")
    ordered.select("repo", "text").write.mode("overwrite").partitionBy("repo").option("lineSep", "\n").text(path)
