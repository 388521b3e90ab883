"""Dependencies against advisories.

Advisories are a table in the shape of the public vulnerability format (``ADVISORIES_DDL``); its files
are read as they are published. Distinct (ecosystem, name, version) triples are matched first: a package
that a third of all projects pin is one row there. The matches are then joined back to the dependency
rows, by broadcast when they are measured small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codewarden import schemas
from codewarden.functions import text as X
from codewarden.functions import versions as V
from codewarden.functions.sizes import broadcast_if_small
from codewarden.functions.text import lookup
from codewarden.session import cut_lineage
from codewarden.sources import manifests as M

# The published advisory format, as far as it is read here.
ADVISORIES_DDL = (
    "id string, summary string, details string, database_specific struct<severity:string>, affected array<struct<"
    "package:struct<ecosystem:string,name:string>,versions:array<string>,"
    "ranges:array<struct<type:string,events:array<struct<introduced:string,fixed:string,last_affected:string>>>>>>"
)
# Fixed value: ranges of commits are no ranges of versions.
COMMIT_RANGE = "GIT"


def read_advisories(spark: SparkSession, path: str) -> DataFrame:
    """Published advisory files (one JSON object per file); unknown fields are ignored."""
    return spark.read.schema(ADVISORIES_DDL).option("multiLine", "true").json(path).where(F.col("id").isNotNull())


# Severity of an advisory's own label; anything else counts as HIGH.
LABELS = {"CRITICAL": "CRITICAL", "HIGH": "HIGH", "MODERATE": "MEDIUM", "MEDIUM": "MEDIUM", "LOW": "LOW"}
NO_DETAILS = "Known vulnerability (details unavailable)."
DEFAULT_SUMMARY = "Known vulnerability."


def severity_of(label: Column) -> Column:
    return lookup(F.upper(F.coalesce(label, F.lit(""))), LABELS, "HIGH")


def summary_of(summary: Column, details: Column) -> Column:
    """First line of the summary, else of the details, else a default."""
    filled = lambda c: F.when(c != "", c)
    text = X.strip(F.coalesce(filled(summary), filled(details), F.lit(DEFAULT_SUMMARY)))
    return F.when(text == "", F.lit(DEFAULT_SUMMARY)).otherwise(F.get(F.split(text, X.LINE_BREAK, 2), 0))


def _version_ranges(entry: Column) -> Column:
    return F.filter(F.coalesce(entry["ranges"], F.array()), lambda r: F.coalesce(r["type"], F.lit("")) != COMMIT_RANGE)


def first_fixed(affected: Column, ecosystem: Column, name: Column) -> Column:
    """First ``fixed`` version listed for the package, '' where there is none."""
    mine = F.filter(
        affected,
        lambda a: (a["package"]["ecosystem"] == ecosystem)
        & (V.canonical_name(a["package"]["name"], ecosystem) == V.canonical_name(name, ecosystem)),
    )
    events = F.flatten(F.transform(F.flatten(F.transform(mine, _version_ranges)), lambda r: r["events"]))
    fixed = F.filter(F.transform(events, lambda e: e["fixed"]), lambda v: v.isNotNull())
    return F.coalesce(F.get(fixed, 0), F.lit(""))


def in_range(version: Column, ecosystem: Column, events: Column) -> Column:
    """The latest event of one range at or before the version is an introduction."""
    key = V.version_key(version, ecosystem)
    from_start = F.exists(events, lambda e: e["introduced"] == "0")
    keys = lambda field: F.transform(
        F.filter(events, lambda e: e[field].isNotNull() & (e[field] != "0")), lambda e: V.version_key(e[field], ecosystem)
    )
    passed = lambda field: F.array_max(F.filter(keys(field), lambda k: k <= key))
    introduced, fixed = passed("introduced"), passed("fixed")
    beyond_last = F.exists(keys("last_affected"), lambda k: k < key)
    opened = F.when(fixed.isNull(), from_start | introduced.isNotNull()).otherwise(F.coalesce(introduced > fixed, F.lit(False)))
    return F.coalesce(opened, F.lit(False)) & ~F.coalesce(beyond_last, F.lit(False))


def is_affected(version: Column, ecosystem: Column, versions: Column, ranges: Column) -> Column:
    """Listed explicitly, or inside one of the ranges; each range stands for itself."""
    listed = F.coalesce(F.array_contains(versions, version), F.lit(False))
    return listed | F.coalesce(F.exists(ranges, lambda r: in_range(version, ecosystem, r["events"])), F.lit(False))


def affected_packages(advisories: DataFrame) -> DataFrame:
    """One row per advisory and package entry."""
    ecosystem = F.col("a.package.ecosystem")
    return advisories.select("id", F.explode("affected").alias("a")).select(
        F.col("id").alias("vuln_id"),
        ecosystem.alias("ecosystem"),
        V.canonical_name(F.col("a.package.name"), ecosystem).alias("key"),
        F.col("a.versions").alias("versions"),
        _version_ranges(F.col("a")).alias("ranges"),
    )


def affected_spans(advisories: DataFrame) -> DataFrame:
    """(vuln_id, ecosystem, key, low, high, last): spans of versions, with the keys they compare by.

    A version is affected when it is at least ``low``, below ``high`` and at most ``last`` (NULL: no such bound). A
    span begins with each introduction and ends with the next fix of its range; keys are made once per event.
    """
    packages = affected_packages(advisories).select("vuln_id", "ecosystem", "key", F.explode("ranges").alias("r"))
    events, ecosystem = F.col("r.events"), F.col("ecosystem")

    def keys(field: str) -> Column:
        named = F.filter(events, lambda e: e[field].isNotNull() & (e[field] != "0"))
        return F.transform(named, lambda e: V.sort_key(e[field], ecosystem))

    always = F.when(F.exists(events, lambda e: e["introduced"] == "0"), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    bounds = packages.select(
        "vuln_id", "ecosystem", "key", F.concat(always, keys("introduced")).alias("_lows"), keys("fixed").alias("_fixes"), F.array_min(keys("last_affected")).alias("last")
    )
    spans = F.transform("_lows", lambda low: F.struct(low.alias("low"), F.array_min(F.filter("_fixes", lambda f: f >= low)).alias("high")))
    rows = bounds.select("vuln_id", "ecosystem", "key", "last", F.inline(spans)).where("high IS NULL OR high > low")
    return rows.select("vuln_id", "ecosystem", "key", "low", "high", "last").distinct()


def match(dependencies: DataFrame, advisories: DataFrame) -> DataFrame:
    """(ecosystem, key, version, vuln_id) of every distinct dependency an advisory covers.

    Each version and each event is made into a key once; a pair of one package costs comparisons of two texts.
    """
    triples = dependencies.select("ecosystem", V.canonical_name(F.col("name"), F.col("ecosystem")).alias("key"), "version")
    # Written: else the test that a version has a key is pushed below the aggregate, and keys are made for every row.
    distinct = cut_lineage(triples.distinct())
    at = F.col("_at")
    keyed = distinct.withColumn("_at", V.sort_key(F.col("version"), F.col("ecosystem")))
    inside = (at >= F.col("low")) & (F.col("high").isNull() | (at < F.col("high"))) & (F.col("last").isNull() | (at <= F.col("last")))
    in_span = keyed.join(affected_spans(advisories), ["ecosystem", "key"]).where(inside).select("ecosystem", "key", "version", "vuln_id")
    listed = affected_packages(advisories).select("vuln_id", "ecosystem", "key", F.explode("versions").alias("version")).distinct()
    by_name = distinct.join(listed, ["ecosystem", "key", "version"]).select("ecosystem", "key", "version", "vuln_id")
    return in_span.unionByName(by_name).distinct()


def advised(matches: DataFrame, details: DataFrame) -> DataFrame:
    """Matches with severity, summary and fixed version; a match without details is kept (left join)."""
    d = details.select(
        F.col("id").alias("vuln_id"), F.lit(True).alias("_known"), "summary", "details", "database_specific", "affected"
    )
    known = F.col("_known").isNotNull()
    return matches.join(d, "vuln_id", "left").select(
        "ecosystem",
        "key",
        "version",
        "vuln_id",
        F.when(known, severity_of(F.col("database_specific.severity"))).otherwise(F.lit("HIGH")).alias("severity"),
        F.when(known, summary_of(F.col("summary"), F.col("details"))).otherwise(F.lit(NO_DETAILS)).alias("summary"),
        F.when(known, first_fixed(F.col("affected"), F.col("ecosystem"), F.col("key"))).otherwise(F.lit("")).alias("fixed"),
    )


def findings_of(dependencies: DataFrame, matches: DataFrame, details: DataFrame) -> DataFrame:
    """Findings for matched dependencies.

    The matches (distinct vulnerable package versions) are completed and written once; when measured
    small they are broadcast, so that the dependency rows neither move nor meet a hot key.
    """
    known = broadcast_if_small(cut_lineage(advised(matches, details)))
    rows = dependencies.withColumn("key", V.canonical_name(F.col("name"), F.col("ecosystem"))).join(
        known, ["ecosystem", "key", "version"]
    )
    sign = F.when(F.col("ecosystem") == "npm", F.lit("@")).otherwise(F.lit("=="))
    target = F.when(F.col("fixed") != "", F.concat(F.lit(" to >="), "fixed")).otherwise(F.lit(" to a patched release"))
    order = schemas.SCANNERS.index("deps")
    ecosystem_order = F.when(F.col("ecosystem") == "PyPI", F.lit(0)).otherwise(F.lit(1))
    return schemas.as_findings(
        rows.select(
            "repo",
            F.col("path").alias("file"),
            F.col("line").cast("int").alias("line"),
            "severity",
            F.concat(F.lit("Vulnerable package: "), "name", sign, "version", F.lit(" ("), "vuln_id", F.lit(")")).alias("title"),
            F.concat("summary", F.lit(" (source: OSV.dev)")).alias("description"),
            F.lit("deps").alias("scanner"),
            F.col("raw").alias("snippet"),
            F.lit(1).alias("fix_phase"),
            F.concat(F.lit("Upgrade "), "name", target).alias("fix_summary"),
            F.array(F.concat(F.lit("https://osv.dev/vulnerability/"), "vuln_id")).alias("references"),
            F.col("raw").alias("line_text"),
            schemas.emit_seq(order, ecosystem_order, 0, F.col("ord"), F.xxhash64("vuln_id")).alias("emit_seq"),
        )
    )


def dependencies(manifests: DataFrame, collected: DataFrame) -> DataFrame:
    """Pins and lockfile entries at each repository's project root.

    ``manifests`` holds (at least) all manifest files, also those that file selection leaves out;
    of ``collected`` only paths are read.
    """
    roots = M.project_roots(manifests, collected)
    return M.pins(M.requirement_files(manifests, roots)).unionByName(M.lock_entries(M.lockfiles_at(manifests, roots)))


def findings(manifests: DataFrame, collected: DataFrame, advisories: DataFrame) -> DataFrame:
    # Written once: the matching and the rows of findings read it, and manifests are costly to parse.
    found = cut_lineage(dependencies(manifests, collected))
    return findings_of(found, match(found, advisories), advisories)
