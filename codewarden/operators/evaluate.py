"""Precision and recall of findings against labelled weaknesses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codewarden.session import cut_lineage

LINE_TOLERANCE = 2

# Titles and rule-id words of each weakness category.
CATEGORY_TITLES = {
    "sqli": [
        "SQL string concatenation",
        "SQL f-string query",
        "Raw SQL with string format",
        "SQL template literal",
        "SQL raw() with dynamic input",
        "NoSQL query with user-controlled value",
        "SQL query with user-controlled string",
    ],
    "cmdi": [
        "shell=True with dynamic command",
        "shell=True with constant command",
        "os.system() call",
        "os.system() with constant command",
        "exec() with template literal",
        "exec() with string concatenation",
        "child_process exec with variable command",
        "child_process exec (member call)",
        "spawn() with shell:true",
        "exec() with user-controlled command",
    ],
    "codei": [
        "eval() usage",
        "exec() usage",
        "exec() with template literal",
        "exec() with string concatenation",
        "exec() with user-controlled command",
        "Function constructor with dynamic code",
        "vm.runInContext with dynamic code",
    ],
    "xss": [
        "innerHTML assignment",
        "outerHTML assignment",
        "document.write()",
        "insertAdjacentHTML with dynamic content",
        "dangerouslySetInnerHTML with dynamic content",
        "jQuery .html() with dynamic content",
        "Unescaped template output",
    ],
    "pathtrav": ["Path traversal"],
    "ssrf": ["Server-side request forgery (SSRF)"],
    "deserial": ["Insecure deserialization"],
    "openredir": ["Open redirect"],
}
ENGINE_WORDS = {
    "sqli": ["sql"],
    "cmdi": ["command", "child-process", "child_process", "subprocess", "shell", "exec", "spawn", "os-system"],
    "codei": ["eval", "code-injection", "vm-runin", "function-constructor"],
    "xss": ["xss", "innerhtml", "inner-html", "dangerously", "document-write", "sanitiz", "html-inject"],
    "pathtrav": ["path-traversal", "pathtraversal", "directory-traversal", "path-join", "traversal"],
    "ssrf": ["ssrf", "server-side-request", "request-forgery"],
    "deserial": ["deserial", "pickle", "unsafe-yaml", "yaml-load", "unserialize", "insecure-deser"],
    "openredir": ["open-redirect", "open_redirect", "url-redirect", "unvalidated-redirect"],
}


def categories_of(scanner: Column, title: Column) -> Column:
    """Sorted categories a finding may satisfy: by title for own findings, by rule-id words for engines."""
    rule = F.lower(title)

    def category(name: str) -> Column:
        own = title.isin(*CATEGORY_TITLES[name])
        words = reduce(lambda a, b: a | b, [F.contains(rule, F.lit(w)) for w in ENGINE_WORDS[name]])
        return F.when(F.when(scanner == "injection", own).otherwise(words), F.lit(name))

    return F.array_sort(F.array_compact(F.array(*[category(name) for name in CATEGORY_TITLES])))


def line_matches(findings: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled lines and finding lines that match: same case and file, close, categories in common.

    A band join of *distinct* lines: copies of a finding or label collapse first, so no pairs of copies
    are made. Both sides meet in line buckets as wide as the tolerance allows, so a file with a third of
    all lines is spread over its buckets. ``n`` counts the findings on the finding line.
    """
    width = 2 * LINE_TOLERANCE + 1
    f = findings.groupBy("cve", "file", F.col("line").alias("f_line"), F.col("cats").alias("f_cats")).agg(
        F.count_distinct("finding_id").alias("n")
    )
    w = labels.select("cve", "file", F.col("line").alias("w_line"), "categories").distinct()
    near = F.sequence(F.floor((F.col("w_line") - LINE_TOLERANCE) / width), F.floor((F.col("w_line") + LINE_TOLERANCE) / width))
    return (
        w.withColumn("bucket", F.explode(near))
        .join(f.withColumn("bucket", F.floor(F.col("f_line") / width)), ["cve", "file", "bucket"])
        .where(F.abs(F.col("f_line") - F.col("w_line")) <= LINE_TOLERANCE)
        .where(F.arrays_overlap("categories", "f_cats"))
        .select("cve", "file", "w_line", "categories", "f_line", "f_cats", "n")
    )


def matches(findings: DataFrame, labels: DataFrame) -> DataFrame:
    """(cve, weakness_id, n): matched weaknesses and the number of findings that match each."""
    per_line = line_matches(findings, labels).groupBy("cve", "file", F.col("w_line").alias("line"), "categories").agg(F.sum("n").alias("n"))
    return labels.join(per_line, ["cve", "file", "line", "categories"]).select("cve", "weakness_id", "n")


def scores(findings: DataFrame, labels: DataFrame, entries: DataFrame) -> DataFrame:
    """TP, FP, FN, precision and recall per category, and a total row ``all``.

    ``findings(cve, file, line, finding_id, cats)``, ``labels(cve, file, line, weakness_id, categories)``,
    ``entries(cve, categories)``. A labelled weakness counts once for every category of its case;
    an unmatched finding is a false positive for each category it shares with its case.
    """
    pairs = cut_lineage(line_matches(findings, labels))
    label_key, finding_key = ["cve", "file", "line", "categories"], ["cve", "file", "line", "cats"]
    hit = pairs.select("cve", "file", F.col("w_line").alias("line"), "categories").distinct().withColumn("hit", F.lit(1))
    matched = pairs.select("cve", "file", F.col("f_line").alias("line"), F.col("f_cats").alias("cats")).distinct()
    judged = labels.join(hit, label_key, "left").select(
        F.explode("categories").alias("category"), F.coalesce("hit", F.lit(0)).alias("hit")
    )
    positives = judged.groupBy("category").agg(F.sum("hit").alias("tp"), F.sum(1 - F.col("hit")).alias("fn"))
    unmatched = findings.join(matched, finding_key, "left_anti")
    shared = unmatched.join(entries.withColumnRenamed("categories", "wanted"), "cve").select(
        F.explode(F.array_intersect("cats", "wanted")).alias("category")
    )
    negatives = shared.groupBy("category").agg(F.count(F.lit(1)).alias("fp"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    each = positives.join(negatives, "category", "full").select("category", zero("tp"), zero("fp"), zero("fn"))
    rolled = each.groupBy("category").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    total = each.agg(F.lit("all").alias("category"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    ratio = lambda a, b: F.when(a + b > 0, a / (a + b))
    return rolled.unionByName(total.select("category", "tp", "fp", "fn")).withColumns(
        {"precision": ratio(F.col("tp"), F.col("fp")), "recall": ratio(F.col("tp"), F.col("fn"))}
    )
