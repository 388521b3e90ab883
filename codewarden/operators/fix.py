"""Fixes as rows: line edits, the files they make together, and proposals of one finding each.

Nothing is edited in place. ``line_edits`` lists what all findings change, side files (``.env``, ``.gitignore``)
among it, without contents; ``compose`` folds the edits of a file over its lines once and gives one row per file.
A proposal row (``secret_fixes``, ``pin_fixes``) stands for its finding alone and carries the file as that one fix
would leave it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codewarden.functions import text as X
from codewarden.functions.ordering import range_rank
from codewarden.functions.sizes import broadcast_if_small
from codewarden.session import cut_lineage

ASSIGNMENT = r"""^(\s*)([A-Za-z_][A-Za-z0-9_]*)\s*(?::[^=]+)?=\s*(['"])(.+?)\3\s*$"""
UPGRADE = r"^Upgrade (\S+) to >=(\S+)$"
IMPORT = r"^(?:import|from)\s+\w"
HAS_OS = r"^(?:import os$|import os |import os\.|from os import)"


_PIN_SHAPE = r"^(\s*)([A-Za-z0-9][A-Za-z0-9._-]*)(\[[^\]]*\])?\s*==\s*\S+"
_AT_END = (1 << 31) - 1


def candidates(findings: DataFrame) -> DataFrame:
    """Findings with a mechanical fix: phase 1, a real line, from the secrets or dependency scanner."""
    return findings.where((F.col("fix_phase") == 1) & ~F.col("project_level") & F.col("scanner").isin("secrets", "deps"))


def _newline(content: Column) -> Column:
    return F.when(F.contains(content, F.lit("\r\n")), F.lit("\r\n")).otherwise(F.lit("\n"))


def _rejoin(lines: Column, content: Column) -> Column:
    """Lines joined with the file's own line end, which also ends the text where it did before."""
    joined = F.when(F.contains(content, F.lit("\r\n")), F.array_join(lines, "\r\n")).otherwise(F.array_join(lines, "\n"))
    return F.concat(joined, F.when(content.endswith("\n"), _newline(content)).otherwise(F.lit("")))


def _with_file(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Findings with the text of their file. The few files that some finding names are picked first, so
    that no other contents move."""
    named = broadcast_if_small(findings.select(F.col("repo").alias("_r"), F.col("file").alias("_p")).distinct())
    picked = files.join(named, (F.col("repo") == F.col("_r")) & (F.col("path") == F.col("_p"))).select("_r", "_p", "content")
    joined = findings.join(picked, (F.col("repo") == F.col("_r")) & (F.col("file") == F.col("_p")))
    return joined.withColumn("_lines", X.split_lines(F.col("content"))).withColumn(
        "_text", X.line_at(F.col("_lines"), F.col("line"))
    )


def _replace_line(lines: Column, number: Column, text: Column) -> Column:
    return F.transform(lines, lambda t, i: F.when(i == number - 1, text).otherwise(t))


def secret_fixes(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Rewrite ``NAME = "value"`` in a Python file to an environment lookup, one row per finding.

    ``import os`` goes before the first import when the file has none.
    """
    mine = candidates(findings).where((F.col("scanner") == "secrets") & (X.suffix_of(F.col("file")) == ".py"))
    rows = _with_file(mine, files).where(F.col("_text").rlike(ASSIGNMENT))
    part = lambda i: F.regexp_extract("_text", ASSIGNMENT, i)
    env_name = F.upper(part(2))
    new_line = F.concat(part(1), part(2), F.lit(' = os.environ["'), env_name, F.lit('"]'))
    replaced = rows.withColumns(
        {"env_name": env_name, "env_value": part(4), "name": part(2), "new_line": new_line}
    ).withColumn("_new", _replace_line(F.col("_lines"), F.col("line"), F.col("new_line")))
    imports = F.get(
        F.filter(F.transform("_new", lambda t, i: F.struct(i.alias("i"), t.alias("t"))), lambda x: x["t"].rlike(IMPORT)), 0
    )["i"]
    at = F.coalesce(imports, F.lit(0))
    needs = ~F.exists("_new", lambda t: t.rlike(HAS_OS))
    inserted = F.when(needs, F.array_insert("_new", at + 1, F.lit("import os"))).otherwise(F.col("_new"))
    return replaced.withColumn("import_at", F.when(needs, at + 1)).withColumn("_final", inserted).select(
        "repo",
        "file",
        "line",
        "title",
        "scanner",
        F.concat(
            "title", F.lit(": move `"), "name", F.lit("` to the environment (.env entry `"), "env_name", F.lit("`, gitignored)")
        ).alias("summary"),
        F.col("_text").alias("old_line"),
        "new_line",
        "import_at",
        "env_name",
        "env_value",
        "content",
        _rejoin(F.col("_final"), F.col("content")).alias("new_content"),
        F.lit(
            "The credential was committed to source — moving it does not un-leak it. Rotate it with the provider."
        ).alias("warning"),
        "emit_seq",
    )


def env_entries(fixes: DataFrame) -> DataFrame:
    """`.env` lines that the secret fixes append, in finding order per repository."""
    lines = fixes.withColumn("entry", F.concat("env_name", F.lit("="), "env_value"))
    ranked = range_rank(lines, ["repo"], [F.col("emit_seq"), F.col("entry")], "pos")
    return ranked.select("repo", F.lit(".env").alias("path"), "pos", "entry")


def gitignore_entries(fixes: DataFrame, files: DataFrame) -> DataFrame:
    """Repositories with a secret fix whose root .gitignore does not list `.env` yet."""
    listed = files.where(F.col("path") == ".gitignore").where(
        F.exists(X.split_lines(F.col("content")), lambda t: X.strip(t) == ".env")
    ).select("repo")
    wanted = fixes.select("repo").distinct().join(listed, "repo", "left_anti")
    return wanted.select("repo", F.lit(".gitignore").alias("path"), F.lit(1).cast("bigint").alias("pos"), F.lit(".env").alias("entry"))


def _secret_line(text: Column) -> dict[str, Column]:
    """Parts of an assignment of a secret, and the line that looks the value up instead; NULL for other lines."""
    part = lambda i: F.when(text.rlike(ASSIGNMENT), F.regexp_extract(text, ASSIGNMENT, i))
    name = F.upper(part(2))
    return {"env_name": name, "env_value": part(4), "new_text": F.concat(part(1), part(2), F.lit(' = os.environ["'), name, F.lit('"]'))}


def _pin_line(text: Column, summary: Column) -> Column:
    """The line with the pin raised to the release that the summary names; NULL where the line pins something else."""
    part = lambda i: F.regexp_extract(text, _PIN_SHAPE, i)
    name, version = (F.regexp_extract(summary, UPGRADE, i) for i in (1, 2))
    raised = F.concat(part(1), name, part(3), F.lit("=="), version)
    return F.when(summary.rlike(UPGRADE) & text.rlike(_PIN_SHAPE) & (F.lower(part(2)) == F.lower(name)), raised)


def line_edits(findings: DataFrame, files: DataFrame) -> DataFrame:
    """All edits of all mechanical fixes: repo, path, line, action, old_text, new_text, title, line_end, emit_seq.

    ``replace`` a line, ``insert`` before a line, or ``append`` to a file. Findings meet their file as one array per
    file, so a file's text is read once however many findings it has, and no edit carries it. Two findings of one
    line are one edit. Appended lines of a file follow ``emit_seq`` and line.
    """
    secret = (F.col("scanner") == "secrets") & (X.suffix_of(F.col("file")) == ".py")
    pin = (F.col("scanner") == "deps") & (X.file_name(F.col("file")) == "requirements.txt") & F.col("fix_summary").rlike(UPGRADE)
    fields = ["line", "title", "scanner", "fix_summary", "emit_seq"]
    mine = candidates(findings).where(secret | pin).groupBy("repo", "file").agg(F.collect_list(F.struct(*fields)).alias("_found"))
    mine = cut_lineage(mine)  # read twice: to find the files, and with them
    named = broadcast_if_small(mine.select(F.col("repo").alias("_r"), F.col("file").alias("_p")))
    picked = files.join(named, (F.col("repo") == F.col("_r")) & (F.col("path") == F.col("_p"))).select("_r", "_p", "content")
    whole = mine.join(picked, (F.col("repo") == F.col("_r")) & (F.col("file") == F.col("_p"))).withColumn("_lines", X.split_lines(F.col("content")))
    imports = F.filter(F.transform("_lines", lambda t, i: F.when(t.rlike(IMPORT), i + 1)), lambda i: i.isNotNull())
    found = F.transform("_found", lambda f: F.struct(*[f[c].alias(c) for c in fields], X.line_at(F.col("_lines"), f["line"]).alias("text")))
    rows = whole.select(
        "repo", F.col("file").alias("path"), _newline(F.col("content")).alias("line_end"),
        F.when(~F.exists("_lines", lambda t: t.rlike(HAS_OS)), F.coalesce(F.get(imports, 0), F.lit(1))).alias("import_at"), F.inline(found),
    )
    lines = _secret_line(F.col("text"))
    new_text = F.when(F.col("scanner") == "secrets", lines["new_text"]).otherwise(_pin_line(F.col("text"), F.col("fix_summary")))
    changed = rows.withColumns({**lines, "new_text": new_text}).where("new_text IS NOT NULL")
    first = F.min_by(F.struct("line_end", "import_at", "title", "scanner", "emit_seq", "text", "new_text", "env_name", "env_value"), F.struct("emit_seq", "title"))
    changed = cut_lineage(changed.groupBy("repo", "path", "line").agg(first.alias("e")).select("repo", "path", "line", "e.*"))

    def edits(of: DataFrame, action: str, path, line, old, new) -> DataFrame:
        return of.select("repo", path.alias("path"), line.cast("int").alias("line"), F.lit(action).alias("action"), old.alias("old_text"), new.alias("new_text"), "title", "line_end", "emit_seq")

    none = F.lit(None).cast("string")
    secrets = changed.where("scanner = 'secrets'")
    by_seq = F.min_by(F.struct("line_end", "import_at", "title", "emit_seq"), F.struct("emit_seq", "title")).alias("e")
    imported = secrets.where("import_at IS NOT NULL").groupBy("repo", "path").agg(by_seq).select("repo", "path", "e.*")
    listed = files.where(F.col("path") == ".gitignore").where(F.exists(X.split_lines(F.col("content")), lambda t: X.strip(t) == ".env")).select("repo")
    unlisted = secrets.groupBy("repo").agg(by_seq).select("repo", "e.*").join(listed, "repo", "left_anti")
    return (
        edits(changed, "replace", F.col("path"), F.col("line"), F.col("text"), F.col("new_text"))
        .unionByName(edits(imported, "insert", F.col("path"), F.col("import_at"), none, F.lit("import os")))
        .unionByName(edits(secrets, "append", F.lit(".env"), F.col("line"), none, F.concat("env_name", F.lit("="), "env_value")))
        .unionByName(edits(unlisted, "append", F.lit(".gitignore"), F.lit(1), none, F.lit(".env")))
    )


def compose(edits: DataFrame, files: DataFrame) -> DataFrame:
    """repo, path, new_content, edits: each changed file with all its edits, one row per file.

    The sorted edits cut the lines into stretches that are put together again once, whatever the number of edits. A
    file that is not there yet begins empty, with the line ends of the file that asks for it.
    """
    at = F.when(F.col("action") == "append", F.lit(_AT_END)).otherwise(F.col("line"))
    last = F.when(F.col("action") == "replace", F.col("line")).when(F.col("action") == "insert", F.col("line") - 1).otherwise(F.lit(_AT_END))
    entry = F.struct(at.alias("at"), (F.col("action") == "replace").alias("replaces"), "emit_seq", "line", last.alias("last"), F.col("new_text").alias("text"))
    grouped = edits.groupBy(F.col("repo").alias("_r"), F.col("path").alias("_p")).agg(
        F.array_sort(F.collect_list(entry)).alias("_edits"), F.min_by("line_end", F.struct("emit_seq", "line")).alias("_end"), F.max(F.col("action") == "append").alias("_grows")
    )
    grouped = cut_lineage(grouped)
    named = broadcast_if_small(grouped.select(F.col("_r").alias("_a"), F.col("_p").alias("_b")))
    picked = files.join(named, (F.col("repo") == F.col("_a")) & (F.col("path") == F.col("_b"))).select("_a", "_b", "content")
    whole = grouped.join(picked, (F.col("_r") == F.col("_a")) & (F.col("_p") == F.col("_b")), "left").withColumn("content", F.coalesce("content", F.lit("")))
    whole = whole.withColumn("_lines", X.split_lines(F.col("content")))
    size = F.size("_lines")

    def stretch(begin: Column, end: Column) -> Column:
        """Lines after ``begin`` up to ``end``."""
        return F.slice(F.col("_lines"), begin + 1, F.greatest(F.lit(0), F.least(end, size) - begin))

    def piece(e: Column, k: Column) -> Column:
        before = F.least(F.when(k > 0, F.get(F.col("_edits"), k - 1)["last"]).otherwise(F.lit(0)), size)
        return F.concat(stretch(before, e["at"] - 1), F.array(e["text"]))

    end = F.least(F.element_at("_edits", -1)["last"], size)
    lines = F.concat(F.flatten(F.transform("_edits", piece)), stretch(end, size))
    line_end = F.when(F.col("content") == "", F.col("_end")).otherwise(_newline(F.col("content")))
    joined = F.when(line_end == "\r\n", F.array_join(lines, "\r\n")).otherwise(F.array_join(lines, "\n"))
    text = F.concat(joined, F.when(F.col("content").endswith("\n") | F.col("_grows"), line_end).otherwise(F.lit("")))
    return whole.select(F.col("_r").alias("repo"), F.col("_p").alias("path"), text.alias("new_content"), F.size("_edits").alias("edits"))


def verify_composed(edits: DataFrame, composed: DataFrame, scan) -> DataFrame:
    """The ``replace`` edits with ``fixed``: a scan of the composed file no longer finds their title on their line.

    The line is the one the edit has in the new file: lines inserted before it are counted. Pins are judged by their text.
    """
    sources = edits.where("action = 'replace'").select("repo").distinct()
    rewritten = composed.join(sources, "repo", "left_semi").select("repo", "path", F.lit(0).cast("bigint").alias("file_seq"), F.col("new_content").alias("content"))
    left = scan(rewritten).select("repo", F.col("file").alias("path"), F.col("line").alias("new_line"), "title").distinct().withColumn("_left", F.lit(True))
    inserts = edits.where("action = 'insert'").groupBy("repo", "path").agg(F.sort_array(F.collect_list("line")).alias("_inserts"))
    moved = F.size(F.filter(F.coalesce("_inserts", F.array().cast("array<int>")), lambda i: i <= F.col("line")))
    placed = edits.where("action = 'replace'").join(inserts, ["repo", "path"], "left").withColumn("new_line", F.col("line") + moved)
    judged = placed.join(left, ["repo", "path", "new_line", "title"], "left")
    return judged.select("repo", "path", "line", "new_line", "title", (F.col("_left").isNull() & (F.col("old_text") != F.col("new_text"))).alias("fixed"))


def pin_fixes(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Raise an exact pin to the first fixed release; refused when the pin is not on its line any more."""
    mine = candidates(findings).where(
        (F.col("scanner") == "deps") & (X.file_name(F.col("file")) == "requirements.txt") & F.col("fix_summary").rlike(UPGRADE)
    )
    rows = _with_file(mine, files).withColumns(
        {"name": F.regexp_extract("fix_summary", UPGRADE, 1), "version": F.regexp_extract("fix_summary", UPGRADE, 2)}
    )
    # The pinned name is compared as text: no pattern is built from data.
    part = lambda i: F.regexp_extract("_text", _PIN_SHAPE, i)
    pinned = rows.where(F.col("_text").rlike(_PIN_SHAPE) & (F.lower(part(2)) == F.lower("name")))
    new_line = F.concat(part(1), F.col("name"), part(3), F.lit("=="), F.col("version"))
    return pinned.withColumn("new_line", new_line).select(
        "repo",
        "file",
        "line",
        "title",
        "scanner",
        F.concat("title", F.lit(": pin "), "name", F.lit("=="), "version", F.lit(" (first fixed release)")).alias("summary"),
        F.col("_text").alias("old_line"),
        "new_line",
        "content",
        _rejoin(_replace_line(F.col("_lines"), F.col("line"), F.col("new_line")), F.col("content")).alias("new_content"),
        F.concat(F.lit("Run your test suite — "), "name", F.lit(" "), "version", F.lit(" may contain other changes.")).alias("warning"),
        "emit_seq",
    )


def diff_lines(fixes: DataFrame) -> DataFrame:
    """Changed lines of each proposal: removed lines by old number, added lines by new number."""
    lines = lambda c, sign: F.transform(
        X.split_lines(F.col(c)), lambda t, i: F.struct((i + 1).alias("line_no"), F.lit(sign).alias("sign"), t.alias("text"))
    )
    import_at = F.col("import_at") if "import_at" in fixes.columns else F.lit(None).cast("int")
    shift = F.when(import_at.isNotNull() & (import_at <= F.col("line")), F.lit(1)).otherwise(F.lit(0))
    old = F.filter(lines("content", "-"), lambda x: x["line_no"] == F.col("line"))
    new = F.filter(
        lines("new_content", "+"),
        lambda x: (x["line_no"] == F.col("line") + shift) | F.coalesce(x["line_no"] == import_at, F.lit(False)),
    )
    return fixes.select("repo", "file", "line", "title", F.explode(F.concat(old, new)).alias("d")).select(
        "repo", "file", "line", "title", "d.sign", "d.line_no", "d.text"
    )


def verify_secret_fixes(fixes: DataFrame, scan) -> DataFrame:
    """Adds ``fixed``: scanning the new text no longer yields the finding's (line, title)."""
    key = F.sha2(F.concat_ws("\u0001", "repo", "file", F.col("line").cast("string"), "title"), 256)
    keyed = fixes.withColumn("_key", key)
    rewritten = keyed.select(
        F.col("_key").alias("repo"), F.col("file").alias("path"), F.lit(0).cast("bigint").alias("file_seq"), F.col("new_content").alias("content")
    ).dropDuplicates(["repo"])
    left = scan(rewritten).select(F.col("repo").alias("_key"), "line", "title").distinct().withColumn("_left", F.lit(True))
    return keyed.join(left, ["_key", "line", "title"], "left").withColumn("fixed", F.col("_left").isNull()).drop("_key", "_left")


def verify_pin_fixes(fixes: DataFrame) -> DataFrame:
    """Adds ``fixed``: the pinned line of the new text differs from the flagged one."""
    line = X.line_at(X.split_lines(F.col("new_content")), F.col("line"))
    return fixes.withColumn("fixed", F.coalesce(line != X.strip(F.col("old_line")), F.lit(False)))
