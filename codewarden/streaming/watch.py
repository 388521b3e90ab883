"""Continuous scan of file versions with Structured Streaming.

Saves arrive as append-only version rows ``(repo, path, file_seq, content, mtime, deleted)``, with a
``version`` number where there is one. A micro-batch writes its newest versions and gives the findings of all
current files of the repositories it touches, project-level checks included. Rows that the per-file pass made of a
file are kept, and only files whose current content has not been scanned yet are read and scanned; special files,
project-level checks and all that follows see the whole repository each time. With scanners of a user's or rules of
repositories (``by_file``) the whole scan runs on all of them. All of a batch's output lies in folders of its own
number and is written with overwrite, so a batch that runs again after a lost executor or driver replaces its own
output.

The state is one row per path, laid out by a hash of the repository: all files of versions lie in the folder of
their repository's bucket, so a batch reads the buckets that it touches and no other file. Every ``SNAPSHOT``
batches the buckets that got versions since the last time are written anew; a bucket that nothing touches keeps
its older snapshot. A batch reads a bucket's last snapshot and the few batches after it. Two tables are laid out in
the same way: ``scans`` (which content of a path was scanned, with which settings, in which batch) and ``rows`` (what
that batch found in it). Rows hold for the settings they were made with; after a change of the built-in rules a
watch begins a new folder.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from codewarden import schemas
from codewarden.functions.sizes import broadcast_if_small
from codewarden.operators import baseline
from codewarden.operators.select import Selection
from codewarden.plans.scan import Options, by_file, pass_rows, pass_settings, scan
from codewarden.session import cut_lineage, scratch
from codewarden.sources import manifests

VERSIONS_DDL = (
    "repo string, path string, file_seq bigint, content string, mtime timestamp, deleted boolean"
)
# ``tie`` orders versions of one time and number, ``digest`` tells contents apart where they are not read.
STATE_DDL = f"{VERSIONS_DDL}, version bigint, tie bigint, digest string"
SCANS_DDL = "repo string, path string, file_seq bigint, digest string, settings string, scan int"
_ROWS = T.StructType([*schemas.FINDINGS.fields, T.StructField("scan", T.IntegerType())])
_SCHEMAS = {"versions": STATE_DDL, "scans": SCANS_DDL, "rows": _ROWS}
# Contents are packed tightly, and in groups of rows that several tasks can read of one file.
STORED = {"compression": "zstd", "parquet.block.size": 16 << 20, "parquet.enable.dictionary#content": "false"}
SPLIT_BYTES = 16 << 20
SNAPSHOT = 20
BUCKETS = 256  # folders of the state; the driver sees at most so many bucket numbers


def latest_versions(versions: DataFrame) -> DataFrame:
    """Newest version per (repo, path): an aggregate that combines on the map side.

    Later times win, then larger version numbers; what is still equal is told apart by its content.
    """
    rest = [c for c in versions.columns if c not in ("repo", "path")]
    number = [F.col("version")] if "version" in rest else []
    newest = F.struct(F.col("mtime"), *number, F.col("tie") if "tie" in rest else F.xxhash64("content"))
    return versions.groupBy("repo", "path").agg(F.max_by(F.struct(*rest), newest).alias("v")).select("repo", "path", "v.*")


def without_repeats(versions: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Extension: drop rows that deliver a version again inside the watermark. The same content saved at
    another time is another version: a file that goes back to it is in that state again."""
    hashed = versions.withColumn("content_hash", F.sha2(F.col("content"), 256))
    return hashed.withWatermark("mtime", delay).dropDuplicatesWithinWatermark(["repo", "path", "mtime", "content_hash"]).drop("content_hash")


def bucket_of(repo: Column) -> Column:
    return F.pmod(F.xxhash64(repo), F.lit(BUCKETS)).cast("int")


def _write_state(rows: DataFrame, folder: str) -> None:
    """Rows below a folder per bucket. A bucket's rows meet in few files, and a hot one is split."""
    placed = rows.withColumn("bucket", bucket_of(F.col("repo")))
    placed.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").options(**STORED).parquet(folder)


def _small_splits(spark: SparkSession) -> None:
    """A scan works seconds on a MB of contents: its tasks read small pieces of the state's files, so that all cores have
    work up to its end. For the session of one streaming query, which is its own."""
    limit = min(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes(), SPLIT_BYTES)
    spark.conf.set("spark.sql.files.maxPartitionBytes", f"{limit}b")


def _buckets(rows: DataFrame) -> list[int]:
    return sorted(row["bucket"] for row in rows.select("bucket").distinct().collect())  # at most BUCKETS


def _parts(spark: SparkSession, out: str, table: str) -> DataFrame:
    schema = _SCHEMAS[table]
    fields = T.StructType.fromDDL(schema).fields if isinstance(schema, str) else schema.fields
    placed = [T.StructField(name, T.IntegerType()) for name in ("batch", "bucket")]
    return spark.read.schema(T.StructType([*fields, *placed])).parquet(f"{out}/{table}")


def _part(spark: SparkSession, out: str, table: str, epoch: int) -> DataFrame:
    """What one batch wrote of a table."""
    return spark.read.schema(_SCHEMAS[table]).parquet(f"{out}/{table}/batch={epoch}").drop("bucket")


def _snapshots(out: str, table: str) -> tuple[str, str]:
    """Folders of a table's snapshots and of their index."""
    before = "" if table == "versions" else f"{table}-"
    return f"{out}/{before}snapshots", f"{out}/{before}snapshot-index"


def _state(spark: SparkSession, out: str, before: int, buckets: Sequence[int], table: str = "versions") -> DataFrame | None:
    """Versions among which the newest of every path is, in batches below a number and in some buckets only.

    Folders of other buckets are not listed among the files to read. The other tables likewise.
    """
    if before <= 0:
        return None
    snapshot = (before - 1) // SNAPSHOT * SNAPSHOT
    rows = _parts(spark, out, table).where((F.col("batch") > (snapshot or -1)) & (F.col("batch") < before) & F.col("bucket").isin(*buckets))
    rows = rows.drop("batch", "bucket")
    if not snapshot:
        return rows
    kept, listed = _snapshots(out, table)
    index = spark.read.schema("bucket int, batch int").parquet(listed)
    newest = index.where((F.col("batch") <= snapshot) & F.col("bucket").isin(*buckets)).groupBy("bucket").agg(F.max("batch").alias("batch")).collect()
    folders = [f"{kept}/batch={row['batch']}/bucket={row['bucket']}" for row in newest]
    return rows.unionByName(spark.read.schema(_SCHEMAS[table]).parquet(*folders)) if folders else rows


def _write_snapshot(rows: DataFrame, out: str, table: str, epoch: int) -> None:
    spark, (kept, listed) = rows.sparkSession, _snapshots(out, table)
    _write_state(rows, f"{kept}/batch={epoch}")
    buckets = _buckets(spark.read.schema("bucket int").parquet(f"{kept}/batch={epoch}"))
    index = spark.createDataFrame([(b,) for b in buckets], "bucket int")
    index.coalesce(1).write.mode("overwrite").parquet(f"{listed}/batch={epoch}")


def _snapshot(spark: SparkSession, out: str, epoch: int) -> None:
    """The buckets that got versions after the last snapshot, written anew with the batches up to this one.

    Of versions the newest of every path is kept, of scans the last one of every path with its rows.
    """
    fresh = _parts(spark, out, "versions").where((F.col("batch") > max(0, epoch - SNAPSHOT) - (epoch == SNAPSHOT)) & (F.col("batch") <= epoch))
    buckets = _buckets(fresh)
    rows = {table: _state(spark, out, epoch, buckets, table).unionByName(_part(spark, out, table, epoch)) for table in _SCHEMAS}
    _write_snapshot(latest_versions(rows["versions"]), out, "versions", epoch)
    rest = [c for c in rows["scans"].columns if c not in ("repo", "path")]
    last = rows["scans"].groupBy("repo", "path").agg(F.max_by(F.struct(*rest), "scan").alias("s")).select("repo", "path", "s.*")
    _write_snapshot(last, out, "scans", epoch)
    _write_snapshot(_same(rows["rows"], last.withColumnRenamed("path", "file"), ["repo", "file", "scan"]), out, "rows", epoch)


def _same(rows: DataFrame, others: DataFrame, key: Sequence[str], how: str = "left_semi") -> DataFrame:
    """Join by a key whose parts may be null; columns of the key are those of ``rows``."""
    named = others.select(*[F.col(c).alias(f"_{c}") if c in key else F.col(c) for c in others.columns])
    on = reduce(lambda a, b: a & b, [rows[c].eqNullSafe(named[f"_{c}"]) for c in key])
    return rows.join(named, on, how).drop(*[f"_{c}" for c in key])


_CONTENT = ["repo", "path", "file_seq", "digest"]  # what a scan of a file was made of


def _contents(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` files with their contents, once each, from versions that may hold one more than once."""
    found = _same(rows.select(*_CONTENT, "content"), broadcast_if_small(wanted.select(*_CONTENT)), _CONTENT)
    return found.groupBy(*_CONTENT).agg(F.any_value("content").alias("content"))


def _current(rows: DataFrame) -> DataFrame:
    """The current files of versions as rows of a scan, with the contents of special files only."""
    keys = cut_lineage(latest_versions(rows.drop("content")).where(~F.col("deleted")).select(*_CONTENT, "fresh"))
    special = F.coalesce(manifests.is_special(F.col("path")), F.lit(False))
    files = keys.where(~special).withColumn("content", F.lit(None).cast("string"))
    named = keys.where(special)
    if named.isEmpty():
        return files
    return files.unionByName(_same(named, _contents(rows.where(special & ~F.col("deleted")), named), _CONTENT, "inner"))


def _file_rows(out: str, epoch: int, buckets: Sequence[int], options: Options, before: DataFrame | None, selected: Selection) -> DataFrame:
    """Rows of the per-file pass for the selected files: kept ones, and those of files scanned in this batch."""
    spark, settings = selected.files.sparkSession, pass_settings(options)
    wanted = selected.paths("digest", "fresh")
    if before is None:
        wanted = wanted.withColumn("scan", F.lit(None).cast("int"))
    else:
        done = _state(spark, out, epoch, buckets, "scans").where(F.col("settings") == settings)
        wanted = _same(wanted, done.groupBy(*_CONTENT).agg(F.max("scan").alias("scan")), _CONTENT, "left")
    wanted = cut_lineage(wanted)
    todo = wanted.where("scan IS NULL")
    files = selected.of(_part(spark, out, "versions", epoch).where(~F.col("deleted")))
    if before is not None:
        files = _same(files, broadcast_if_small(todo.where("fresh").select(*_CONTENT)), _CONTENT).select(*_CONTENT, "content")
        older = todo.where("NOT fresh")
        if not older.isEmpty():  # files that were not selected so far, or other settings
            files = files.unionByName(_contents(before.where(~F.col("deleted")), older))
    found = selected.rows(pass_rows(files.select("repo", "path", "file_seq", "content"), options))
    _write_scans(out, epoch, found, todo.withColumn("settings", F.lit(settings)))
    rows = _part(spark, out, "rows", epoch)
    if before is not None:
        kept = wanted.where("scan IS NOT NULL").select("repo", F.col("path").alias("file"), "scan")
        rows = rows.unionByName(_same(_state(spark, out, epoch, buckets, "rows"), kept, ["repo", "file", "scan"]))
    return rows.drop("scan")


def _write_scans(out: str, epoch: int, found: DataFrame, scanned: DataFrame) -> None:
    _write_state(found.withColumn("scan", F.lit(epoch)), f"{out}/rows/batch={epoch}")
    _write_state(scanned.select(*_CONTENT, "settings", F.lit(epoch).alias("scan")), f"{out}/scans/batch={epoch}")


def watch(
    versions: DataFrame,
    out: str,
    checkpoint: str,
    known: DataFrame | None = None,
    skip_paths: Sequence[str] = (),
    options: Options = Options(),
    advisories: DataFrame | None = None,
    on_batch: Callable[[DataFrame, int], None] | None = None,
    **trigger,
) -> StreamingQuery:
    """Start the scan of a stream of file versions; results go below ``out``.

    The identities of ``known`` are written once at the start: micro-batches read them and do not make them again.
    """
    if known is not None:
        known = cut_lineage(known.select(*baseline.KEY).distinct())
    source = versions.where(~F.col("path").isin(*skip_paths)) if skip_paths else versions
    if "version" not in source.columns:
        source = source.withColumn("version", F.lit(None).cast("bigint"))

    def one_batch(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        _small_splits(spark)
        folder = f"{out}/versions/batch={epoch}"
        fresh = batch.withColumn("deleted", F.coalesce("deleted", F.lit(False)))
        newest = latest_versions(fresh.select("repo", "path", "file_seq", "content", "mtime", "deleted", "version"))
        marks = {"tie": F.xxhash64("content"), "digest": F.coalesce(F.sha2("content", 256), F.lit(""))}
        _write_state(newest.withColumns(marks), folder)
        placed = spark.read.schema(f"{STATE_DDL}, bucket int").parquet(folder)
        touched = placed.select("repo").distinct()
        touched.write.mode("overwrite").parquet(f"{out}/repos/batch={epoch}")
        buckets = _buckets(placed)
        before = _state(spark, out, epoch, buckets)
        rows = placed.drop("bucket").withColumn("fresh", F.lit(True))
        if before is not None:
            named = broadcast_if_small(spark.read.schema("repo string").parquet(f"{out}/repos/batch={epoch}"))
            before = before.join(named, "repo", "left_semi")
            rows = before.withColumn("fresh", F.lit(False)).unionByName(rows)
        with scratch(spark):  # the current files are put together once, and go with the scan's other tables
            if by_file(options):
                file_rows = partial(_file_rows, out, epoch, buckets, options, before)
                found = scan(_current(rows), options, advisories, known=known, file_rows=file_rows)
            else:
                files = latest_versions(rows).where(~F.col("deleted")).select("repo", "path", "file_seq", "content")
                found = scan(cut_lineage(files), options, advisories, known=known)
                _write_scans(out, epoch, *(spark.createDataFrame([], _SCHEMAS[table]) for table in ("rows", "scans")))
            found.write.mode("overwrite").parquet(f"{out}/findings/batch={epoch}")
        if epoch and epoch % SNAPSHOT == 0:
            _snapshot(spark, out, epoch)
        if on_batch:
            on_batch(spark.read.schema(found.schema).parquet(f"{out}/findings/batch={epoch}"), epoch)

    writer = source.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "1 second"})).start()


def current_findings(spark: SparkSession, out: str) -> DataFrame:
    """Findings of the current files: each repository's newest scan."""
    newest = spark.read.parquet(f"{out}/repos").groupBy("repo").agg(F.max("batch").alias("batch"))
    found = spark.read.option("mergeSchema", "false").parquet(f"{out}/findings")
    return found.join(newest, ["repo", "batch"], "left_semi").drop("batch")
