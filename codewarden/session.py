"""Session helpers: defaults for a new session, and the shared folder for cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "codewarden", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine's plans assume (AQE, skew joins, UTC)."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a scratch folder only in local mode.

    A cluster must name a folder all executors share: what is written into a machine-local folder is
    lost with that machine.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    folder = tempfile.mkdtemp(prefix="codewarden-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


_SCRATCH: ContextVar[str | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A folder of its own below the shared one for all that ``cut_lineage`` writes inside; removed at the end.

    Write or collect results before the end: they read the tables in it.
    """
    folder = f"{shared_dir(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"
    held = _SCRATCH.set(folder)
    try:
        yield folder
    finally:
        _SCRATCH.reset(held)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written once as a table in the shared folder, and read back.

    Survives lost executors, is read column by column, and has a known size for later joins. For
    results that several branches of a plan read. Inside ``scratch`` the table goes with its folder; else the shared
    folder is the owner's to clean.
    """
    spark = df.sparkSession
    path = f"{_SCRATCH.get() or shared_dir(spark).rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
