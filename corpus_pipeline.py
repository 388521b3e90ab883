"""Preparation of a training corpus: five stages over ``documents``, each written and read back.

All stages but the last return the columns of ``documents``. A row with a null id stays where a stage
cannot judge it. Texts that a stage shortens keep their row, and ``n_chars`` follows the text.

Defined results: a null text is no toxic one and has no copies, passages or secrets, and is packed as its end id
alone; so is an empty one. Long texts are read whole. Of rows with one id and one text one stays; rows of one id with
different texts all stay unless the id is a copy of a smaller one. Empty documents, or labels, give a model that
rejects nothing, and empty stages. Other columns are left out by the first stage, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codewarden.llm import entropy, neardup, packing, passages, toxicity
from codewarden.session import shared_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject."""
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.withColumn("_score", toxicity.score_column(model)).where("_score < 0.5").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id, and all texts of that id.

    Of rows of one id and text, the one with the smallest language, source and size stays.
    """
    gone = neardup.near_duplicates(docs, percent=80).where("NOT kept").select("doc_id").distinct()
    # Rows of an id are told apart by a digest: keys are short, and a text is carried once.
    digest = F.md5(F.coalesce("text", F.lit(""))).alias("_digest")
    first = F.min_by(F.struct("text", "lang", "source", "n_chars"), F.struct("lang", "source", "n_chars")).alias("first")
    kept = docs.where("doc_id IS NOT NULL").join(gone, "doc_id", "left_anti")
    named = kept.groupBy("doc_id", digest, F.col("text").isNull().alias("_none")).agg(first).select("doc_id", "first.*")
    return named.select(*COLUMNS).unionByName(docs.where("doc_id IS NULL").select(*COLUMNS))


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document has."""
    return _sized(passages.without_passages(docs, passages.passages(docs)))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with secrets masked."""
    return _sized(entropy.redacted(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 2048 token ids."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")).drop("text_key")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", cut_passages),
    ("secrets", redact_secrets),
    ("packing", pack),
]
# Learned scores, chains and packing are no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_dir(spark).rstrip('/')}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
