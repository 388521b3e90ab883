"""Registered queries of the dealt operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _query(f):
    QUERIES[f.__name__] = f
    return f


@_query
def op2_pack(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    from codewarden.llm import packing

    return packing.pack(_table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json")).drop("text_key")


@_query
def op4_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    from codewarden.llm import neardup

    return neardup.near_duplicates(_table(spark, sf, "documents"))


@_query
def op6_passages(spark: SparkSession, sf: str) -> DataFrame:
    from codewarden.llm import passages

    return passages.passages(_table(spark, sf, "documents"))


@_query
def op7_top_inner_products(spark: SparkSession, sf: str) -> DataFrame:
    from codewarden.llm import topk

    return topk.top_k(_table(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLES["op7_top_inner_products"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 5
"""


@_query
def op8_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    from codewarden.llm import fingerprint

    return fingerprint.with_neighbours(_table(spark, sf, "documents"))


@_query
def op1_warc(spark: SparkSession, sf: str) -> DataFrame:
    from codewarden.llm import warc

    return warc.round_trip(_table(spark, sf, "pages")).drop("payload")


@_query
def op3_secrets(spark: SparkSession, sf: str) -> DataFrame:
    from codewarden.llm import entropy

    return entropy.scan(_table(spark, sf, "documents"))


@_query
def op9_main_text(spark: SparkSession, sf: str) -> DataFrame:
    from codewarden.llm import wrappers

    return wrappers.main_text(_table(spark, sf, "pages"))


@_query
def op5_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    from codewarden.llm import toxicity

    docs = _table(spark, sf, "documents")
    return toxicity.scored(docs, toxicity.learn(docs, _table(spark, sf, "labels")))


@_query
def op10_pieces(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    from codewarden.llm import pieces

    path = public_tokenizers.path("piece_bpe_32k.model")
    return pieces.digest(pieces.encode(_table(spark, sf, "documents"), path), path)


@_query
def op11_align(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    from codewarden.llm import align

    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return align.linked(_table(spark, sf, "documents"), *paths)


@_query
def op12_curriculum(spark: SparkSession, sf: str) -> DataFrame:
    from codewarden.llm import curriculum

    mixed = curriculum.mix(_table(spark, sf, "documents"))
    first, again = (F.get("positions", F.lit(k)) for k in (0, 1))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", first.alias("position"), again.alias("position_again"))


# Curves of the three schedules: part due by a time, and the time at which a part is due.
_DUE = (
    "(0.0::DOUBLE + 1.5::DOUBLE * {t} + (-0.5)::DOUBLE * {t} * {t})",
    "CASE WHEN {t} >= 0.5::DOUBLE THEN 0.5::DOUBLE + 1.5::DOUBLE * ({t} - 0.5::DOUBLE) + (-1.0)::DOUBLE * ({t} - 0.5::DOUBLE) * ({t} - 0.5::DOUBLE)"
    " ELSE 0.5::DOUBLE * {t} + 1.0::DOUBLE * {t} * {t} END",
    "(0.5::DOUBLE * {t} + 0.5::DOUBLE * {t} * {t})",
)
_ROOT = "{start}::DOUBLE + CASE WHEN {c} <= 0 THEN 0 ELSE 2.0::DOUBLE * {c} / ({h}::DOUBLE + sqrt(greatest(0.0::DOUBLE, {hh}::DOUBLE + ({s})::DOUBLE * {c}))) END"
_TIME = (
    _ROOT.format(start="0.0", c="{p}", h="1.5", hh="2.25", s="-2.0"),
    "CASE WHEN {p} >= 0.5::DOUBLE THEN " + _ROOT.format(start="0.5", c="({p} - 0.5::DOUBLE)", h="1.5", hh="2.25", s="-4.0") + " ELSE " + _ROOT.format(start="0.0", c="{p}", h="0.5", hh="0.25", s="4.0") + " END",
    _ROOT.format(start="0.0", c="{p}", h="0.5", hh="0.25", s="2.0"),
)


def _time_sql(demand: str) -> str:
    part = f"(({demand})::DOUBLE / wanted::DOUBLE)"
    cases = " ".join(f"WHEN {turn} THEN {_TIME[turn].format(p=part)}" for turn in range(3))
    return f"CASE WHEN {demand} < wanted THEN CASE turn {cases} END END"


def _position_sql(time: str) -> str:
    return "CAST(floor(0.0::DOUBLE + " + " + ".join(f"w{turn}::DOUBLE * ({_DUE[turn].format(t=time)})" for turn in range(3)) + ") AS BIGINT)"


ORACLES["op12_curriculum"] = f"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS spot FROM documents
), s AS (
  SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS turn FROM (SELECT source, CAST(sum(size) AS HUGEINT) AS source_size FROM d GROUP BY source)
), w AS (
  SELECT *, CASE turn WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, sum(source_size) OVER () AS total FROM s
), o AS (
  SELECT *, CAST(coalesce(sum(source_size) OVER (ORDER BY source_size / weight::DOUBLE, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS HUGEINT) AS filled,
    CAST(sum(weight) OVER (ORDER BY source_size / weight::DOUBLE, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS HUGEINT) AS open FROM w
), level AS (
  SELECT 3 * total - 4 * filled AS num, 2 * open AS den FROM o WHERE weight * (3 * total - 4 * filled) <= 4 * source_size * open
  ORDER BY source_size / weight::DOUBLE, source LIMIT 1
), t AS (
  SELECT source, source_size, turn, CASE WHEN weight * num > 2 * source_size * den THEN (2 * source_size)::DOUBLE ELSE (weight * num)::DOUBLE / den::DOUBLE END AS target FROM o, level
), u AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS wanted FROM t
), c AS (SELECT coalesce(sum(wanted) FILTER (turn = 0), 0) AS w0, coalesce(sum(wanted) FILTER (turn = 1), 0) AS w1, coalesce(sum(wanted) FILTER (turn = 2), 0) AS w2 FROM u
), b AS (
  SELECT d.doc_id, d.size, CAST(u.source_size AS BIGINT) AS source_size, target, wanted, turn, CAST(coalesce(sum(d.size) OVER (
    PARTITION BY d.source ORDER BY spot, d.doc_id NULLS FIRST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source
), x AS (SELECT *, {_time_sql("before")} AS time0, {_time_sql("(before + source_size)")} AS time1 FROM b)
SELECT doc_id, size, source_size, target,
  CAST(greatest(0, least(wanted - before, size)) + greatest(0, least(wanted - before - source_size, size)) AS BIGINT) AS taken,
  {_position_sql("time0")} AS position, {_position_sql("time1")} AS position_again
FROM x, c
"""


@_query
def op13_repair(spark: SparkSession, sf: str) -> DataFrame:
    from codewarden.llm import conversations

    return conversations.digest(conversations.repair(conversations.damaged(_table(spark, sf, "conversations"))))
