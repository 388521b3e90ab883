"""Document fingerprints: the ``K`` smallest distinct shingle hashes of a text.

Shingles are ``WIDTH`` code points (a shorter text is one shingle). Sketches of the parts of a text or of a
corpus merge into the sketch of their union; two of them estimate resemblance and containment, one the
number of distinct shingles. A fingerprint is the hashes in order, 8 bytes each, in base64.

Defined results: a null text is empty; an empty text has the empty fingerprint, which is alike (1.0) to
itself and to nothing else (0.0); equal texts have equal fingerprints; repeated rows are rows of their own;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codewarden.llm.text import char_shingles, map_rows

K, WIDTH = 128, 9
_U = np.uint64


def bottom(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """The k smallest distinct hashes, in order."""
    share = 3.0 * k
    while share < len(hashes):  # hashes are uniform: look below a bound first, raise it if repeats left too few
        low = np.unique(hashes[hashes < _U(int(share / len(hashes) * 2.0**64))])
        if len(low) >= k:
            return low[:k]
        share *= 4
    return np.unique(hashes)[:k]


def sketch(text: str | None, k: int = K, width: int = WIDTH) -> np.ndarray:
    return bottom(char_shingles(text or "", width), k)


def encode(low: np.ndarray) -> str:
    return base64.b64encode(low.astype(">u8").tobytes()).decode()


def decode(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), ">u8").astype(_U)


def merge(sketches, k: int = K) -> np.ndarray:
    """The sketch of the union of what the sketches were made of."""
    return np.unique(np.concatenate([np.zeros(0, _U), *sketches]))[:k]


def distinct(low: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(low)) if len(low) < k else (k - 1) * 2.0**64 / float(low[-1])


def _shared(a: np.ndarray, b: np.ndarray, k: int) -> tuple[int, int]:
    union = merge([a, b], k)
    return len(np.intersect1d(np.intersect1d(a, b, True), union, True)), len(union)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated shared shingles over all shingles of both."""
    both, n = _shared(a, b, k)
    return both / n if n else 1.0


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of the first one's shingles that the second has."""
    if not len(a):
        return 1.0
    return min(1.0, resemblance(a, b, k) * distinct(merge([a, b], k), k) / distinct(a, k))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint, n_distinct (estimated distinct shingles)."""

    def rows(it):
        for doc_id, text in it:
            low = sketch(text)
            yield doc_id, encode(low), distinct(low)

    return map_rows(docs.select(F.col(id_col).cast("long"), F.col(text_col)), rows, "doc_id long, fingerprint string, n_distinct double")


def merged(prints: DataFrame, key: str, fingerprint: str = "fingerprint") -> DataFrame:
    """One fingerprint per key, of all its parts together; parts meet in two steps, so a hot key is no single group."""

    def partly(it):
        held: dict = {}
        for value, text in it:
            held.setdefault(value, []).append(decode(text or ""))
            if len(held[value]) >= 64:
                held[value] = [merge(held[value])]
            if len(held) > 2000:
                yield from ((v, encode(merge(s))) for v, s in held.items())
                held = {}
        yield from ((v, encode(merge(s))) for v, s in held.items())

    kind = dict(prints.dtypes)[key]
    some = map_rows(prints.select(key, fingerprint), partly, f"k {kind}, part string")

    def whole(frame):
        import pandas as pd

        return pd.DataFrame({"k": frame.k.iloc[:1], "fingerprint": [encode(merge([decode(p) for p in frame.part]))]})

    out = some.groupBy("k").applyInPandas(whole, f"k {kind}, fingerprint string")
    return out.withColumnRenamed("k", key)


def with_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: its fingerprint, and that of its text with the last third exchanged.

    The last ``n_chars // 3`` code points give way to the first as many (or all) of the next document by
    descending id; the first follows the last. Ids that repeat come in order of their texts' hash, null ids
    last. Texts move once: documents are dealt into ranges of ids, and each range also gets the one
    document that follows its last.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), key.alias("k"))
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = sorted({int(b) for b in own.approxQuantile("k", [i / n for i in range(1, n)], 0.25 / n)})
    # The range of an id: how many bounds are not above it.
    array = F.array(*[F.lit(b) for b in bounds]) if bounds else F.array().cast("array<bigint>")
    ranged = own.withColumn("r", F.size(F.filter(array, lambda b: b <= F.col("k"))))
    tops = sorted((row["r"], row["k"]) for row in ranged.groupBy("r").agg(F.max("k").alias("k")).collect())  # one row per range
    if not tops:
        return spark.createDataFrame([], _NEIGHBOURS)
    follows = {tops[i][1]: tops[(i + 1) % len(tops)][0] for i in range(len(tops))}
    tops_df = F.broadcast(spark.createDataFrame(list(follows.items()), "k long, to int"))
    lent = ranged.join(tops_df, "k").select("doc_id", "text", "k", F.col("to").alias("r"), F.lit(1).alias("lent"))
    placed = ranged.withColumn("lent", F.lit(0)).unionByName(lent).withColumn("tie", F.xxhash64("text"))
    placed = placed.repartition(n // 4, "r").sortWithinPartitions("r", "lent", F.desc("k"), "tie")

    def rows(it):
        held = None  # (range, id, text, sketch) that waits for its next document
        for doc_id, text, r, lent in it:
            if held is None and lent:
                continue
            low = sketch(text)
            if held is not None:
                _, held_id, before, own_low = held
                n_chars = len(before)
                third = n_chars // 3
                edited = before[: n_chars - third] + text[:third]
                edited_low = sketch(edited)
                yield (
                    held_id, n_chars, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), encode(own_low),
                    encode(edited_low), resemblance(own_low, edited_low), resemblance(own_low, low), distinct(own_low),
                )
            held = None if lent else (r, doc_id, text, low)

    return map_rows(placed.select("doc_id", "text", "r", "lent"), rows, _NEIGHBOURS, 500)


_NEIGHBOURS = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, n_distinct double"
)
